"""Operators for preparing training text: deduplication, decontamination, scoring, tokenising.

Nothing outside this package imports it (the entry module does so under a guard).
"""
