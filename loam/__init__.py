"""loam: Spark-native data preparation, profiling and auto-modelling.

Every public function maps a DataFrame to a DataFrame (or to a small fitted
statistics object).  Statistics are gathered with as few aggregate jobs as
possible; nothing but bounded statistics ever reaches the driver.
"""

__version__ = "0.1.0"
