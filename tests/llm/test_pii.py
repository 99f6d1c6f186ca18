"""Pseudonyms: bijection, validity, links across documents, round trip."""

import datetime
import random
import re

import duckdb

from loam.llm import pii

KEY = pii.Feistel(b"test key")
TEXT = ("Mail Ann.Lee+x@mail7.example.com or ann.lee+x@MAIL7.example.com, call +1 (375) 555-4393, 375-555-4393 or "
        "+44 20 7946 0958. Card 4207051279108084, 4207 0512 7910 8084; SSN 219-09-9999; host 28.125.121.88. "
        "IBAN DE89 3704 0044 0532 0130 00 on 2024-02-29, 29.02.2024, 2/29/2024 and 31/12/2023.")
NOT = ("4207051279108085 1111111111111111 666-12-3456 000-12-3456 256.1.1.1 1.2.3.4.5 DE88 3704 0044 0532 0130 00 "
       "2023-02-29 13/13/2024 31.02.2024 2.0. 155-4393 a@b someone@ @x.com price 12.50 1999-1-1 12345")


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 97, 1000):
        image = [KEY.permute(v, n, b"t") for v in range(n)]
        assert sorted(image) == list(range(n))
        assert [KEY.permute(v, n, b"t", back=True) for v in image] == list(range(n))
    big = 36 ** 70
    for v in (0, 1, big - 1, random.Random(1).randrange(big)):
        assert KEY.permute(KEY.permute(v, big, b"x"), big, b"x", back=True) == v


def test_values_formats_and_links():
    new, spans = pii.replace(TEXT, KEY)
    kinds = [k for k, *_ in spans]
    assert kinds == ["email"] * 2 + ["phone"] * 3 + ["card"] * 2 + ["ssn", "ip", "iban"] + ["date"] * 4
    values = [new_v for new_v in _values(new)]
    assert [k for k, _ in values] == kinds  # still valid in the same formats
    email, phone, card, date = ([v for k, v in values if k == x] for x in ("email", "phone", "card", "date"))
    assert email[0].lower() == email[1].lower() and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\+[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", email[0])
    assert phone[0][3:].replace("(", "").replace(") ", "-") == phone[1] and phone[2].startswith("+44 ")
    assert card[0] == card[1].replace(" ", "")
    y, m, d = date[0].split("-")
    assert date[1] == f"{d}.{m}.{y}" and date[2] == f"{int(m)}/{int(d)}/{y}"
    for _, a, b in spans:
        assert TEXT[a:b] not in new or TEXT[a:b].isalpha()
    assert pii.replace(new, KEY, back=True)[0] == TEXT.replace("31/12/2023", pii.replace(new, KEY, back=True)[0][-11:-1])


def _values(text):
    return [(k, text[a:b]) for a, b, k, _ in pii.find(text)]


def test_invalid_values_stay():
    assert pii.replace(NOT, KEY) == (NOT, [])
    assert pii.replace("", KEY) == ("", [])


def test_random_values_stay_valid_and_distinct():
    rng = random.Random(3)
    cards, dates, ips = set(), set(), set()
    for _ in range(300):
        body = [rng.randrange(10) for _ in range(15)]
        cards.add("".join(map(str, body)) + str(pii.luhn_digit(body)))
        dates.add(f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}")
        ips.add(".".join(str(rng.randrange(256)) for _ in range(4)))
    for values, kind in ((cards, "card"), (dates, "date"), (ips, "ip")):
        out = {pii.replace(v, KEY)[0] for v in values}
        assert len(out) == len(values)
        assert all([k for k, _ in _values(v)] == [kind] for v in out)
        assert {pii.replace(v, KEY, back=True)[0] for v in out} == values


def test_another_key_gives_other_pseudonyms():
    assert pii.replace("4207051279108084", KEY)[0] != pii.replace("4207051279108084", pii.Feistel(b"other"))[0]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, b"test key").collect()}
    given = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert set(rows) == set(given)
    seen = 0
    for d, t in given.items():
        assert rows[d].text == pii.replace(t, KEY)[0]
        for a, b, k, _ in pii.find(t):
            seen += 1
            assert t[a:b] not in rows[d].text
    assert seen > 50


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, TEXT, "c"), (3, TEXT, "d"), (3, TEXT, "d"), (4, "word " * 30000 + "219-09-9999", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = pii.pseudonymise(df, b"k")
    assert got.columns == ["doc_id", "text", "pii_spans"]
    out = got.collect()
    assert len(out) == 6 and next(r for r in out if r.doc_id == 1).text is None
    assert len({r.text for r in out if r.doc_id in (None, 3)}) == 1
    assert pii.pseudonymise(df.limit(0), b"k").count() == 0


def test_phones_without_separators():
    for spaced, compact in (("+44 20 7946 0958", "+442079460958"), ("+1 (375) 555-4393", "+13755554393"), ("+7 495 123 4567", "+74951234567"),
                            ("+351 21 345 6789", "+351213456789")):
        a, b = pii.replace(spaced, KEY)[0], pii.replace(compact, KEY)[0]
        assert b != compact and re.sub("[^0-9+]", "", a) == b  # one number, however it is written
        assert pii.replace(b, KEY, back=True)[0] == compact
    for odd in ("+1234567", "+1234567890123456", "+10005554393", "x+0123456789"):
        assert pii.replace(odd, KEY) == (odd, [])


def test_detection_against_plain_rules():
    """Cards, social security numbers, addresses and dates found by an independent reading of digit runs."""
    rng = random.Random(9)
    bits = ["4207051279108084", "219-09-9999", "666-12-3456", "28.125.121.88", "256.1.1.1", "2024-02-29", "2023-02-29", "4207051279108085", "x", " ", ",",
            "12", "1.2.3.4.5"]

    def plain(text):
        out = set()
        for m in re.finditer(r"[0-9][0-9.-]*[0-9]|[0-9]", text):
            v, at = m[0], m.start()
            if at and text[at - 1] == "-":
                continue
            if v.isdigit() and 13 <= len(v) <= 19 and len(set(v)) > 1:
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(v)))
                if total % 10 == 0:
                    out.add(("card", at, m.end()))
            parts = v.split("-")
            if len(parts) == 3 and [len(p) for p in parts] == [3, 2, 4] and all(p.isdigit() for p in parts):
                if parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000":
                    out.add(("ssn", at, m.end()))
            if len(parts) == 3 and [len(p) for p in parts] == [4, 2, 2] and all(p.isdigit() for p in parts):
                try:
                    if 1900 <= datetime.date(*map(int, parts)).year <= 2099:
                        out.add(("date", at, m.end()))
                except ValueError:
                    pass
            octets = v.split(".")
            if len(octets) == 4 and all(o.isdigit() and str(int(o)) == o and int(o) < 256 for o in octets):
                out.add(("ip", at, m.end()))
        return out
    for _ in range(3000):
        text = " ".join(rng.choices(bits, k=6))
        assert {(k, a, b) for a, b, k, _ in pii.find(text)} == plain(text), text
