"""Personal data beside the plain patterns, and what the further kinds find and leave alone."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barograph.llm import personal_data as P
from barograph.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text: str) -> list[tuple[str, int, int]]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }
            if good[kind]():
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng, seen = random.Random(5), 0
    parts = ["a@b.c", "@", "x.y", ".", "12", "256", "0001", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "é", "token = ", "a@b"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice("a1.@+- %0") for _ in range(rng.randint(0, 14)))
        got = [s[:3] for s in P.spans_of(text) if s[0] in PATTERNS]
        assert got == plain(text), text
        seen += len(got)
    assert seen > 1000


@pytest.mark.parametrize("text", ["a" * 500_000, "1" * 500_000, "256." * 300_000, "a@" * 300_000, "x" * 500_000 + "@", "A1 " * 300_000, "/" * 500_000])
def test_long_texts_without_an_end_take_linear_time(text):
    assert P.spans_of(text) == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("pay to DE89 3704 0044 0532 0130 00 now", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("pay to GB82WEST12345698765432, or", [("iban", "GB82WEST12345698765432")]),
        ("pay to DE88 3704 0044 0532 0130 00 now", []),
        ("SSN 123-45-6789", [("social", "123-45-6789")]),
        ("order 123-45-6789", []),
        ("SSN 000-45-6789", []),
        ("she was born 12.03.1980 in", [("birth", "12.03.1980")]),
        ("published 12.03.1980 in", []),
        ("born 32.13.1980", []),
        ('token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" and', [("secret", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b")]),
        ("commit 9233a8ecf7c5b09fe5949719b6b82bc439e9329b and", []),
        ("password: aaaaaaaaaaaaaaaaaaaaaaaaaaa1", []),
        ("tel 030 1234 5678", [("local_phone", "030 1234 5678")]),
        ("invoice 030 1234 5678", []),
        ("nothing to see in 1998 or at 12:30, of 3,000 people", []),
    ],
)
def test_further_kinds(text, found):
    assert [(k, text[a:b]) for k, a, b, _ in P.spans_of(text)] == found


def test_query_equals_plain_version(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_personal_data"](spark, SF).collect()}
    docs, some = spark.read.parquet(f"{SF}/documents.parquet").collect(), 0
    assert len(got) == len(docs)
    for d in docs:
        want, r = plain(d["text"] or ""), got[d["doc_id"]]
        text = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(text).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in PATTERNS] == text
        some += bool(want)
    assert some > 5


def test_edge_rows(spark):
    """Nulls, empty and long texts, repeated rows, a clashing name, an empty table; offsets are code points."""
    rows = [(None, "é a@b.cc"), (2, None), (3, ""), (4, "ß 1.2.3.4"), (4, "ß 1.2.3.4"), (5, "x " * 400_000 + "a@b.cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("own"))
    got = sorted(P.personal_data(docs, ["doc_id", "spans"]).collect(), key=lambda r: r["doc_id"] or 0)
    spans = [[(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in got]
    assert spans == [[("email", 2, 8)], [], [], [("ip", 2, 9)], [("ip", 2, 9)], [("email", 800_000, 800_006)]]
    texts = P.personal_data(docs, ["doc_id", "text"]).where("doc_id is null or doc_id = 4").select(P.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert {r["t"] for r in texts.collect()} == {"é <email>", "ß <ip>"}
    assert P.span_digests(docs.limit(0)).collect() == []
    empty = P.span_digests(docs).where("doc_id = 2").first()
    assert empty["spans"] == "" and empty["base_sha256"] == hashlib.sha256(b"").hexdigest()
