"""Periodic runs beside a search over every start and period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import repeats
from barograph.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every period from every place."""
    n, smallest = len(words), {}
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(24, 3 * q):
                smallest.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted((s, length, q) for (s, length), q in smallest.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made_up(rng: random.Random) -> list[str]:
    words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 350))]
    for _ in range(rng.randint(0, 3) if len(words) > 30 else 0):
        a = rng.randrange(len(words))
        q = rng.randint(1, max(1, (len(words) - a) // 3))
        for i in range(a + q, min(len(words), a + q * rng.randint(2, 6) + rng.randint(0, q))):
            words[i] = words[i - q]
    return words


@pytest.mark.parametrize("short", [1, 3, 16])
def test_runs_equal_brute_force(short):
    """Small lags by scans or, with a low ``short``, by scales too."""
    rng, seen = random.Random(short), 0
    for _ in range(80):
        texts = sorted((made_up(rng) for _ in range(3)), key=len, reverse=True)
        number, x, bounds = {}, [], [0]
        for i, words in enumerate(texts):
            x += [number.setdefault(w, len(number)) for w in words] + [-1 - i]
            bounds.append(len(x))
        got = repeats.runs_of(np.array(x, np.int64), np.array(bounds), short)
        want = [(b + s, b + s + length, q) for words, b in zip(texts, bounds, strict=False) for s, length, q in runs(words)]
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))
        seen += len(want)
    assert seen > 50


@pytest.mark.parametrize("x", [np.zeros(200_000, np.int64), np.tile(np.arange(37), 6000), np.tile(np.arange(5000), 40)])
def test_very_long_runs(x):
    got = repeats.runs_of(np.append(x, -1), np.array([0, len(x) + 1]))
    assert got.tolist() == [[0, len(x), len(set(x.tolist()))]]


def test_query_equals_plain_version(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 2500:  # too long for the plain search
            continue
        found, r = runs(words), got[d["doc_id"]]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        wanted = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert r["n_runs"] == len(found) and (r["start"], r["length"], r["period"], r["exponent_milli"]) == wanted
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == sha(collapsed(words, found))
        with_runs += bool(found)
    assert with_runs > 10


def test_edge_rows(spark):
    """Nulls, blanks, repeated rows, very long texts, clashing names and an empty table."""
    rows = [(None, "x " * 30, "u"), (2, None, None), (3, " \n\t ", "u"), (4, "a b c", "u"), (4, "a b c", "u"), (5, "é ü " * 60_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("n_words", F.lit("own"))
    got = sorted(repeats.periodic_runs(docs, ["doc_id", "runs", "n_words"]).collect(), key=lambda r: (r["doc_id"] or 0))
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in got] == [
        (None, 30, [(0, 30, 1)], "x"),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 3, [], "a b c"),
        (4, 3, [], "a b c"),
        (5, 120_000, [(0, 120_000, 2)], "é ü"),
    ]
    assert repeats.run_digests(docs).count() == 6
    assert repeats.run_digests(docs.limit(0)).collect() == []
    assert "text" in repeats.periodic_runs(docs, docs.columns).columns
