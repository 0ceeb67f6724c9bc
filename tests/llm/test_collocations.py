"""Collocations beside plain counting, with parts and slices of any size."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows) -> tuple[dict[str, Counter], Counter]:
    """By language: how often each phrase of up to three words occurs, and the number of all words."""
    counts, words = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            f.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    return counts, words


def plain(rows, least: int, first: int) -> list[tuple]:
    out, (counts, words) = [], plain_counts(rows)
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in phrases.items()):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first]):
            out.append((lang, i + 1, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["The", "the", "of", "é", "ß", "new", "york", "city", "a", "b", " x", "日本"]
    mark = ["", "", "", "", ".", ",", "\n", "!?", "\t", "\r\n"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(mark) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    langs = ["en", "en", "en", "de", None]
    return [(rng.choice(langs), t) for t in texts] + [("en", None), (None, ""), ("fr", "only once"), ("en", "a b " * 3000)]


@pytest.mark.parametrize(("part", "slice_bytes"), [(C.PART, C.SLICE), (50, 500), (3, 1)])
def test_counts_equal_plain_ones_however_they_are_cut(spark, rows, part, slice_bytes):
    """A part of few places cuts pairs by their third word; a slice of one byte is one text."""
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got, words = C.phrase_counts(spark, docs, 4, part, slice_bytes)
    phrases = {(r["lang"], *[w for w in (r["w1"], r["w2"], r["w3"]) if w is not None]): r["f"] for r in got.collect()}
    counts, total = plain_counts(rows)
    assert phrases == {(lang, *p): n for lang, f in counts.items() for p, n in f.items() if n >= 4}
    assert got.count() == len(phrases)
    assert {r["lang"]: r["n"] for r in words.collect()} == +total


def test_collocations_equal_plain_ones(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit("own")).withColumn("w1", F.lit(1))
    for least, first in ((3, 2000), (10, 7)):
        got = C.collocations(spark, docs, least, first).collect()
        assert sorted(tuple(r) for r in got) == plain(rows, least, first) and got


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([("en", None), (None, " \n. ")], "lang string, text string")
    assert C.collocations(spark, docs).collect() == []
    assert C.collocations(spark, docs.limit(0)).collect() == []


def test_partitions_of_a_sort_are_the_counts():
    rng = np.random.default_rng(1)
    for low in (1, 7, 300):
        keys = rng.integers(-1, low, (3, 4000))
        keys[0] = np.abs(keys[0])
        keys[2][keys[1] == -1] = -1
        weights = rng.integers(1, 5, 4000)
        want = {d: Counter() for d in (1, 2, 3)}
        for k, w in zip(keys.T.tolist(), weights.tolist(), strict=True):
            for d in (1, 2, 3):
                if -1 not in k[:d]:
                    want[d][tuple(k[:d])] += w
        for least in (0, 12):
            found = C.multikey_partitions(keys, weights, lambda w, d, least=least: w < least)
            for d in (1, 2, 3):
                got = {tuple(keys[:d, i].tolist()): n for depth, at, total in found if depth == d for i, n in zip(at.tolist(), total.tolist(), strict=True)}
                assert {k: n for k, n in got.items() if n >= least} == {k: n for k, n in want[d].items() if n >= least}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_017
    df = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    got = df.select(C._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert got == 1_000_000 * big * big // ((big + 1) * (big + 2))
