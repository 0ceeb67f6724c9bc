"""Columns of the caller that have the names an operator uses inside keep their values."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barograph.llm import mixing, near_copies, rules, toxicity

NAMES = ["size", "position", "position_again", "target", "taken", "source_size", "turn", "ahead", "level", "weight", "slice"]
INNER = ["__source", "__order", "__slice", "__none", "__key", "__text", "__bands", "__row", "__words", "__lines", "__failed", "__out", "__body", "a.b"]


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join(f"w{i}x{j % 17}." for j in range(60)), "s" if i % 2 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(n + "-"), "doc_id").alias(n) for n in NAMES + INNER])


def check(out, docs, count):
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) >= count
    for r in rows:
        assert all(r[n] == f"{n}-{r['doc_id']}" for n in NAMES + INNER)


def test_mixing(spark, docs):
    check(mixing.mix_documents(spark, docs), docs, 1)


def test_near_copies(spark, docs):
    check(near_copies.one_of_each(spark, docs), docs, 12)


def test_quality_rules(docs):
    out = rules.quality_rules(docs)
    check(out.select(*[f"`{c}`" for c in docs.columns]), docs, 12)
    assert all(r["kept"] in (True, False) and r["n_words"] == 60 for r in out.collect())


def test_replaced_columns_have_the_operators_values(docs):
    out = rules.quality_rules(docs.withColumn("n_words", F.lit("own")))
    assert dict(out.dtypes)["n_words"] == "bigint" and out.columns.count("n_words") == 1


def test_of_differing_rows_of_one_document_the_same_one_stays(spark):
    text = " ".join(f"w{j}" for j in range(30))
    rows = [(1, text, f"v{k}") for k in range(20)]
    kept = [near_copies.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, v string").repartition(n)).collect() for n in (1, 5)]
    assert kept[0] == kept[1] and [r["v"] for r in kept[0]] == ["v0"]


def test_arrays_of_a_slice_stay_small():
    """Tasks of near-dedup and toxicity hold many numbers for each byte of a slice."""
    words = [f"{i * 7919 % 10007}x" for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(800)), "__text": [" ".join(words[i % 500 :]) for i in range(800)]})
    model = toxicity.Model(np.arange(0, 1 << 20, 97), np.zeros(len(range(0, 1 << 20, 97))), 0.0)
    assert batch.nbytes > 3 << 20
    for made in (near_copies._sketched, toxicity._scored(model, "__text", ["doc_id"])):
        tracemalloc.start()
        for _ in made(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50 << 20
