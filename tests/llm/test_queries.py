"""The registered queries beside their SQL, and the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from barograph.llm.catalogue import ORACLE, QUERIES
from tools.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_and_sql_agree(spark, name):
    assert differences(spark, SF, name) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()} and len(rows) > before
    assert "pipeline" not in QUERIES and corpus_pipeline.ORACLE_SQL is None
