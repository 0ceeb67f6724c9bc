"""The queries of this subpackage by name: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barograph.llm import bpe, collocations, mixing, personal_data, quality_crf, repeats, rules, simhash, suffix_tree, topk, toxicity, urls, warc
from barograph.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and when in training."""
    mixed = mixing.mix_sizes(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides on each page's url."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the component of near copies that it is in."""
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality by the chain over its lines."""
    return quality_crf.quality(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded to token ids and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("tokens")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document's words, symbols and repeats, and whether it is kept."""
    judged = rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "base_failed", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log probability by unigrams and by the suffix tree."""
    return suffix_tree.score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with the others."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records say that the pages were written to."""
    read = warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity by its character n-grams."""
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases whose words belong together most."""
    return collocations.collocations(spark, table(spark, sf_dir, "documents").select("lang", "text"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's text holds personal data."""
    return personal_data.span_digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's periodic runs of words, and what is left of it without their repeats."""
    return repeats.run_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_url_filters": op2_url_filters,
    "op3_simhash": op3_simhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_top_k": op8_top_k,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
}
