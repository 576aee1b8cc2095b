"""One query for each corpus operator, with production parameters, over its whole table.

What nulls, empty and long texts, ties, repeated rows, empty tables and other
columns give is stated by the operator that a query names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import bpe, collocations, dedup, embeddings, htmltext, langid, licenses, oracles, packing, periodic, pii, quality, shard, toxicity
from sedge.llm.common import table

SHARDS = 24


def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: dedup.near_duplicates."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of documents, learned from labels: toxicity.grade."""
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents and back: bpe.digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.vocabulary())


def op4_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from three folds of four: langid.predict."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit_on(docs))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences: packing.pack."""
    return packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary())


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of documents by key, equal weights: shard.assign."""
    return shard.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: pii.report."""
    return pii.report(table(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors: embeddings.near_duplicates."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


def op9_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdicts: quality.judge."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages: htmltext.extract."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language: collocations.mine."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in documents: licenses.report."""
    return licenses.report(table(spark, sf_dir, "documents"))


def op13_kolpakov_kucherov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words, tails of a tenth of the documents made periodic first: periodic.digests."""
    return periodic.digests(periodic.with_tails(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for k, v in list(globals().items()) if k.startswith("op") and callable(v)}
SQL: dict[str, str] = {"op1_minmax_dedup": oracles.OP1, "op6_rendezvous_sharding": oracles.OP6, "op8_nn_descent": oracles.OP8, "op11_pair_naming": oracles.OP11}
