"""A corpus from raw documents to packed training sequences, a stage at a time.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and works
on all that the stage before it kept. All but the last return the columns of
documents. The labels table of sf_dir is what toxicity and quality learn from.

Null and empty texts pass toxicity and go in quality, which asks for 50 words;
very long texts are judged whole; each row is a document, so that near_dedup
keeps one of repeated rows, of rows of one doc_id with different texts all that
are no copies, and treats rows without doc_id like others. Extra columns come
along whatever they are called, up to the last stage. An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import bpe, dedup, packing, pii, quality, toxicity
from sedge.llm.common import clear, give_back, keep, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is under the cut; null and blank texts stay, as do columns of any name; no labels, no cut."""
    out = toxicity.accepted(docs, table(spark, sf_dir, "labels"))
    give_back()  # what the fit held
    return out


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and that the forest finds usual; null and blank texts go, having no 50 words."""
    out = quality.accepted(docs, table(spark, sf_dir, "labels"))
    give_back()
    return out


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id; texts without words are copies only of their like under one doc_id."""
    return dedup.deduplicated(docs)


def private_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; null stays null."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and offsets; a null or blank text is a piece of its end mark."""
    return packing.pack(docs, bpe.vocabulary())


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("near_dedup", copies_out), ("pii", private_masked), ("packing", packed)]

#: The models, the automaton and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, docs, spare=others)  # the stage's own tables, and what it read
    return STAGES[-1][1](spark, docs, sf_dir)
