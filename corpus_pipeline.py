"""Language ID, near-duplicates, decontamination and mixing over `documents`, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, language_id, mixing, simhash_dedup
from larkspur.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: those of no letters (null and empty texts too), and those whose nearest codewords can't be told apart.

    Without any labelled row nothing can be learned, and nothing is rejected but texts without letters."""
    docs = docs.select(COLUMNS)
    if not docs.filter(~language_id.held_out() & F.col("lang").isNotNull()).take(1):
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = language_id.identify(docs, per_language=300)
    return named.filter((F.col("lang_pred") != language_id.UND) & ~F.col("ambiguous")).select(COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Rows of one id are one document: it goes if any of them is a near-duplicate of a lesser id, and else one row of it stays, the least by its
    columns. Rows without an id can't be told apart and stay."""
    docs = docs.select(COLUMNS)
    classes = written(simhash_dedup.near_duplicates(docs).select("doc_id", "component_id"), "classes")
    # only ids are joined, so that texts are not shuffled where the lists of ids are small
    gone = written(classes.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(COLUMNS)
    twice = written(classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not twice.take(1):
        return kept
    rest = F.struct(*COLUMNS[1:])
    single = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("row")).select("doc_id", "row.*")
    return kept.join(twice, "doc_id", "left_anti").select(COLUMNS).unionByName(single.select(COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item; null and empty texts hold none."""
    return decontaminate.keep_clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by reference: each document with the copies it gets; null texts have no words and get none."""
    return mixing.mix(docs.select(COLUMNS)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
]

#: The stages are a trained classifier, a 64-bit sketch, a ranked search and an iterative solver: none is SQL. tests/llm/ hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
