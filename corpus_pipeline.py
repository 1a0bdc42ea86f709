"""From documents to token ids: quality rules, near duplicates, benchmark decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again
before the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, decontam, jaccard, pii, quality
from lexispark.llm._spark import cut, load


def _same_columns(docs: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` with the columns of ``docs``; n_chars, where there is one, is that of the text as it now is."""
    size = F.length("text").cast("long").alias("n_chars")
    return done.select(*[size if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that the rules reject go."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard.deduplicate(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; from the others hit words are cut."""
    return _same_columns(docs, decontam.scrub(docs, load(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced."""
    return _same_columns(docs, pii.sanitize(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    path = bpe.default_ranks()
    done = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path)
    right = F.col("decoded") == F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", right.alias("decodes"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: Rule votes, connected classes and BPE have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
