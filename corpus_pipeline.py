"""Corpus pipeline: language identification, near duplicates, benchmark decontamination, personal data, tokens.

Each stage works on all rows that its predecessor kept. ``run`` writes every stage as Parquet in the shared folder and reads it again for the
next one, so a lost executor costs a re-read and not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierspark.llm import decontaminate, language, ngram_join, pii
from dossierspark.llm.queries import encoded
from dossierspark.llm.rows import quoted
from dossierspark.session import durable, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the learned context trees tell; null texts, texts without letters and undecided ones go."""
    told = language.identify(docs.withColumn("_lang", F.col("lang")), language.learn(docs))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*[quoted(c) for c in docs.columns])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of linked documents."""
    return ngram_join.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by their kind; n_chars counts the new text."""
    return pii.redact(docs, pii.train()).withColumn("n_chars", F.length("text").cast("long")).select(*[quoted(c) for c in docs.columns])


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes of every document."""
    return encoded(docs)


STAGES = [("language identification", identified), ("n-gram Jaccard join", deduplicated), ("benchmark decontamination", decontaminated),
          ("personal data", redacted), ("byte-level BPE", tokenised)]

#: SQL expresses neither the learned stages nor the merges; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
