"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import discard, stored, table
from veingraph.llm.decontam import phrase_matches
from veingraph.llm.lines import dedup_lines
from veingraph.llm.mixing import mix
from veingraph.llm.neardup import near_duplicates
from veingraph.llm.quality import judge_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from ``labels``."""
    return judge_quality(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of nothing else go. ``n_chars`` follows the text."""
    left = dedup_lines(docs).filter("n_dropped = 0 OR text RLIKE '[^ \\\\t-\\\\r]'")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return near_duplicates(docs).filter("kept").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return phrase_matches(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, mixed to the sources' target weights, with ``copy`` and ``mix_key``."""
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL has neither the learned list nor the similarity classes; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result being written as Parquet and read again, then removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(spark, before)
        before = path
    return docs
