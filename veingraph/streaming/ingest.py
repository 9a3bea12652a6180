"""Triples from a stream of N-Triples files, and running counts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.sources.triples import parse_ntriples


def stream_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """A stream of (g, s, p, o) from the files that appear in a folder."""
    return parse_ntriples(spark.readStream.text(path), graph)


def running_degrees(stream: DataFrame) -> DataFrame:
    """(v, degree) of all triples so far, for the update or complete output mode."""
    return stream.select(F.explode(F.array("s", "o")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def running_predicates(stream: DataFrame) -> DataFrame:
    """(predicate, size) of all triples so far."""
    return stream.groupBy(F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("size"))
