"""Degree distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import TYPE


def vertex_degrees(triples: DataFrame) -> DataFrame:
    """(v, degree): each triple adds one to its subject and one to its object, so a loop adds two."""
    return triples.select(F.explode(F.array("s", "o")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(triples: DataFrame) -> DataFrame:
    """(degree, frequency) over all predicates; literals are vertices."""
    return vertex_degrees(triples).groupBy("degree").agg(F.count(F.lit(1)).alias("frequency"))


def degree_dist(triples: DataFrame, limit: int | None = None) -> DataFrame:
    """(degree, count) by degree, the first ``limit`` ones."""
    ordered = degree_distribution(triples).withColumnRenamed("frequency", "count").orderBy("degree")
    return ordered if limit is None else ordered.limit(limit)


def degree_dist_label(triples: DataFrame, predicate: str, value: str | None = None, limit: int | None = None) -> DataFrame:
    """(degree, count) over vertices that have (v, predicate, value); other predicates count, in both directions.

    Without a value a vertex's degree is multiplied by the number of its values.
    """
    counted = triples.filter(F.col("p") != predicate).select(F.explode(F.array("s", "o")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    labels = triples.filter(F.col("p") == predicate)
    if value is not None:
        labels = labels.filter(F.col("o") == value)
    times = labels.groupBy(F.col("s").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    degrees = counted.join(times, "v").select((F.col("n") * F.col("k")).alias("degree"))
    ordered = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("count")).orderBy("degree")
    return ordered if limit is None else ordered.limit(limit)


def _degree(triples: DataFrame, end: str) -> DataFrame:
    return triples.groupBy(F.col(end).alias("v")).agg(F.count(F.lit(1)).alias("degree"))


def degree_in(triples: DataFrame) -> DataFrame:
    return _degree(triples, "o")


def degree_out(triples: DataFrame) -> DataFrame:
    return _degree(triples, "s")


def degree_all(triples: DataFrame) -> DataFrame:
    return vertex_degrees(triples)


def degree_max(triples: DataFrame) -> DataFrame:
    return vertex_degrees(triples).agg(F.max("degree").alias("max_degree"))


def degree_node_type(triples: DataFrame) -> DataFrame:
    """(v, type, degree) for each type of each typed vertex."""
    types = triples.filter(F.col("p") == TYPE).select(F.col("s").alias("v"), F.col("o").alias("type")).distinct()
    return vertex_degrees(triples).join(types, "v").select("v", "type", "degree")


