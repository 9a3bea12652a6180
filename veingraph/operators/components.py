"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import CONNECTED, is_blank
from veingraph.plans.iteration import cut, decode, dictionary, encode
from veingraph.sources.triples import vertices, with_predicate


#: Up to so many edges are one task's work: a round then needs no shuffle.
ONE_TASK_EDGES = 200_000


def _packed(edges: DataFrame) -> DataFrame:
    """``edges`` written down, in one partition if they are few."""
    written = cut(edges)
    few = written.rdd.getNumPartitions() > 1 and written.count() <= ONE_TASK_EDGES
    return cut(written.coalesce(1)) if few else written


def _both(pairs: DataFrame, *ends: str) -> DataFrame:
    """(a, b) twice for each row: of the first two columns and of the other two, without a union of two scans."""
    c, d, e, f = (F.col(x) for x in ends)
    twice = F.explode(F.array(F.struct(c.alias("a"), d.alias("b")), F.struct(e.alias("a"), f.alias("b"))))
    return pairs.select(twice.alias("e")).select("e.a", "e.b")


def least_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b): every non-least id of ``edges`` (src, dst) with the least id of its component.

    Large-star and small-star steps alternate until only stars are left: a number of rounds that grows with the logarithm
    of the component sizes rather than with their diameters. Hubs are no burden: a step takes minima, combined before
    the shuffle, and joins them back.
    """
    now = _packed(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while not _is_final(now):
        both = _both(now, "a", "b", "b", "a")
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = _both(large.join(down, "a"), "b", "m", "a", "m")
        now = _packed(star.filter("a <> b").distinct())
    return now


def _is_final(pairs: DataFrame) -> bool:
    """Whether every id of the distinct pairs (a, b) points at one other id, which points at none: then all are stars."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"))))
    by_id = pairs.select(ends.alias("e")).groupBy("e.v").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return by_id.filter("up > 1 OR up = 1 AND n > 1").isEmpty()


def connected_components(triples: DataFrame, predicate: str | None = CONNECTED) -> DataFrame:
    """(node, label): each vertex with the smallest one of its component, edges taken both ways.

    Blank nodes have no STR, so no label passes through them: each keeps its own.
    """
    edges = with_predicate(triples, predicate)
    named = edges.filter(~is_blank(F.col("s")) & ~is_blank(F.col("o")))
    ids = dictionary(vertices(edges))
    least = decode(decode(least_neighbours(encode(named, ids)), ids, "a"), ids, "b")
    return ids.select(F.col("term").alias("node")).join(least.withColumnsRenamed({"a": "node", "b": "label"}), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )
