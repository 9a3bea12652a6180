"""Breadth-first levels: eccentricity, diameter and radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import CONNECTED
from veingraph.plans.iteration import Held, Numbering, cut, numbering, slices, small
from veingraph.sources.triples import undirected, with_predicate


#: What was seen is written down as one table after so many levels.
COMPACT = 8


def _levels(triples: DataFrame, sources: DataFrame, predicate: str | None) -> tuple[DataFrame, Numbering]:
    """(source, v, level) of :func:`levels` in ids, and what numbers them."""
    edges = with_predicate(triples, predicate)
    held = Held(triples.sparkSession)
    names = numbering(edges.select(F.explode(F.array("s", "o")).alias("v")).unionByName(sources.select(F.col("source").alias("v"))))
    coded = held.keep(names.edges(edges).filter("src <> dst"))
    n = 2 * coded.count()
    both = undirected(coded.select(F.col("src").alias("s"), F.col("dst").alias("o"))).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    links = held.by(both, "src", n, lambda d: d.distinct())
    held.drop(coded)
    frontier = held.keep(names.vertices(sources.select("source")).select(F.col("v").alias("source"), "v", F.lit(0).alias("level")))
    seen, level = frontier, 0
    while True:
        level += 1

        def one(within):
            reached = frontier.select("source", F.col("v").alias("src")).join(links.filter(within("dst")), "src").select("source", F.col("dst").alias("v")).distinct()
            return reached.join(seen.filter(within("v")), ["source", "v"], "left_anti").withColumn("level", F.lit(level))

        frontier = held.sliced(slices(n), one)
        if frontier.isEmpty():
            held.drop(links)
            return seen, names
        seen = seen.unionByName(frontier)
        if level % COMPACT == 0:  # else the plan grows with the diameter
            seen = held.keep(seen)


def levels(triples: DataFrame, sources: DataFrame, predicate: str | None = CONNECTED) -> DataFrame:
    """(source, v, level): every vertex's distance from each source of ``sources`` (source), edges taken both ways.

    One level is one join of the frontier with the edges, for all sources at once, by slices of the vertices reached; what
    was seen is kept out by an anti join, and each level is written down before the next.
    """
    seen, names = _levels(triples, sources, predicate)
    return names.terms(names.terms(seen, "source")).select("source", "v", "level")


def eccentricities(triples: DataFrame, sources: DataFrame, predicate: str | None = CONNECTED) -> DataFrame:
    """(v, eccentricity) of each source within its component; 0 for an isolated one."""
    seen, names = _levels(triples, sources, predicate)
    return names.terms(seen.groupBy(F.col("source").alias("v")).agg(F.max("level").alias("eccentricity"))).select("v", "eccentricity")


def eccentricity(triples: DataFrame, node: str, predicate: str | None = CONNECTED) -> DataFrame:
    """(v, eccentricity) of one node."""
    return eccentricities(triples, triples.sparkSession.createDataFrame([(node,)], "source string"), predicate)


def all_sources(triples: DataFrame, predicate: str | None = CONNECTED) -> DataFrame:
    return with_predicate(triples, predicate).select(F.explode(F.array("s", "o")).alias("source")).distinct()


#: Vertices that the first round of the search for extremes takes; each round takes twice as many as the one before.
PROBES = 8


def _extreme(triples: DataFrame, predicate: str | None, greatest: bool) -> int | None:
    """The greatest or least eccentricity of all vertices, mostly without a search from each.

    A vertex w of known eccentricity bounds all others v of its component: d(v, w) and ecc(w) - d(v, w) from below,
    ecc(w) + d(v, w) from above. Each round searches from the vertices whose bounds are widest open and from those that
    bound the others best: for the least eccentricity the ends that were farthest from the last ones, for the greatest
    the vertices in their middle. It ends when no vertex can be beyond the best known value.
    """
    open_ = cut(all_sources(triples, predicate).select(F.col("source").alias("v"), F.lit(0).alias("low"), F.lit(2**31 - 1).alias("high")))
    best, n, helpers, done = None, PROBES, None, None
    while True:
        if best is not None:
            open_ = open_.filter(F.col("high") > best if greatest else F.col("low") < best)
        picks = open_.orderBy(F.desc("high") if greatest else F.col("low"), F.md5("v")).limit(n).select(F.col("v").alias("source"))
        if picks.isEmpty():
            return best
        probes = (picks if helpers is None else picks.unionByName(helpers)).distinct()
        probes = cut(probes if done is None else probes.join(done, "source", "left_anti"))
        seen = cut(levels(triples, probes, predicate))
        known = seen.groupBy("source").agg(F.max("level").alias("ecc"), F.max(F.struct("level", F.md5("v").alias("h"), "v")).alias("end"))
        value = known.agg(F.max("ecc") if greatest else F.min("ecc")).first()[0]
        best = value if best is None else (max if greatest else min)(best, value)
        found = cut(seen.join(small(known.select("source", "ecc")), "source").groupBy("v").agg(
            F.max(F.greatest(F.col("level"), F.col("ecc") - F.col("level"))).alias("l"), F.min(F.col("ecc") + F.col("level")).alias("h")
        ))
        helpers = cut((found.orderBy("l", F.md5("v")).limit(2) if greatest else known.select("end.v").distinct().limit(n)).select(F.col("v").alias("source")))
        done = cut(probes if done is None else done.unionByName(probes))
        tighter = open_.join(found, "v", "left").select("v", F.greatest("low", F.coalesce("l", "low")).alias("low"), F.least("high", F.coalesce("h", "high")).alias("high"))
        open_ = cut(tighter.join(probes.select(F.col("source").alias("v")), "v", "left_anti"))
        n *= 2


def diameter(triples: DataFrame, sources: DataFrame | None = None, predicate: str | None = CONNECTED) -> DataFrame:
    """(diameter): the greatest eccentricity of the sources, of all vertices by default; null of none."""
    return _of_extreme(triples, sources, predicate, True)


def radius(triples: DataFrame, sources: DataFrame | None = None, predicate: str | None = CONNECTED) -> DataFrame:
    """(radius): the least eccentricity of the sources, of all vertices by default; null of none."""
    return _of_extreme(triples, sources, predicate, False)


def _of_extreme(triples: DataFrame, sources: DataFrame | None, predicate: str | None, greatest: bool) -> DataFrame:
    name = "diameter" if greatest else "radius"
    if sources is None:
        return triples.sparkSession.createDataFrame([(_extreme(triples, predicate, greatest),)], f"{name} int")
    return eccentricities(triples, sources, predicate).agg((F.max if greatest else F.min)("eccentricity").alias(name))
