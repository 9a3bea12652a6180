"""Parallel random walks and the ranks of their paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.plans.iteration import BROADCAST_ROWS, cut, small
from veingraph.sources.triples import vertices

#: The last changes that must all be small before walks stop; they begin as this large.
BUFFER = 10


@dataclass(frozen=True)
class Walks:
    """``visits``: (path, step, v) of all rounds; ``ranks``: (vertex, percentage), highest first; ``rounds`` done."""

    visits: DataFrame
    ranks: DataFrame
    rounds: int


def random_walk(triples: DataFrame, length: int = 10, n_paths: int = 1000, max_iterations: int = 5, seed: int = 0) -> Walks:
    """Rounds of ``n_paths`` walks of up to ``length`` steps over out-edges of any predicate, from distinct random subjects.

    A walk stops where there is no out-edge. A vertex's percentage is its share of all visits so far. A round is the last
    if the last ten rounds' largest changes were all under a tenth of 1/(number of subjects); ``max_iterations`` + 1 rounds
    are done at most. Random numbers are digests of the seed, the round, the path and the edge, so a lost executor's work
    comes out the same when it is done again, and on other engines too. The walkers, ``n_paths`` rows, are sent to the
    edges if that is few, so a step shuffles no edge that no walker stands at.
    """
    edges = cut(triples.select("s", "p", "o").repartition("s"))
    subjects = cut(edges.select("s").distinct())
    n_subjects, n_vertices = subjects.count(), vertices(edges).count()
    bound = 1.0 / n_subjects / 10.0 if n_subjects else 0.0
    visits, old, buffer, rounds = None, None, [float(BUFFER)] * BUFFER, 0
    while True:
        number = F.lit(f"{seed}/{rounds}")
        name = F.md5(F.concat_ws("/", number, F.col("s")))
        starts = subjects.select("s", name.alias("path")).orderBy("path", "s").limit(n_paths)
        walker = cut(starts.select("path", F.lit(0).alias("step"), F.col("s").alias("v")))
        trail = walker
        for step in range(1, length + 1):
            draw = F.struct(F.md5(F.concat_ws("/", F.lit(str(step)), "path", "p", "o")).alias("r"), F.col("o").alias("o"))
            here = small(walker) if n_paths <= BROADCAST_ROWS else walker
            moved = edges.join(here, edges["s"] == here["v"]).groupBy("path").agg(F.min(draw).alias("d"))
            walker = cut(moved.select("path", F.lit(step).alias("step"), F.col("d.o").alias("v")))
            trail = trail.unionByName(walker)
        visits = cut(trail if visits is None else visits.unionByName(trail))
        total = visits.count()
        new = visits.groupBy("v").agg((F.count(F.lit(1)) / float(max(total, 1))).alias("percentage"))
        change = new.withColumn("diff", F.col("percentage")) if old is None else new.join(old.select("v", F.col("percentage").alias("was")), "v", "left").withColumn(
            "diff", F.abs(F.col("percentage") - F.coalesce("was", F.lit(0.0)))
        )
        old = cut(change)
        unvisited = old.count() < n_vertices
        largest = float(BUFFER) if unvisited else float(old.agg(F.max("diff")).first()[0] or 0.0)
        buffer = [*buffer[1:], largest]
        if max(buffer) < bound or rounds == max_iterations:
            break
        rounds += 1
    ranks = old.select(F.col("v").alias("vertex"), "percentage").orderBy(F.desc("percentage"), "vertex")
    return Walks(visits, ranks, rounds + 1)


def path_rank(walks: Walks, top: int = 100) -> DataFrame:
    """(path, score, nodes): the ``top`` paths by the sum of their distinct vertices' percentages (to 12 places), nodes in order of visit."""
    ranks = walks.ranks.withColumnRenamed("vertex", "v")
    met = walks.visits.groupBy("path", "v").agg(F.min("step").alias("step")).join(ranks, "v")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("step", "v"))), lambda x: x["v"])
    return met.groupBy("path").agg(F.round(F.sum("percentage"), 12).alias("score"), F.array_join(in_order, "->").alias("nodes")).orderBy(F.desc("score"), "path").limit(top)


def random_node(triples: DataFrame, seed: int = 0) -> DataFrame:
    """(s): one random subject, the same for a seed: that of the least digest."""
    return triples.groupBy("s").agg(F.md5(F.concat_ws("/", F.lit(str(seed)), "s")).alias("r")).agg(F.min(F.struct("r", "s")).alias("m")).filter("m IS NOT NULL").select("m.s")
