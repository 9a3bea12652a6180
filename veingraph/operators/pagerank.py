"""PageRank in its variants: over one predicate, and the shell's kernel, whose parameters say what its variants differ in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import CONNECTED, is_literal
from veingraph.plans.iteration import Held, cut, decode, dictionary, encode, numbering, slices
from veingraph.sources.triples import undirected, vertices, with_predicate


@dataclass(frozen=True)
class Ranks:
    """``ranks``: (vertex, pagerank), highest first; ``rounds``: how many were computed."""

    ranks: DataFrame
    rounds: int


def _iterate(
    edges: DataFrame, state: DataFrame, n: int, damping: float, rounds: int,
    judge: Callable[[DataFrame], DataFrame], stop: Callable[[tuple], bool],
) -> tuple[DataFrame, int]:
    """Rounds of new(v) = damping * sum(rank(u) * w(u, v)) + (1 - damping) / n.

    ``edges``: (src, dst, w), partitioned by src once; ``state``: (v, rank, diff). ``judge`` turns (v, rank, new), where new is
    null for a vertex without in-edges, to the next state; the maximum and the sum of its diffs go to ``stop``.
    """
    done = 0
    while done < rounds:
        gathered = (
            state.select(F.col("v").alias("src"), "rank").join(edges, "src").groupBy(F.col("dst").alias("v"))
            .agg((F.sum(F.col("rank") * F.col("w")) * damping + (1 - damping) / n).alias("new"))
        )
        state = cut(judge(state.select("v", "rank").join(gathered, "v", "left")))
        done += 1
        if stop(tuple(state.agg(F.max("diff"), F.sum("diff")).first())):
            break
    return state, done


def _weighted(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(src, dst, w): each edge with the inverse of its source's degree, written down partitioned by source."""
    return cut(edges.join(degrees.select(F.col("v").alias("src"), (1.0 / F.col("degree")).alias("w")), "src").repartition("src"))


def pagerank(
    triples: DataFrame, damping: float = 0.85, limit: int = 50, directed: bool = True, predicate: str | None = CONNECTED,
    tolerance: float | None = None, only_large_updates: bool = False,
) -> Ranks:
    """Ranks over the vertices of one predicate, from 1/N each.

    A vertex without in-edges keeps its rank for ever, and what flows out of vertices without out-edges is lost, so ranks
    need not add up to 1. It stops when no rank changes by ``tolerance`` (1/(10 N) by default) or more, or after ``limit``
    rounds. Undirected: edges count both ways, and the degree is the total one. With ``only_large_updates`` a rank changes
    only by ``tolerance`` or more.
    """
    edges = with_predicate(triples, predicate)
    held = Held(triples.sparkSession)
    ends = edges.select(F.explode(F.array("s", "o")).alias("v"))
    names = numbering(ends)
    ids = held.keep(names.vertices(ends))
    n = ids.count()
    if not n:
        return Ranks(ids.select(F.col("v").cast("string").alias("vertex"), F.lit(0.0).alias("pagerank")), 0)
    bound = 1.0 / n / 10.0 if tolerance is None else tolerance
    coded = held.keep(names.edges(edges))
    rows = coded.count() * (1 if directed else 2)
    flows = coded.select(F.col("src").alias("s"), F.col("dst").alias("o"))
    links = held.by((flows if directed else undirected(flows)).select(F.col("s").alias("src"), F.col("o").alias("dst")), "src", rows)
    held.drop(coded)
    degrees = links.groupBy(F.col("src").alias("v")).agg((1.0 / F.count(F.lit(1))).alias("w"))
    state = held.keep(ids.join(degrees, "v", "left").select("v", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("diff"), "w"))
    held.drop(ids)

    def judge(joined: DataFrame) -> DataFrame:
        new = F.coalesce("new", "rank")
        diff = F.abs(new - F.col("rank"))
        if only_large_updates:
            new, diff = F.when(diff >= bound, new).otherwise(F.col("rank")), F.when(diff >= bound, diff).otherwise(0.0)
        return joined.select("v", new.alias("rank"), diff.alias("diff"), "w")

    rounds = 0
    while rounds < limit:
        before = state

        def one(within):
            # Every link of a vertex carries the same share, and a slice of vertices gets its new ranks at a time.
            shares = before.filter("w IS NOT NULL").select(F.col("v").alias("src"), (F.col("rank") * F.col("w")).alias("share")).hint("shuffle_hash")
            gathered = (
                links.filter(within("dst")).join(shares, "src").groupBy(F.col("dst").alias("v"))
                .agg((F.sum("share") * damping + (1 - damping) / n).alias("new"))
            )
            return judge(before.select("v", "rank", "w").filter(within("v")).join(gathered, "v", "left"))

        state = held.sliced(slices(rows), one)
        held.drop(before)
        rounds += 1
        most = state.agg(F.max("diff")).first()[0] or 0.0
        if most == 0.0 if only_large_updates else most < bound:
            break
    held.drop(links)
    ranks = names.terms(state.select("v", "rank")).select(F.col("v").alias("vertex"), F.col("rank").alias("pagerank"))
    return Ranks(ranks.orderBy(F.desc("pagerank"), "vertex"), rounds)


def first_predicate(triples: DataFrame) -> str | None:
    row = triples.agg(F.min("p")).first()
    return row[0] if row else None


def shell_pagerank(
    triples: DataFrame, predicate: str | None = None, directed: bool = True, limit: int | None = None, damping: float = 0.85,
    threshold: float = 1e-4, max_iterations: int = 100, diff_type: str = "avgDiff", reverse: bool = False,
) -> Ranks:
    """Ranks that flow over one predicate (the first by default) while N and degrees are of all predicates.

    N counts subjects and non-literal objects. Directed: a vertex of the predicate without in-edges on it gets
    rank * (1 - d) + (1 - d)/N. Every round has its new ranks; it stops when the sum of changes is under threshold * N
    (``avgDiff``) or the largest under the threshold (``maxDiff``), after ``max_iterations`` rounds at the latest.
    ``reverse`` lets ranks flow against the edges.
    """
    predicate = first_predicate(triples) if predicate is None else predicate
    if reverse:
        triples = triples.select("p", F.col("o").alias("s"), F.col("s").alias("o"))
    flow_edges = triples.filter(F.col("p") == predicate).select("s", "o")
    ids = dictionary(vertices(triples))
    n = ids.filter(~is_literal(F.col("term"))).count()
    if not n:
        return Ranks(ids.select(F.col("term").alias("s"), F.lit(0.0).alias("newPR")), 0)
    ends = triples.select("s") if directed else triples.select(F.explode(F.array("s", "o")).alias("s"))
    counted = ends.groupBy("s").agg(F.count(F.lit(1)).alias("degree"))
    degrees = counted.join(ids.select(F.col("term").alias("s"), F.col("id").alias("v")), "s").select("v", "degree")
    edges = encode(flow_edges if directed else undirected(flow_edges), ids)
    links = _weighted(edges, degrees)
    members = encode(flow_edges, ids).select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    state = cut(members.withColumns({"rank": F.lit(1.0 / n), "diff": F.lit(0.0)}))
    source = F.col("rank") * (1 - damping) + (1 - damping) / n

    def judge(joined: DataFrame) -> DataFrame:
        new = F.coalesce("new", source if directed else F.col("rank"))
        return joined.select("v", new.alias("rank"), F.abs(new - F.col("rank")).alias("diff"))

    if diff_type == "avgDiff":
        stop = lambda d: (d[1] or 0.0) < threshold * n
    else:
        stop = lambda d: (d[0] or 0.0) < threshold
    state, rounds = _iterate(links, state, n, damping, max_iterations, judge, stop)
    ranks = decode(state.select("v", "rank"), ids).select(F.col("v").alias("s"), F.col("rank").alias("newPR")).orderBy(F.desc("newPR"), "s")
    return Ranks(ranks if limit is None else ranks.limit(limit), rounds)


def shell_badrank(triples: DataFrame, *args, **options) -> Ranks:
    """BadRank as the shell had it: the same flow as PageRank; ``reverse=True`` gives the textbook one."""
    found = shell_pagerank(triples, *args, **options)
    return Ranks(found.ranks.withColumnRenamed("newPR", "newBR"), found.rounds)


def abs_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(diff): the sum of |new - prev| over the vertices of two tables (v, rank)."""
    both = before.select("v", F.col("rank").alias("prev")).join(after.select("v", F.col("rank").alias("new")), "v")
    return both.agg(F.coalesce(F.sum(F.abs(F.col("new") - F.col("prev"))), F.lit(0.0)).alias("diff"))
