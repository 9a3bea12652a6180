"""Peer-pressure clustering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import CONNECTED
from veingraph.plans.iteration import Held, numbered, slices
from veingraph.sources.triples import undirected


@dataclass(frozen=True)
class Clusters:
    """``labels``: (node, label); ``changed``: how many labels each round changed."""

    labels: DataFrame
    changed: list[int]


def peer_pressure(
    triples: DataFrame, max_iterations: int = 10, predicate: str | None = CONNECTED, vote_predicate: str | None = None,
    percent_threshold: float = 0.0, vertices_threshold: int = 0,
) -> Clusters:
    """Each vertex of ``predicate`` takes the label that most of its neighbours hold, all at once, from its own.

    Votes come over any predicate (or ``vote_predicate``) and both ways, an edge of each counting; ties go to the smallest
    label. It stops when no more than ``max(vertices_threshold, percent_threshold * N)`` labels change.
    """
    held = Held(triples.sparkSession)
    among = triples if None in (predicate, vote_predicate) else triples.filter(F.col("p").isin(predicate, vote_predicate))
    has = lambda p: F.lit(True) if p is None else F.col("p") == p
    names, coded = numbered(held, among.select("s", "o", has(predicate).alias("inside"), has(vote_predicate).alias("votes")))
    rows = 2 * coded.count()
    ends = coded.filter("inside").select(F.explode(F.array("src", "dst")).alias("v")).filter("v IS NOT NULL")
    state = held.sliced(slices(rows), lambda within: ends.filter(within("v")).distinct().select("v", F.col("v").alias("label")))
    n = state.count()
    voting = coded.filter("votes AND src IS NOT NULL AND dst IS NOT NULL")
    both = undirected(voting.select(F.col("src").alias("s"), F.col("dst").alias("o"))).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    edges = held.by(both, "src", rows, lambda d: d.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")))
    held.drop(coded)
    changed: list[int] = []
    while len(changed) < max_iterations:
        before = state

        def one(slice_):
            own = before.select("v", "label").filter(slice_("v"))
            held_by = before.select(F.col("v").alias("src"), "label").hint("shuffle_hash")
            votes = edges.filter(slice_("dst")).join(held_by, "src").groupBy(F.col("dst").alias("v"), "label").agg(F.sum("k").alias("votes"))
            # The least struct is the one of most votes, then of the smallest label; minima are combined before the shuffle.
            won = votes.groupBy("v").agg(F.min(F.struct((-F.col("votes")).alias("least"), "label")).alias("w")).select("v", F.col("w.label").alias("new"))
            return own.join(won, "v", "left").select("v", F.coalesce("new", "label").alias("label"), F.col("label").alias("old"))

        state = held.sliced(slices(rows), one)
        held.drop(before)
        changed.append(state.filter("label <> old").count())
        if changed[-1] <= max(vertices_threshold, percent_threshold * n):
            break
    held.drop(edges)
    labels = names.terms(names.terms(state.select("v", "label")), "label")
    return Clusters(labels.select(F.col("v").alias("node"), "label"), changed)
