"""Graph diffusion of a score from one vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.plans.iteration import Held, fetch, numbered, slices, small
from veingraph.sources.triples import undirected


def graph_diffusion(
    triples: DataFrame, start: str, score: float = 100.0, edge_weight: float = 0.95, max_iterations: int = 5, variant: str = "standard"
) -> DataFrame:
    """(vertex, score), highest first, after exactly ``max_iterations`` rounds (1 at least).

    In a round every scored vertex gives score * edge_weight to each neighbour, over any predicate and both ways; a
    vertex's new score is what it gets, divided by the number of all gifts; old scores are dropped. ``paper`` does not
    divide; ``beta`` counts equal gifts to a vertex once.
    """
    if max_iterations < 1:
        raise ValueError("max_iterations is 1 at least")
    if variant not in ("standard", "paper", "beta"):
        raise ValueError(f"unknown variant {variant!r}")
    spark = triples.sparkSession
    held = Held(spark)
    first = spark.createDataFrame([(start,)], "v string")
    names, edges = numbered(held, triples.select("s", "o"), (start,))
    most = 2 * edges.count()
    both = undirected(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("s"), F.col("dst").alias("o"))).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    state = names.vertices(first).withColumn("score", F.lit(float(score)))
    for _ in range(max_iterations):
        scored = state.withColumnRenamed("v", "src")
        giving = small(scored)
        # Only gifts are shuffled if few vertices give, so slices are sized by these: a count costs one scan, a slice too many as well.
        rows = most if giving is scored or slices(most) == 1 else fetch(both.join(giving, "src").agg(F.count(F.lit(1))))[0][0]

        def one(within):
            gifts = both.filter(within("dst")).join(giving, "src").select(F.col("dst").alias("v"), (F.col("score") * edge_weight).alias("gift"))
            if variant == "beta":
                gifts = gifts.distinct()
            return gifts.groupBy("v").agg(F.sum("gift").alias("score"), F.count(F.lit(1)).alias("n"))

        got = held.sliced(slices(rows), one)
        total = 1 if variant == "paper" else got.agg(F.sum("n")).first()[0] or 1
        state = got.select("v", (F.col("score") / float(total)).alias("score"))
    held.drop(edges)
    return names.terms(state).select(F.col("v").alias("vertex"), "score").orderBy(F.desc("score"), "vertex")
