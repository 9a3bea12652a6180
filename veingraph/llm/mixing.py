"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import cut, let, small, table

#: Largest mean of one draw; a larger mean is a sum of draws.
MAX_MEAN = 30.0
#: One draw's counts stay far below this, as its mean does not exceed MAX_MEAN.
MAX_COUNT = 120
SEED = "mix-1"
TEMPERATURE = 0.5


def uniform(seed: str, *keys: Column) -> Column:
    """A hash-seeded uniform in (0, 1): 52 bits of an MD5 digest, the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def poisson_count(mean: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) >= u for X ~ Poisson(mean), for means up to MAX_MEAN.

    The mass beyond the walk's end is far under the resolution of the 52-bit uniform.
    """
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n")
    )

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.when(acc["cdf"] >= u, acc).otherwise(
            F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), k.alias("n"))
        )

    last = F.ceil(mean + 12 * F.sqrt(mean) + 16).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["n"])


def repeat_count(mean: Column, seed: str, doc_id: Column) -> Column:
    """A Poisson count of any mean: one draw up to MAX_MEAN, else the sum of independent draws of equal smaller means."""
    parts = F.ceil(mean / MAX_MEAN).cast("int")

    def draw(total: Column, part: Column) -> Column:
        return total + let(uniform(f"{seed}/part", doc_id, part), lambda u: poisson_count(mean / parts, u))

    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), draw)
    return F.when(mean <= MAX_MEAN, poisson_count(mean, uniform(seed, doc_id))).otherwise(many)


def source_means(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n_docs, mean): each source's mean repetition rate.

    ``weights`` fixes target shares of the output's documents (a missing source gets 0); without it
    a source's share is proportional to its size to the power ``temperature``. The expected size of
    the output is that of the input, however large the mean of a small source has to be.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(share)
    shared = cut(sizes.withColumn("share", share))
    total, mass = shared.agg(F.sum("n_docs"), F.sum("share")).first()
    if not total or not mass:
        return shared.select("source", "n_docs", F.lit(0.0).alias("mean"))
    mean = F.col("share") * (float(total) / float(mass)) / F.col("n_docs")
    return shared.select("source", "n_docs", mean.alias("mean"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: str = SEED
) -> DataFrame:
    """Repeats each document Poisson-many times and shuffles the copies globally.

    Adds ``copy`` (0, 1, ... within a document) and ``mix_key``, a hash by which the output is
    partitioned and sorted: where each copy lands is a random permutation of all copies, the same on every run.
    All input columns stay (columns named ``copy`` or ``mix_key`` are replaced).
    A null source is a source of its own; rows that repeat a doc_id get the same count; an empty table gives none. Texts
    are carried along unread, so their lengths do not matter.
    """
    means = small(source_means(docs, weights, temperature).select(F.col("source").alias("_vg_source"), F.col("mean").alias("_vg_mean")))
    repeats = repeat_count(F.col("_vg_mean"), seed, F.col("doc_id"))
    copies = (
        docs.drop("copy", "mix_key")
        .join(means, docs["source"].eqNullSafe(F.col("_vg_source")))
        .withColumn("_vg_n", repeats)
        .filter("_vg_n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_vg_n") - 1)))
        .withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}/order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
        .drop("_vg_source", "_vg_mean", "_vg_n")
    )
    return copies.repartition("mix_key").sortWithinPartitions("mix_key", "doc_id")


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to shares that follow the square root of each source's size, with their copies' order."""
    return mix(table(spark, sf_dir, "documents"))


def mixing_sql() -> str:
    """The same rows in SQL: counts by a lateral search over k for every draw, hashes by MD5."""
    uniform_of = lambda key: f"(('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / {float(2**52)}"
    doc = "coalesce(doc_id::VARCHAR, '')"
    return f"""
WITH sizes AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
means AS (
  SELECT source, pow(n_docs::DOUBLE, {TEMPERATURE}) * ((SELECT sum(n_docs) FROM sizes)::DOUBLE
    / (SELECT sum(pow(n_docs::DOUBLE, {TEMPERATURE})) FROM sizes)) / n_docs AS mean FROM sizes),
parts AS (SELECT source, ceil(mean / {MAX_MEAN})::INTEGER AS parts, mean / ceil(mean / {MAX_MEAN}) AS mean FROM means),
numbered AS (SELECT *, row_number() OVER () AS row_no FROM documents),
draws AS (
  SELECT row_no, d.source, CASE WHEN parts = 1 THEN {uniform_of(f"'{SEED}|' || {doc}")}
    ELSE {uniform_of(f"'{SEED}/part|' || {doc} || '|' || p.part")} END AS u
  FROM numbered d JOIN parts m ON d.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(1, parts + 1)) AS part) p),
cdf AS (
  SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM parts, range(0, {MAX_COUNT}) r(k)),
drawn AS (SELECT row_no, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf < d.u) AS k FROM draws d),
counted AS (SELECT row_no, sum(k)::BIGINT AS n FROM drawn GROUP BY row_no)
SELECT doc_id, text, lang, source, n_chars, c.copy::INTEGER AS copy,
  md5('{SEED}/order|' || {doc} || '|' || c.copy::VARCHAR) AS mix_key
FROM numbered JOIN counted USING (row_no), LATERAL (SELECT unnest(range(0, n)) AS copy) c
"""
