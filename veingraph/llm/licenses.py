"""License scans: diagonal voting of word k-grams against license templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import cut, let, plain_words, row_key, small, table
from veingraph.llm.license_texts import NOTICES, TEXTS

#: Phrases whose consecutive words give a label at once.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (*NOTICES, *TEXTS)
GRAM = 3
#: Diagonals at most so far apart are one span: a few words put in or left out move a match to a neighbour.
DRIFT = 2
#: A template is found if its matching words, in order, cover this share of it.
MIN_SHARE = 0.8


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """(gram, tpl, label, tpl_pos, tpl_words): rolling k-gram hashes of all templates, a template of fewer words having none."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "tpl int, label string, text string")
    words = rows.select("tpl", "label", plain_words(F.col("text")).alias("tpl_words"))
    return words.filter(F.size("tpl_words") >= gram).select(
        "tpl", "label", "tpl_words", F.posexplode(_grams(F.col("tpl_words"), gram)).alias("tpl_pos", "gram")
    )


def _grams(words: Column, gram: int) -> Column:
    rolling = lambda ids: F.transform(F.sequence(F.lit(1), F.size(ids) - (gram - 1)), lambda i: F.xxhash64(F.slice(ids, i, gram)))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), rolling)
    return F.when(F.size(words) >= gram, hashes).otherwise(F.array().cast("array<bigint>"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively; texts without it are told by one search."""
    parts = phrase.split(" ")
    n = len(parts)

    def stands(i: Column) -> Column:
        condition = F.get(words, i) == parts[0]
        for k in range(1, n):
            condition = condition & (F.get(words, i + k) == parts[k])
        return condition

    held = F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {phrase} "))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - n), stands)
    return F.when(held, places).otherwise(F.array().cast("array<int>"))


def labelled_places(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def in_order(words: Column, start: Column, end: Column, tpl_words: Column) -> Column:
    """How many template words the document's words from ``start`` to ``end`` hold in order, greedily."""
    span = F.slice(words, start + 1, end - start)
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(acc: Column, t: Column) -> Column:
        found = F.array_position(F.slice(span, acc["at"] + 1, F.lit(2 * DRIFT + GRAM)), t).cast("int")
        return F.when(found > 0, F.struct((acc["n"] + 1).alias("n"), (acc["at"] + found).alias("at"))).otherwise(acc)

    return F.aggregate(tpl_words, first, step, lambda acc: acc["n"])


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES,
    gram: int = GRAM, drift: int = DRIFT, min_share: float = MIN_SHARE,
) -> DataFrame:
    """``docs`` (doc_id, text) with ``n_words``, ``places`` (at, label of each phrase) and ``spans`` (label, start, end, share).

    Rolling k-gram hashes of every whole text are joined to the template positions that they stand at; each match
    votes for the diagonal (document position - template position); neighbouring diagonals of one place are merged
    to a span, which is verified against the template's words. Only matches are shuffled, and a document's matches
    of one place are combined before. Null and empty texts have no words; repeated rows have the same result each; a
    text of any length is scanned whole, its words being one row. Only the templates, a list of fixed texts, are sent to
    the executors unchecked.
    """
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_vg_key"), plain_words(F.col("text")).alias("w"))
    known = template_grams(docs.sparkSession, templates, gram)
    votes = (
        keyed.select("_vg_key", F.posexplode(_grams(F.col("w"), gram)).alias("pos", "gram"))
        .join(F.broadcast(known.select("gram", "tpl", "tpl_pos")), "gram")
        .groupBy("_vg_key", "tpl", (F.col("pos") - F.col("tpl_pos")).alias("at"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )

    def merged(acc: Column, d: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (d["at"] - F.get(acc, F.size(acc) - 1)["last"] <= drift)
        grown = F.struct(last["first"].alias("first"), d["at"].alias("last"), (last["votes"] + d["votes"]).alias("votes"))
        own = F.struct(d["at"].alias("first"), d["at"].alias("last"), d["votes"].alias("votes"))
        return F.when(near, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(own)))

    empty = F.array().cast("array<struct<first:int,last:int,votes:bigint>>")
    diagonals = (
        votes.groupBy("_vg_key", "tpl")
        .agg(F.array_sort(F.collect_list(F.struct("at", "votes"))).alias("by"))
        .join(F.broadcast(known.select("tpl", "label", "tpl_words").distinct()), "tpl")
        .withColumn("run", F.explode(F.aggregate("by", empty, merged)))
        # A gram that goes wrong takes up to GRAM votes, so a template of min_share has at least this many left.
        .filter(F.col("run.votes") >= F.greatest(F.lit(1), F.size("tpl_words") * (1 - gram * (1 - min_share)) - gram + 1))
    )
    candidates = cut(
        diagonals.groupBy("_vg_key").agg(F.collect_list(F.struct("label", "tpl_words", "run.first", "run.last")).alias("_vg_candidates"))
    )

    def verified(w: Column) -> Column:
        def span(c: Column) -> Column:
            start = F.greatest(F.lit(0), c["first"])
            end = F.least(F.size(w), c["last"] + F.size(c["tpl_words"]) + drift)
            share = in_order(w, start, end, c["tpl_words"]) / F.size(c["tpl_words"])
            return F.struct(c["label"].alias("label"), start.alias("start"), end.alias("end"), share.alias("share"))

        spans = F.filter(F.transform(F.col("_vg_candidates"), span), lambda s: s["share"] >= min_share)
        places = [labelled_places(phrase_starts(w, phrase), label) for phrase, label in phrases]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.concat(*places) if places else F.array().cast("array<struct<at:int,label:string>>")).alias("places"),
            F.coalesce(spans, F.array().cast("array<struct<label:string,start:int,end:int,share:double>>")).alias("spans"),
        )

    base = docs.withColumn("_vg_key", row_key(F.col("doc_id"), F.col("text")))
    return (
        base.join(small(candidates), "_vg_key", "left")
        .withColumn("_vg_found", let(plain_words(F.col("text")), verified))
        .withColumns({k: F.col(f"_vg_found.{k}") for k in ("n_words", "places", "spans")})
        .drop("_vg_key", "_vg_candidates", "_vg_found")
    )


def op10_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's base phrases and verified license templates."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("spans", lambda s: s["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("places", lambda p: p["at"])
    shares = F.array_max(F.transform("spans", lambda s: s["share"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(every).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(shares, F.lit(0.0))).alias("score"),
    )
