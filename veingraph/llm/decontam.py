"""Benchmark decontamination by a positional inverted index over the training documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import cut, let, plain_words, row_key, small, table

WINDOW = 10
#: How far the distance of two terms may differ from that in the item for a proximity match.
SLACK = 3


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, terms, items): every distinct window of the items' words, with the items that hold it.

    An item of fewer words than ``window``, but not none, is one window; null and empty texts have none.
    ``win`` is the window's text.
    """
    words = benchmark.select("item_id", plain_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.greatest(F.size("w") - (window - 1), F.lit(1))
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(F.col("w"), i, window))
    return (
        words.select("item_id", F.explode(F.array_distinct(terms)).alias("terms"))
        .groupBy(F.array_join("terms", " ").alias("win"))
        .agg(F.first("terms").alias("terms"), F.collect_set("item_id").alias("items"))
    )


def document_frequencies(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, tf): occurrences in the ``w`` arrays of all documents of each vocabulary term that occurs at all."""
    return words.select(F.explode("w").alias("term")).join(small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def postings(words: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index of ``terms``: (term, _vg_key, pos), written to the checkpoint folder."""
    return cut(words.select("_vg_key", F.posexplode("w").alias("pos", "term")).join(small(terms), "term").select("term", "_vg_key", "pos"))


def rarest_terms(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Each window's rarest and second rarest places: (win, t1, o1, t2, o2), offsets from 0; ties go to the left.

    A window with a term that no document holds cannot occur and goes; a window of one word has its place twice.
    """
    placed = windows.select("win", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term")).join(small(frequencies), "term")
    ranked = placed.groupBy("win", "n").agg(F.array_sort(F.collect_list(F.struct("tf", "off", "term"))).alias("by"))
    second = F.coalesce(F.get("by", F.lit(1)), F.col("by")[0])
    return ranked.filter(F.size("by") == F.col("n")).select(
        "win", F.col("by")[0]["term"].alias("t1"), F.col("by")[0]["off"].alias("o1"), second["term"].alias("t2"), second["off"].alias("o2")
    )


def covered(spans: Column) -> Column:
    """The number of places in the union of (at, len) spans, sorted by ``at``."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(acc["end"], s["at"]))).alias("n"),
        F.greatest(acc["end"], s["at"] + s["len"]).alias("end"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def near_places(index: DataFrame, pivots: DataFrame, slack: int) -> DataFrame:
    """(win, _vg_key, at): places of a window's rarest term that its second rarest stands near to, as in the item.

    Positions meet in blocks of the tolerated width, so that the join stays an equi-join.
    """
    first = index.join(small(pivots), F.col("term") == F.col("t1")).select("win", "_vg_key", F.col("pos").alias("at"), "t2", (F.col("pos") + F.col("o2") - F.col("o1") - slack).alias("lo"))
    block = lambda c: F.floor(c / (2 * slack + 1)).cast("int")
    near = first.withColumn("block", F.explode(F.array(block(F.col("lo")), block(F.col("lo")) + 1)))
    seconds = index.select(F.col("term").alias("t2"), "_vg_key", F.col("pos").alias("at2"), block(F.col("pos")).alias("block"))
    met = near.join(seconds, ["t2", "_vg_key", "block"]).filter(F.col("at2").between(F.col("lo"), F.col("lo") + 2 * slack))
    return met.select("win", "_vg_key", "at").distinct()


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """``docs`` (all columns) with ``n_words``, ``hits`` (exact occurrences: at, len, items), ``n_hit``.

    With ``slack`` also ``n_near``: places where a window's two rarest terms stand as far from each other as in the item,
    up to so many words more or less.

    1. Term frequencies of the benchmark's vocabulary over all documents.
    2. Positional postings of the two rarest terms of every window.
    3. The rarest term's list, offset-adjusted to window starts, is intersected with the second rarest's.
    4. What is left is verified word by word in the document.
    Rows that repeat a document are matched each; a null or empty text has no words; without items nothing matches. A
    text of any length is searched whole; its words are one row's array, so they must fit a task's memory.
    """
    keyed = docs.withColumn("_vg_key", row_key(F.col("doc_id"), F.col("text")))
    words = keyed.select("_vg_key", plain_words(F.col("text")).alias("w"))
    windows = cut(benchmark_windows(benchmark, window))
    vocabulary = cut(windows.select(F.explode("terms").alias("term")).distinct())
    pivots = cut(rarest_terms(windows, cut(document_frequencies(words, vocabulary))))
    terms = pivots.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    index = postings(words, cut(terms))
    starts = index.join(small(pivots), F.col("term") == F.col("t1")).select("win", "_vg_key", (F.col("pos") - F.col("o1")).alias("at"), "t2", "o2").filter("at >= 0")
    seconds = index.select(F.col("term").alias("t2"), "_vg_key", "pos")
    both = starts.withColumn("pos", F.col("at") + F.col("o2")).join(seconds, ["t2", "_vg_key", "pos"]).select("win", "_vg_key", "at").distinct()
    found = both.join(small(windows), "win").groupBy("_vg_key").agg(F.collect_list(F.struct("at", "terms", "items")).alias("_vg_found"))

    def verified(w: Column) -> Column:
        true = F.filter(F.col("_vg_found"), lambda c: F.slice(w, c["at"] + 1, F.size(c["terms"])) == c["terms"])
        spans = F.transform(true, lambda c: F.struct(c["at"].alias("at"), F.size(c["terms"]).alias("len"), c["items"].alias("items")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.array_sort(spans).alias("hits"))

    matched = keyed.join(cut(found), "_vg_key", "left").withColumn("_vg_found", F.coalesce("_vg_found", F.array()))
    if slack is not None:
        near = near_places(index, pivots, slack).groupBy("_vg_key").agg(F.count(F.lit(1)).alias("n_near"))
        matched = matched.drop("n_near").join(small(cut(near)), "_vg_key", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    return (
        matched.withColumn("_vg_match", let(plain_words(F.col("text")), verified))
        .withColumns({"n_words": F.col("_vg_match.n_words"), "hits": F.col("_vg_match.hits")})
        .withColumn("n_hit", covered(F.col("hits")).cast("long"))
        .drop("_vg_key", "_vg_found", "_vg_match")
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, at): places where a window's two rarest terms stand near each other.

    Their distance may differ from that in the item by up to ``slack`` words; ``at`` is the rarest term's place.
    """
    keyed = docs.withColumn("_vg_key", row_key(F.col("doc_id"), F.col("text")))
    words = keyed.select("_vg_key", plain_words(F.col("text")).alias("w"))
    windows = cut(benchmark_windows(benchmark, window))
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    pivots = cut(rarest_terms(windows, document_frequencies(words, vocabulary)))
    index = postings(words, pivots.select(F.explode(F.array("t1", "t2")).alias("term")).distinct())
    return near_places(index, pivots, slack).join(windows, "win").select(F.col("_vg_key.id").alias("doc_id"), F.explode("items").alias("item_id"), "at").distinct()


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words hit by benchmark windows, the items that occur in it, and its proximity matches."""
    found = phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=SLACK)
    items = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))
    return found.select("doc_id", "n_words", "n_hit", "n_near", items.alias("items")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def decontam_sql() -> str:
    """The same rows in SQL, every document window being looked up among the items' windows."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(string_split_regex({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda t: t <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[r.i:r.i + {WINDOW} - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i) r WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, r.i AS i, array_to_string(w[r.i:r.i + n - 1], ' ') AS win
  FROM d, lens, LATERAL (SELECT unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i) r),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
wins AS (SELECT DISTINCT w[r.i:r.i + {WINDOW} - 1] AS terms
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i) r WHERE len(w) > 0),
tf AS (SELECT term, count(*) AS tf FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
ranked AS (SELECT terms, list(struct_pack(o := off, t := term) ORDER BY tf, off) AS rarest
  FROM (SELECT terms, unnest(terms) AS term, unnest(range(0, len(terms))) AS off FROM wins) JOIN tf USING (term)
  GROUP BY terms HAVING count(*) = len(terms)),
pivots AS (SELECT terms, rarest[1] AS a, coalesce(rarest[2], rarest[1]) AS b FROM ranked),
spots AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
near AS (SELECT x.doc_id, count(DISTINCT (terms, x.pos)) AS n_near FROM pivots JOIN spots x ON x.term = a.t JOIN spots y
  ON y.term = b.t AND y.doc_id = x.doc_id AND y.pos BETWEEN x.pos + b.o - a.o - {SLACK} AND x.pos + b.o - a.o + {SLACK} GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""
