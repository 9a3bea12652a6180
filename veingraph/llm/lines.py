"""Line dedup by a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import BLANKS, cut, let, row_key, salted, small, split_words, table

#: Leading tokens that a line's path through the tree spells out.
DEPTH = 6
#: A line is of its leaf's template if so many of ten of its tokens are those of the template.
AGREEMENT = 8
#: A template recurs if so many documents hold it.
MIN_DOCS = 3
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens between white space; one with a digit is a variable field."""
    tokens = split_words(line, BLANKS)
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))).otherwise(tokens)


def _named(tokens: Column, n: Column) -> Column:
    """64 bits of a digest, the same on every engine."""
    return F.substring(F.md5(F.concat_ws(" ", n.cast("string"), F.array_join(tokens, " "))), 1, 16)


def pattern(tokens: Column) -> Column:
    """The name of a line's masked tokens; null for a line of variable fields alone, or of none."""
    return F.when(F.exists(tokens, lambda t: t != FIELD), _named(tokens, F.size(tokens)))


def leaf(tokens: Column, depth: int = DEPTH) -> Column:
    """The name of the token count and the first ``depth`` masked tokens."""
    return _named(F.slice(tokens, 1, depth), F.size(tokens))


def line_patterns(keyed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(_vg_key, leaf, pattern) of the different lines of each row of ``keyed`` (_vg_key, text), as a table of its own."""
    names = lambda x: let(masked(x), lambda w: F.struct(leaf(w, depth).alias("leaf"), pattern(w).alias("pattern")))
    held = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), names), lambda s: s["pattern"].isNotNull()))
    return cut(keyed.select("_vg_key", F.explode(held).alias("l")).select("_vg_key", "l.leaf", "l.pattern"))


def merged_patterns(keyed: DataFrame, held: DataFrame, depth: int = DEPTH, agreement: int = AGREEMENT) -> DataFrame:
    """(leaf, pattern, template) of the patterns that are of their leaf's template.

    A leaf's template is the pattern that most rows hold (the least name of equals); every other pattern of the leaf
    that agrees with it in ``agreement`` of ten tokens or more is of it, and what differs is a variable field. Only
    leaves of several patterns are looked at, one line for each of their patterns.
    """
    counts = held.groupBy("leaf", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("_vg_key").alias("_vg_key"))
    by_leaf = counts.groupBy("leaf").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "pattern")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")
    )
    seeds = cut(by_leaf.filter(f"kinds > 1 AND n >= {MIN_DOCS}").select("leaf", F.col("top.pattern").alias("template")))
    chosen = cut(counts.join(small(seeds), "leaf").select("_vg_key", "leaf", "pattern", "template"))
    wanted = chosen.groupBy("_vg_key").agg(F.collect_set("pattern").alias("wanted"))
    lines = keyed.join(small(cut(wanted)), "_vg_key").select("wanted", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    tokens = lines.select("wanted", masked(F.col("line")).alias("tokens")).withColumn("pattern", pattern(F.col("tokens")))
    bodies = tokens.filter(F.array_contains("wanted", F.col("pattern"))).select("pattern", "tokens").dropDuplicates(["pattern"])
    known = cut(chosen.join(bodies, "pattern").select("leaf", "pattern", "template", "tokens"))
    heads = known.filter("pattern = template").select("leaf", F.col("tokens").alias("head"))
    same = F.size(F.filter(F.zip_with("tokens", "head", lambda a, b: a == b), lambda x: x))
    return known.filter("pattern <> template").join(small(heads), "leaf").filter(10 * same >= agreement * F.size("tokens")).select("leaf", "pattern", "template")


def dedup_lines(docs: DataFrame, depth: int = DEPTH, agreement: int = AGREEMENT, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from ``text``, and ``n_lines``, ``n_dropped`` added.

    Lines go down a tree by their token count and first ``depth`` tokens to a leaf; tokens with digits are variable
    fields. In a leaf, lines are of one template if they agree in ``agreement`` of ten tokens or more with its commonest
    line; others are templates of their own. A template recurs if ``min_docs`` documents hold it, however often each
    repeats it; rows that are equal in id and text are one document.

    The first document (smallest doc_id) of a template keeps its lines; with ties in doc_id all of them keep theirs. A
    null text stays null (0 lines); an empty text has one line. Lines without tokens, or of variable fields alone, have
    no template and stay. Rows of null doc_id are never first unless all are. Columns of the added names are replaced. A
    long text is one row throughout: its lines' names, not the lines, are shuffled.
    """
    keyed = docs.withColumn("_vg_key", row_key(F.col("doc_id"), F.col("text")))
    texts = keyed.select("_vg_key", "text")
    held = line_patterns(texts, depth)
    merged = cut(merged_patterns(texts, held, depth, agreement))
    named = salted(held, merged.select("pattern", "template"), "pattern", "_vg_key", "left").select("_vg_key", "pattern", F.coalesce("template", "pattern").alias("template"))
    rows_of = named.groupBy("template", "_vg_key").agg(F.lit(1).alias("one"))
    recurring = cut(
        rows_of.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("_vg_key.id").alias("first_doc")).filter(F.col("n_docs") >= min_docs)
    )
    drop = (
        salted(named, recurring.select("template", "first_doc"), "template", "_vg_key")
        .filter(~F.col("_vg_key.id").eqNullSafe(F.col("first_doc")))
        .groupBy("_vg_key")
        .agg(F.collect_set("pattern").alias("_vg_drop"))
    )
    lines = F.split("text", "\n")
    keep = lambda x: ~F.coalesce(F.array_contains(F.col("_vg_drop"), let(masked(x), pattern)), F.lit(False))
    kept = F.when(F.col("_vg_drop").isNull(), lines).otherwise(F.filter(lines, keep))
    return (
        keyed.join(drop, "_vg_key", "left")
        .withColumn("_vg_kept", kept)
        .withColumns(
            {
                "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
                "n_dropped": F.coalesce(F.size(lines) - F.size("_vg_kept"), F.lit(0)).cast("long"),
                "text": F.array_join("_vg_kept", "\n"),
            }
        )
        .drop("_vg_key", "_vg_drop", "_vg_kept")
    )


def op9_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates: what is left of each text, with line counts."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def lines_sql() -> str:
    """The same rows in SQL, documents being told apart by their ids."""
    name = lambda tokens: f"substr(md5(len(w) || ' ' || array_to_string({tokens}, ' ')), 1, 16)"
    return rf"""
WITH lines AS (
  SELECT d.doc_id, r.i, d.ls[r.i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) r),
tokens AS (
  SELECT doc_id, i, line, list_transform(list_filter(regexp_split_to_array(line, '[ \x09-\x0D]+'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END) AS w FROM lines),
named AS (
  SELECT doc_id, i, line, w, {name(f"w[1:{DEPTH}]")} AS leaf,
    CASE WHEN len(list_filter(w, lambda t: t <> '{FIELD}')) > 0 THEN {name("w")} END AS pattern FROM tokens),
counts AS (SELECT leaf, pattern, count(DISTINCT doc_id) AS n, min(w) AS w FROM named WHERE pattern IS NOT NULL GROUP BY ALL),
tops AS (SELECT leaf, pattern AS top, w AS head FROM counts QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n DESC, pattern) = 1),
templates AS (
  SELECT leaf, pattern, CASE WHEN 10 * len(list_filter(range(1, len(w) + 1), lambda k: w[k] = head[k])) >= {AGREEMENT} * len(w)
    THEN top ELSE pattern END AS template FROM counts JOIN tops USING (leaf)),
held AS (SELECT doc_id, i, line, template FROM named LEFT JOIN templates USING (leaf, pattern)),
recurring AS (
  SELECT template, min(doc_id) AS first_doc FROM held WHERE template IS NOT NULL
  GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT h.doc_id, count(*) AS n_lines, count(*) FILTER (r.first_doc <> h.doc_id) AS n_dropped,
  coalesce(string_agg(h.line, chr(10) ORDER BY h.i) FILTER (r.first_doc IS NULL OR r.first_doc = h.doc_id), '') AS text
FROM held h LEFT JOIN recurring r USING (template) GROUP BY h.doc_id
"""
