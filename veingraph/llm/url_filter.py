"""URL filtering: host and path rules first, then a ratio of character language models."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import UPPER, let, table

#: (verdict, rule) in the notation host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Characters that the models tell apart; digits share one class, all others another.
ALPHABET = "abcdefghijklmnopqrstuvwxyz./-_?=&#:%~+@"
DIGIT, OTHER, START = "0", "*", "^"
SYMBOLS = START + ALPHABET + DIGIT + OTHER
ORDER = 2
CLASSES = len(SYMBOLS)
#: Every (context, character) key lies below this, which bounds the model's size whatever the corpus is.
MODEL_ROWS = CLASSES ** (ORDER + 1)
BINS = 400
SPAN = 4.0


@dataclass(frozen=True)
class UrlModel:
    """``scores``: the log-likelihood ratio of each gram by its code; a URL is allowed if its mean ratio reaches ``threshold``."""

    scores: tuple[float, ...]
    threshold: float


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host equal or a subdomain, path starting alike) and its verdict; else nulls."""
    rule = verdict = None
    for outcome, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, _, rest = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(outcome)) if verdict is None else verdict.when(fits, F.lit(outcome))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def _codes(url: Column) -> Column:
    """The code of each character of the URL after its scheme with its ORDER predecessors; none for a null or empty one.

    Characters are told apart in SYMBOLS; start marks stand before the first one. Codes are below ``MODEL_ROWS``.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"(?s)\A.*?://", "")
    known = F.regexp_replace(F.regexp_replace(bare, "[0-9]", DIGIT), rf"(?s)[^{DIGIT}a-z./\-_?=&#:%~+@]", OTHER)
    ranks = F.transform(F.split(F.concat(F.lit(START * ORDER), known), ""), lambda c: F.call_function("instr", F.lit(SYMBOLS), c) - 1)

    def coded(r: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: i >= ORDER)
        code = lambda i: reduce(lambda acc, k: acc * CLASSES + F.get(r, i - (ORDER - k)), range(1, ORDER + 1), F.get(r, i - ORDER))
        return F.transform(ends, code)

    return let(F.filter(ranks, lambda r: r >= 0), coded)


def gram_scores(counts: dict[int, tuple[int, int]]) -> tuple[float, ...]:
    """The log-likelihood ratio of every gram by its code, from each gram's counts (accepted, rejected).

    Interpolated (Witten-Bell) models of orders 0 to ``ORDER``: a context that was seen n times with t distinct
    followers gives weight n/(n+t) to its own frequencies and t/(n+t) to the shorter context's.
    """
    sides = []
    for side in (0, 1):
        p = [1.0 / (CLASSES - 1)] * CLASSES
        for order in range(ORDER + 1):
            size = CLASSES ** (order + 1)
            seen = [0] * size
            for code, n in counts.items():
                seen[code % size] += n[side]
            shorter, p = p, []
            for context in range(0, size, CLASSES):
                row = seen[context : context + CLASSES]
                n, t = sum(row), sum(x > 0 for x in row)
                back = shorter[context % (size // CLASSES) :][:CLASSES] if order else shorter
                p += [(x + t * q) / (n + t) for x, q in zip(row, back)] if n else back
        sides.append(p)
    return tuple(round(math.log(a / b), 5) for a, b in zip(*sides))


def best_threshold(bins: dict[int, tuple[int, int]]) -> float:
    """The bin edge of the highest balanced accuracy for counts (accepted, rejected) by bin; 0 unless both occur."""
    good, bad = (sum(b[i] for b in bins.values()) for i in (0, 1))
    if not good or not bad:
        return 0.0
    best, threshold, passed = -1.0, 0.0, [good, bad]
    for i in range(BINS):
        accuracy = passed[0] / good + (bad - passed[1]) / bad
        if accuracy > best + 1e-12:
            best, threshold = accuracy, i * (2 * SPAN / BINS) - SPAN
        g, b = bins.get(i, (0, 0))
        passed = [passed[0] - g, passed[1] - b]
    return threshold


def fit_url_model(labelled: DataFrame) -> UrlModel:
    """Fits both models on four fifths of ``labelled`` (``_url``, ``verdict``) and calibrates the threshold on the others.

    The part is a checksum of the URL, so equal URLs are in one. Counts are aggregated by gram before anything is
    gathered: at most ``MODEL_ROWS`` rows, and ``BINS`` for the threshold, that of the highest balanced accuracy.
    """
    rows = labelled.select("_url", (F.col("verdict") == "allow").alias("good")).withColumn("held", F.crc32(F.encode("_url", "UTF-8")) % 5 == 0)
    taught = rows.filter(~F.col("held")).select("good", F.explode(_codes(F.col("_url"))).alias("code"))
    sides = (F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    counts = {r["code"]: (r["n_good"], r["n_bad"]) for r in taught.groupBy("code").agg(*sides).collect()}
    scores = gram_scores(counts)
    at = F.floor((score(F.col("_url"), scores) + SPAN) * (BINS / (2 * SPAN)))
    held = rows.filter("held").groupBy(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), at)).cast("int").alias("at")).agg(*sides)
    return UrlModel(scores, best_threshold({r["at"]: (r["n_good"], r["n_bad"]) for r in held.collect()}))


def score(url: Column, scores: tuple[float, ...]) -> Column:
    """The mean log-likelihood ratio per character of the URL, within the row; 0 for null and empty ones."""
    known = F.from_json(F.lit(json.dumps(scores)), "array<double>")  # a constant, which is read once
    mean = lambda codes: F.aggregate(codes, F.lit(0.0), lambda total, c: total + F.get(known, c)) / F.size(codes)
    return F.coalesce(let(_codes(url), lambda codes: F.when(F.size(codes) > 0, mean(codes))), F.lit(0.0))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages`` (page_id, url; others are ignored).

    URLs that a rule judges train the models; the models judge the others by their score against the
    calibrated threshold. Null and empty URLs have no host, no rule and score 0; repeated rows stay repeated; a URL of
    any length is scored within its row.
    """
    host, path = url_parts(F.col("_url"))
    parts = pages.select("page_id", F.col("url").alias("_url")).withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "verdict": verdict})
    model = fit_url_model(judged.filter("verdict IS NOT NULL").select("_url", "verdict"))
    own = F.when(F.col("_score") >= model.threshold, "allow").otherwise("block")
    return judged.withColumn("_score", score(F.col("_url"), model.scores)).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), F.col("_score").alias("score")
    )


def op8_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the production rules, then by the models trained on what the rules judge."""
    return filter_urls(table(spark, sf_dir, "pages"))
