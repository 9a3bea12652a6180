"""Document quality: fixed base rules, then a decision list learned from labelled documents."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import blank_words, let, table

WINDOW = 8
#: At most so many labelled documents (the smallest hashes of their ids) are gathered for learning.
MAX_LABELLED = 8_000
MAX_RULES = 8
MAX_CONDITIONS = 4
#: Candidate thresholds for a feature: middles between neighbouring values, at quantiles of what a growing rule covers.
THRESHOLDS = 32
#: A rule stays if this share of the held-out documents that it covers are bad ones.
MIN_PRECISION = 0.9
MIN_COVER = 3

#: Shares that do not depend on a text's language or length: a rule on word lengths would turn languages away.
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "run_share", "upper_share", "mark_share")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of ``window`` words that the array holds twice or more.

    Windows are told apart by 64-bit hashes of their words' hashes, within one document.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twin = lambda e, j: F.get(s, j - 1)["h"].eqNullSafe(e["h"]) | F.get(s, j + 1)["h"].eqNullSafe(e["h"])
            return F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"]))

        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda acc, i: F.struct(
            (acc["n"] + i + window - F.greatest(acc["end"], i)).alias("n"), (i + window).alias("end")
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            F.aggregate(let(by_hash, marked), none, add, lambda acc: acc["n"])
        )

    def windows(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ids) - (window - 1)), lambda i: F.xxhash64(F.slice(ids, i, window)))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """Adds the base statistics and ``FEATURES`` of each row's whole ``text``; a null text counts as empty.

    Input columns of the same names are replaced. Everything is computed within the row, without a shuffle, over the
    whole text, however long; its words are one row's array, so they must fit a task's memory.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", ""))
    n_lines_distinct = lambda lines: F.struct(
        F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup")
    )
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), n_lines_distinct)
    counts = let(
        blank_words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).alias("n_run"),
        ),
    )
    stats = docs.withColumns({"_vg_lines": lines, "_vg_counts": counts, "_vg_upper": only("A-Z"), "_vg_marks": only("!?;:,.")})
    stats = stats.withColumns(
        {
            "n_words": F.col("_vg_counts.n_words"),
            "word_chars": (F.length(text) - only(r"\x20\x09-\x0D")).cast("long"),
            "n_symbols": only("#*$%&|<>").cast("long"),
            "n_dup_lines": F.col("_vg_lines.dup").cast("long"),
            "n_repeat_words": F.col("_vg_counts.n_repeat_words"),
        }
    )
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole).cast("double"), F.lit(0.0))
    return stats.withColumns(
        {
            "symbols_per_word": share(F.col("n_symbols"), F.col("n_words")),
            "dup_line_share": share(F.col("n_dup_lines"), F.col("_vg_lines.n")),
            "run_share": share(F.col("_vg_counts.n_run"), F.col("n_words")),
            "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
            "upper_share": share(F.col("_vg_upper"), F.col("word_chars")),
            "mark_share": share(F.col("_vg_marks"), F.col("n_words")),
        }
    ).drop("_vg_lines", "_vg_counts", "_vg_upper", "_vg_marks")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _grow(bad: list[dict], good: list[dict]) -> Rule:
    """Adds the condition of the highest information gain until no good document is covered."""
    rule: list[Condition] = []
    while good and bad and len(rule) < MAX_CONDITIONS:
        base, best = math.log2(len(bad) / (len(bad) + len(good))), (0.0, None)
        for feature in FEATURES:
            values = sorted({r[feature] for r in bad} | {r[feature] for r in good})
            gaps = range(len(values) - 1)
            steps = gaps if len(gaps) <= THRESHOLDS else [len(gaps) * i // THRESHOLDS for i in range(THRESHOLDS)]
            for threshold in [(values[i] + values[i + 1]) / 2 for i in steps]:
                p_above, n_above = sum(r[feature] > threshold for r in bad), sum(r[feature] > threshold for r in good)
                for above, p, n in ((True, p_above, n_above), (False, len(bad) - p_above, len(good) - n_above)):
                    if p >= MIN_COVER and (gain := p * (math.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                        best = gain, Condition(feature, above, threshold)
        if best[1] is None:
            break
        rule.append(best[1])
        bad, good = [r for r in bad if best[1].holds(r)], [r for r in good if best[1].holds(r)]
    return tuple(rule)


def simplified(rule: Rule) -> Rule:
    """The rule without conditions that another one on the same feature implies."""
    tightest: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        known = tightest.get((c.feature, c.above))
        if known is None or (c.threshold > known.threshold) == c.above:
            tightest[c.feature, c.above] = c
    return tuple(tightest.values())


def _worth(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[float, int]:
    p, n = sum(_covers(rule, r) for r in bad), sum(_covers(rule, r) for r in good)
    return ((p - n) / (p + n), p) if p + n else (-1.0, 0)


def learn_rules(rows: list[dict]) -> list[Rule]:
    """Sequential covering over labelled statistics (``bad`` 0/1 and ``FEATURES``): an ordered list of rules for bad ones.

    Two thirds of what is left grow a rule; one third prunes it, condition by condition as long as that makes it better
    or leaves it as good, and decides whether it stays; what it covers is taken away before the next.
    """
    rules: list[Rule] = []
    left = list(rows)
    random.Random(0).shuffle(left)  # a regular order of kinds must not meet the regular split
    while len(rules) < MAX_RULES:
        grow, held = [r for i, r in enumerate(left) if i % 3], left[::3]
        part = lambda of, bad: [r for r in of if r["bad"] == bad]
        rule = simplified(_grow(part(grow, 1), part(grow, 0)))
        if not rule:
            break
        judged = lambda r: _worth(r, part(held, 1), part(held, 0))
        while len(rule) > 1:
            shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=judged)
            if judged(shorter) < judged(rule):
                break
            rule = shorter
        worth, covered = judged(rule)
        if covered < MIN_COVER or worth < 2 * MIN_PRECISION - 1:
            break
        rules.append(rule)
        left = [r for r in left if not _covers(rule, r)]
    return rules


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learns the decision list from the labelled rows of ``docs``, at most ``max_labelled`` of them.

    ``labels``: (doc_id, quality), quality 0 meaning bad; rows with nulls teach nothing, nor do documents that the base
    rules reject: the list decides about the others. The joined sample has the smallest hashes of doc_id, whatever the
    order of the rows is.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 0, 1).otherwise(0).alias("bad"))
    taught = known.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(max_labelled)
    labelled = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")
    # What the base rules reject goes here: as a filter of the plan it would be moved before the join, onto all documents.
    sample = text_stats(labelled).select("doc_id", "bad", *FEATURES, base_failed().alias("failed")).collect()
    return learn_rules([r.asDict() for r in sorted(sample, key=lambda r: tuple(r)) if not r["failed"]])


def decision_list(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false where a rule matches, true at its end."""
    verdict = None
    for rule in rules:
        matches = rule[0].column()
        for condition in rule[1:]:
            matches = matches & condition.column()
        verdict = F.when(matches, False) if verdict is None else verdict.when(matches, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def base_failed() -> Column:
    """Under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` with its statistics, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; repeated rows are judged alike; without labels, or with labels
    of one kind, the list is empty and the base rules alone decide.
    """
    rules = fit_quality(docs, labels, max_labelled)
    judged = text_stats(docs).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & decision_list(rules))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdicts, the list being learned from ``labels``."""
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
