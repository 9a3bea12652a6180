"""Substring dedup by recompression: repeated word windows go, all but their first occurrence."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from veingraph.llm.common import cut, table
from veingraph.llm.rolling import (
    CHUNK_BYTES,
    DEALT,
    NULL_ID,
    SPAN,
    Prefixes,
    arrow,
    by_document,
    chunks,
    covered_by,
    dealt,
    encoded,
    in_table,
    joined,
    mix64,
    rows_of,
    run_starts,
    slices,
    word_segments,
)
from veingraph.plans.iteration import dictionary

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 20
#: One bucket of the shuffle stands for about so much text: small ones fill partitions evenly.
BUCKET_BYTES = 1_000_000
#: A symbol with more occurrences than this as a window's core has its windows dealt out one by one ...
HOT_ROWS = 2_000
#: ... but at most so many symbols have (the commonest ones), so that their list stays small at any size.
HOT_GROUPS = 1_000_000
#: A task holds so many counts before it hands them over.
HELD_COUNTS = 1_000_000

#: Schemas of what workers hand over, and their records.
FREQUENT = "g long, n long"
MARKS = "id long, h long, blob binary"
COUNT = np.dtype([("g", np.uint32), ("n", np.int32)])
WINDOWS = np.dtype([("id", np.int64), ("h", np.int64), ("pos", np.int32), ("n", np.int32), ("group", np.uint64)])
#: So many bytes of a window's own hash go along; with its group's 64 bits they tell windows apart.
MATCH_BYTES = 4

RUN, PAIR, SIDE, ORDER, MATCH = (np.uint64(x) for x in (0x51ED270B4D2C9A35, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xD6E8FEB86659FD93))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, and where each text's words begin (with the end last)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = _BLANK[data]
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    places = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Prefixes(_BYTES[data]).runs(starts, ends), np.searchsorted(starts, places)


def rounds_of(window: int) -> int:
    """Rounds of pairs after the round of runs: each leaves three quarters of the symbols, until one spans about a quarter of a window."""
    return max(1, round(math.log(max(window, 5) / 5) / math.log(4 / 3)))


def recompress(names: np.ndarray, starts: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: (names, joined, leans) of the symbols.

    ``joined`` marks symbols that become one with the symbol before them; ``leans`` tells what outside the symbols'
    own run could take them: -1 the symbol before, 1 the one after, 0 either. A name is a hash of what the symbol
    stands for, so workers agree on all names without meeting. Round 0 joins runs of equal symbols; in the others each
    symbol falls left or right by its name and the round, and a left one followed by a right one becomes one.
    """
    apart = first[starts[1:]]
    joined_ = np.zeros(len(names), bool)
    if k == 0:
        joined_[1:] = (names[1:] == names[:-1]) & ~apart
        heads = np.flatnonzero(~joined_)
        n = np.diff(np.append(heads, len(names))).astype(np.uint64)
        return np.where(n > 1, mix64(names[heads] * RUN + n), names[heads]), joined_, np.zeros(len(names), np.int8)
    right = (mix64(names ^ (SIDE + np.uint64(k))) & np.uint64(1)).astype(bool)
    joined_[1:] = ~right[:-1] & right[1:] & ~apart
    fresh = names.copy()
    pairs = np.flatnonzero(joined_) - 1
    fresh[pairs] = mix64(names[pairs] * PAIR + names[pairs + 1])
    return fresh[~joined_], joined_, np.where(right, -1, 1).astype(np.int8)


def parsed_windows(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(doc, pos, anchor, group, hash, span) of every window of the chunk, in order.

    The texts are recompressed round by round. A window keeps the range of symbols that lie in it whatever stands
    around it: in each round those at its ends go that a symbol outside could join. Its core is the symbol of the
    least name in the last range that is not empty, one of ``window // 4`` words or more before shorter ones: any
    other occurrence of the window has the same core at the same place. ``group`` is the core's name, ``anchor`` the
    place of its first word, ``span`` its number of words.
    """
    words, edges = word_hashes(texts)
    n_windows = np.maximum(np.diff(edges) - window + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n_windows)
    none = np.zeros(0, np.int64)
    if not len(doc):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    first = np.zeros(len(words) + 1, bool)
    first[edges] = True
    pos = np.arange(len(doc)) - (np.cumsum(n_windows) - n_windows)[doc]
    at = edges[doc] + pos
    anchor, span = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    group = np.empty(len(doc), np.uint64)
    names, starts = words, np.arange(len(words))
    live, low, high = np.arange(len(doc)), at, at + window
    for k in range(rounds_of(window) + 1):
        fresh, joined_, leans = recompress(names, starts, first, k)
        place = np.cumsum(~joined_) - 1
        if k == 0:
            low2, high2 = place[low] + 1, place[high - 1]
        else:
            a, b = low + (leans[low] < 0), high - 1 - (leans[high - 1] > 0)
            low2, high2 = place[np.minimum(a, len(place) - 1)], np.where(a <= b, place[b] + 1, 0)
        over = low2 >= high2
        if over.any():
            _settle_cores(live[over], low[over], high[over], names, starts, len(words), window, anchor, group, span)
        live, low, high = live[~over], low2[~over], high2[~over]
        names, starts = fresh, starts[~joined_]
        if not len(live):
            break
    if len(live):
        _settle_cores(live, low, high, names, starts, len(words), window, anchor, group, span)
    return doc, pos, anchor, group, Prefixes(words).runs(at, at + window), span


def _settle_cores(
    chosen: np.ndarray, low: np.ndarray, high: np.ndarray, names: np.ndarray, starts: np.ndarray, n_words: int, window: int,
    anchor: np.ndarray, group: np.ndarray, span: np.ndarray,
) -> None:
    """Writes the cores of the windows ``chosen``, whose symbols are those of [low, high)."""
    spans = np.diff(np.append(starts, n_words))
    short = np.maximum(0, min(window // 4, 15) - spans).astype(np.uint64)
    order = (mix64(names ^ ORDER) >> np.uint64(4)) | (short << np.uint64(60))
    best, least = low.copy(), order[low]
    step = 1
    while len(more := np.flatnonzero(low + step < high)):
        other = order[low[more] + step]
        less = other < least[more]
        best[more[less]], least[more[less]] = low[more[less]] + step, other[less]
        step += 1
    anchor[chosen], group[chosen], span[chosen] = starts[best], names[best], spans[best]


# Symbols that are common in the whole corpus


def reduced(groups: np.ndarray, buckets: int) -> np.ndarray:
    """What groups are counted by: their bucket and 32 bits more. Two that meet are counted as one, which may make both hot."""
    return ((mix64(groups) % np.uint64(buckets)) << np.uint64(32)) | (groups & np.uint64(0xFFFFFFFF))


def dealt_counts(groups: Iterable[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of all groups, in buckets by group; a task combines what it holds before it hands it over."""

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        heads = run_starts(every[order])
        return every[order[heads]], np.add.reduceat(n[order], heads) if len(heads) else n

    def handed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return dealt((keys >> np.uint64(32)).astype(np.int64), rows_of(COUNT, keys & np.uint64(0xFFFFFFFF), n))

    keys, counts, held = [], [], 0
    for found in groups:
        distinct, n = np.unique(reduced(found, buckets), return_counts=True)
        keys, counts, held = [*keys, distinct], [*counts, n], held + len(n)
        if held > HELD_COUNTS:
            one = merged(keys, counts)
            keys, counts, held = [one[0]], [one[1]], len(one[0])
            if held > HELD_COUNTS // 2:
                yield handed(*one)
                keys, counts, held = [], [], 0
    if held:
        yield handed(*merged(keys, counts))


def _sum_up(table: pa.Table, least: int) -> pa.Table:
    """A bucket's groups of more than ``least`` occurrences in all tasks together."""
    rows = joined(table.column("blob"), COUNT)
    order = np.argsort(rows["g"], kind="stable")
    heads = run_starts(rows["g"][order])
    sums = np.add.reduceat(rows["n"][order].astype(np.int64), heads)
    often = sums > least
    g = rows["g"][order][heads][often].astype(np.int64) | (table.column("bucket")[0].as_py() << 32)
    return in_table(arrow({"g": g, "n": sums[often]}, FREQUENT))


def common_groups(found: DataFrame) -> np.ndarray:
    """The groups of more than HOT_ROWS occurrences, ``reduced``, all counted; if these are over HOT_GROUPS, the commonest."""
    least = HOT_ROWS
    hot = cut(found.groupBy("bucket").applyInArrow(lambda table: _sum_up(table, least), FREQUENT))
    if hot.count() > HOT_GROUPS:
        hot = hot.orderBy(F.desc("n"), "g").limit(HOT_GROUPS)
    return np.sort(hot.select("g").toArrow().column("g").to_numpy().view(np.uint64))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array ``known`` holds."""
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _cores(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[np.ndarray]:
    for _, _, texts, _ in chunks(batches, word_segments, window - 1):
        _, _, anchor, group, _, _ = parsed_windows(texts, window)
        yield group[run_starts(anchor, group)]


# Windows


def _deal(batches: Iterator[pa.RecordBatch], window: int, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Buckets of windows by group (hot ones by themselves); windows that a chunk repeats are settled here.

    Records are runs of windows of one core, beside the windows' hashes. Settled ones go along with n < 0, dealt by
    document.
    """
    for ids, hashes, texts, offsets in chunks(batches, word_segments, window - 1):
        doc, pos, anchor, group, match, _ = parsed_windows(texts, window)
        if not len(doc):
            continue
        order = np.argsort(mix64(match * MATCH + group), kind="stable")
        heads = run_starts(match[order], group[order])
        again = np.ones(len(doc), bool)
        again[order[heads]] = False
        single = is_in(reduced(group, n_buckets), hot)
        place = np.arange(len(doc)) * (single & ~again)
        runs = run_starts(doc, anchor * ~again, group * ~again, again, place)
        n = np.diff(np.append(runs, len(doc)))
        d, settled, alone = doc[runs], again[runs], single[runs]
        key = np.where(alone, mix64(match[runs] ^ group[runs]), mix64(group[runs]))
        key = np.where(settled, mix64(hashes[d].view(np.uint64)), key)
        kept = np.where(settled, 0, n)
        low = match.view(np.uint8).reshape(-1, 8)[:, 8 - MATCH_BYTES :]

        def inner(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The windows' hashes in the order of their records."""
            m = kept[by]
            taken = np.repeat(runs[by] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            return low[taken], m

        records = rows_of(WINDOWS, ids[d], hashes[d], pos[runs] + offsets[d], np.where(settled, -n, n), group[runs])
        yield dealt((key % np.uint64(n_buckets)).astype(np.int64), records, inner)


def _settle(table: pa.Table) -> pa.Table:
    """(id, h, blob of spans) of the windows of a bucket that also start earlier."""
    rows = joined(table.column("blob"), WINDOWS)
    wide = np.zeros((0, 8), np.uint8)
    low = joined(table.column("blobs"), np.uint8).reshape(-1, MATCH_BYTES)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, 8 - MATCH_BYTES :] = low
    match = wide.reshape(-1).view(np.uint64)
    done, rows = rows[rows["n"] < 0], rows[rows["n"] > 0]
    ids, hashes, pos, size, group = (rows[c] for c in WINDOWS.names)
    before = np.cumsum(size) - size
    rank = np.lexsort((pos, hashes, ids))  # records in order of their first windows
    n = size[rank]
    record = np.repeat(rank, n)
    step = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    place, value = pos[record] + step, mix64(match[before[record] + step] * MATCH + group[record])
    order = np.argsort(value, kind="stable")
    heads = run_starts(value[order])
    head = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    r, r0, p, p0 = record[order], record[head], place[order], place[head]
    later = (ids[r] != ids[r0]) | (hashes[r] != hashes[r0]) | (p != p0)
    gone = np.zeros(len(record), bool)
    gone[order] = later
    r, p = record[gone], place[gone]
    starts = run_starts(r, p - np.arange(len(p)))
    more = (ids[r[starts]], hashes[r[starts]], rows_of(SPAN, p[starts], np.diff(np.append(starts, len(p)))))
    both = [np.concatenate(c) for c in zip((done["id"], done["h"], rows_of(SPAN, done["pos"], -done["n"])), more)]
    return in_table(by_document("blob", MARKS, *both))


def kept_words(text: bytes, spans: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """(words, words that a marked window covers, the others joined by spaces), part by part of a long text."""
    total = gone = 0
    kept: list[bytes] = []
    for offset, part in word_segments(text, CHUNK_BYTES, 0):
        words = part.split()
        total += len(words)
        if len(spans):
            begin, end = (np.clip(x - offset, 0, len(words)) for x in (spans["start"], spans["start"] + spans["n"] + (window - 1)))
            covered = covered_by(len(words), begin, end)
            gone += int(covered.sum())
            words = [w for w, c in zip(words, covered.tolist()) if not c]
        if words:
            kept.append(b" ".join(words))
    return total, gone, b" ".join(kept)


def _without(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The texts' words that no marked window covers."""
    for part in slices(batches):
        spans = (np.frombuffer(b"".join(b or ()), SPAN) for b in part.column("blobs").to_pylist())
        n_words, n_removed, kept = zip(*(kept_words(t, s, window) for t, s in zip(encoded(part.column("text")), spans)))
        columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def with_identity(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``_vg_id``, ``_vg_h``, an identity that equal rows share, and the ids' dictionary if they need one.

    Ids follow the order of doc_id, nulls last; those that are no integers are numbered in their order. The hash's last
    bit tells a null id from the largest one.
    """
    ids = None
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        rows, number = docs, F.col("doc_id").cast("long")
    else:
        ids = dictionary(docs.select("doc_id"))
        rows = docs.join(ids.select(F.col("id").alias("_vg_number"), F.col("term").alias("doc_id")), "doc_id", "left").select(*docs.columns, "_vg_number")
        number = F.col("_vg_number")
    h = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return rows.withColumns({"_vg_id": F.coalesce(number, F.lit(NULL_ID)), "_vg_h": h}).drop("_vg_number"), ids


def identified(docs: DataFrame) -> DataFrame:
    """(id, h, doc_id, text) of all rows: their identity, by which marks are joined, beside what it stands for."""
    return with_identity(docs.select("doc_id", "text"))[0].select(F.col("_vg_id").alias("id"), F.col("_vg_h").alias("h"), "doc_id", "text")


def n_buckets(docs: DataFrame, size: int = BUCKET_BYTES) -> int:
    """Buckets in proportion to the corpus's bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, -(-total // size))


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Each row of identified ``docs`` with its ``blobs``, null if it has none."""
    grouped = marks.groupBy("id", "h").agg(F.collect_list("blob").alias("blobs"))
    return docs.join(grouped, ["id", "h"], "left").select("id", "h", "doc_id", "text", "blobs")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are maximal runs of characters other than ASCII white space. A word goes if a window of ``window``
    consecutive words that covers it also starts earlier: in a document of smaller doc_id, or earlier in the
    same one. ``kept`` joins what stays by single spaces.

    Null ids come last, ids of other types than integers in their own order; rows of one id but other texts follow
    each other by a hash of the text; equal rows are one document and get equal results. Null and empty texts have no
    words. Very long texts are taken in segments of some CHUNK_BYTES that overlap by a window, with the same result.

    Recompression's interior symbols propose which windows may be equal; windows of one core are told apart by 64 bits
    of its name and 32 of a hash of their words.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    rows = identified(docs)
    texts = rows.select("id", "h", "text")
    buckets = n_buckets(docs)
    counts = texts.mapInArrow(lambda it: dealt_counts(_cores(it, window), buckets), DEALT)
    hot = docs.sparkSession.sparkContext.broadcast(common_groups(counts))
    in_buckets = texts.mapInArrow(lambda it: _deal(it, window, buckets, hot.value), DEALT)
    marks = in_buckets.groupBy("bucket").applyInArrow(lambda table: _settle(table), MARKS)
    joined_ = with_marks(rows, marks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined_.mapInArrow(lambda it: _without(it, window), f"doc_id {kind}, n_words long, n_removed long, kept string")


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dedup of 20-word windows leaves of every document, as a digest."""
    left = dedup_substrings(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def substrings_sql() -> str:
    """The same rows in SQL, each window's words being spelt out."""
    return rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda t: t <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, r.i AS i, md5(array_to_string(w[r.i:r.i + {WINDOW - 1}], ' ')) AS v
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW - 1}, 0) + 1)) AS i) r),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT d.doc_id, r.i AS i, d.w[r.i] AS t FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS i) r),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.p GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
