"""Byte-level dedup by suffix arrays: every byte in a long string that occurs twice goes."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.llm.common import cut, table
from veingraph.llm.rolling import (
    DEALT,
    SPAN,
    Prefixes,
    arrow,
    blobs_of,
    by_document,
    byte_segments,
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
    sliding_argmin,
)
from veingraph.llm.substrings import MARKS, common_groups, dealt_counts, identified, is_in, n_buckets, reduced

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
#: One bucket of the shuffle stands for about so much text.
BUCKET_BYTES = 2_000_000
#: An anchor stands at least so many bytes from either end of its windows.
MARGIN = 100
#: An anchor's core is so many bytes on either side of it.
CORE = 50
#: Anchors are ordered by the hashes of so many bytes.
GRAM = 16
#: One suffix array covers about so many bytes.
SHARD_BYTES = 1_000_000
#: Batches of so few suffixes are placed one by one.
FEW = 32

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
MATCH = np.uint64(0xD6E8FEB86659FD93)


# Suffix arrays by induced sorting


def stable_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of small numbers, by one or two rounds of radix sorting."""
    if keys.dtype.itemsize <= 2:
        return np.argsort(keys, kind="stable")
    low = np.argsort(keys.astype(np.uint16), kind="stable")
    return low[np.argsort((keys >> 16).astype(np.uint16)[low], kind="stable")]


def classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (the last, a unique least symbol, is)."""
    last_of_run = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    rises = np.append(text[last_of_run[:-1]] < text[last_of_run[:-1] + 1], True)
    return np.repeat(rises, np.diff(last_of_run, prepend=-1))


def spread(slots: np.ndarray, at: np.ndarray, text: np.ndarray, wanted: np.ndarray) -> None:
    """Fills the empty slots (-1): each suffix sends its predecessor, if that is ``wanted``, to the next slot ``at`` its symbol.

    Slots are taken in batches, whatever buckets they are of: all up to the first that is still empty, whose predecessors
    go to their buckets' next slots in one stable step.
    """
    n, done, look = len(slots), 0, 64
    while done < n:
        until = done
        while until < n:
            empty = slots[until : until + look] < 0
            k = int(empty.argmax())
            if empty[k]:
                until += k
                break
            until += len(empty)
            look = min(2 * look, 1 << 16)
        look = max(64, (until - done) // 2)
        before = slots[done:until]
        done = until
        before = before[before > 0] - 1
        before = before[wanted[before]]
        m = len(before)
        symbols = text[before]
        if m <= FEW:
            for i, c in zip(before.tolist(), symbols.tolist()):
                to = at[c]
                slots[to] = i
                at[c] = to + 1
            continue
        by = stable_order(symbols)
        symbols = symbols[by]
        heads = np.empty(m, np.int64)
        heads[0] = 0
        other = (symbols[1:] != symbols[:-1]).nonzero()[0]
        heads = heads[: len(other) + 1]
        heads[1:] = other + 1
        first = symbols[heads]
        to = at[first]
        counts = np.empty(len(heads), np.int64)
        counts[:-1] = heads[1:] - heads[:-1]
        counts[-1] = m - heads[-1]
        slots[(to - heads).repeat(counts) + np.arange(m)] = before[by]
        at[first] = to + counts


def induce(text: np.ndarray, sizes: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes' order from that of the leftmost-smaller ones.

    The pass from the least bucket up sees a bucket's larger suffixes, which it places, and then its leftmost-smaller
    ones; the pass from the greatest down sees all and places the smaller ones.
    """
    n, ends = len(text), np.cumsum(sizes)
    n_larger = sizes - np.bincount(text[smaller], minlength=len(sizes))
    symbols = text[leftmost]
    n_leftmost = np.bincount(symbols, minlength=len(sizes))
    begin = np.cumsum(n_larger + n_leftmost) - n_larger - n_leftmost
    slots = np.full(int((n_larger + n_leftmost).sum()), -1, np.int64)
    of_leftmost = np.repeat(begin + n_larger - (np.cumsum(n_leftmost) - n_leftmost), n_leftmost) + np.arange(len(leftmost))
    slots[of_leftmost] = leftmost[stable_order(symbols)]
    is_larger = np.ones(len(slots), bool)
    is_larger[of_leftmost] = False
    spread(slots, begin, text, ~smaller)
    order = np.full(n, -1, np.int64)
    order[np.repeat(ends - sizes - (np.cumsum(n_larger) - n_larger), n_larger) + np.arange(int(n_larger.sum()))] = slots[is_larger]
    order[0] = n - 1
    spread(order[::-1], n - ends, text, smaller)
    return order


def names_of(text: np.ndarray, placed: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, in the text's order: equal ones, symbol by symbol, have one name.

    ``placed``: their starts in the order of the first induction, which sorts them.
    """
    nth = np.empty(len(text), np.int64)
    nth[leftmost] = np.arange(len(leftmost))
    length = np.diff(np.append(leftmost, len(text) - 1))[nth[placed]]
    same = np.zeros(len(placed), bool)
    open_ = np.flatnonzero(length[1:] == length[:-1])
    a, b, left = placed[open_], placed[open_ + 1], length[open_]
    while len(open_):
        equal = text[a] == text[b]
        same[open_[equal & (left == 0)] + 1] = True
        on = equal & (left > 0)
        open_, a, b, left = open_[on], a[on] + 1, b[on] + 1, left[on] - 1
    names = np.empty(len(leftmost), np.int64)
    names[nth[placed]] = np.cumsum(~same) - 1
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes' order of a string of non-negative numbers whose last is its only 0; numbers leave few gaps.

    The leftmost-smaller substrings are sorted by an induction and named; if names repeat, the string of names is
    sorted in the same way, at every size; a second induction gives the order of all suffixes.
    """
    n, sigma = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    text = text.astype(np.uint8 if sigma <= 1 << 8 else np.uint16 if sigma <= 1 << 16 else np.int32)
    sizes = np.bincount(text, minlength=sigma)
    smaller = classify(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = induce(text, sizes, smaller, leftmost)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    names = names_of(text, order[is_leftmost[order]], leftmost)
    del order, is_leftmost
    ranks = np.argsort(names) if int(names.max()) + 1 == len(names) else suffix_array(names)
    return induce(text, sizes, smaller, leftmost[ranks])


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int, least: int = 0) -> np.ndarray:
    """Permuted common prefixes: for each place its longest match with another suffix, up to ``limit``.

    A suffix's longest match is with a neighbour in the order. Lengths are found by halving over prefix hashes; those
    that cannot reach ``least`` any more are left at what is known of them. Matches of ``least`` symbols or more are
    then compared symbol by symbol: those of neighbouring places with neighbouring places share what they compare.
    """
    prefixes = Prefixes(mix64(text.astype(np.uint64) + np.uint64(1)))
    n = len(text)
    a, b = order[:-1], order[1:]
    room = np.minimum(n - np.maximum(a, b), limit)
    low = np.zeros(n - 1, np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        fits = np.flatnonzero((low + step <= room) & (low + (2 * step - 1) >= least))
        i, j = a[fits] + low[fits], b[fits] + low[fits]
        same = fits[prefixes.runs(i, i + step) == prefixes.runs(j, j + step)]
        low[same] += step
        step //= 2
    claimed = np.flatnonzero(low >= max(least, 1))
    low[claimed] = exact_prefixes(text, a[claimed], b[claimed], low[claimed])
    best = np.zeros(n, np.int64)
    best[a] = low
    best[b] = np.maximum(best[b], low)
    return best


def exact_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, claimed: np.ndarray) -> np.ndarray:
    """How much of the claimed matches at ``a`` and ``b`` is true; stretches of pairs on one diagonal are compared once."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    by = np.lexsort((a, b - a))
    x, diagonal, end = a[by], (b - a)[by], (a + claimed)[by]
    # A stretch: pairs of one diagonal, each beginning before all that come before it have ended.
    reach = np.maximum.accumulate(end + (diagonal - diagonal.min()) * (len(text) + 1)) - (diagonal - diagonal.min()) * (len(text) + 1)
    new = np.append(True, (diagonal[1:] != diagonal[:-1]) | (x[1:] >= reach[:-1]))
    heads = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    size = reach[np.append(heads[1:], len(x)) - 1] - x[heads]
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(x[heads] - begin, size)
    differs = np.append(np.flatnonzero(text[at] != text[at + np.repeat(diagonal[heads], size)]), len(at))
    place = begin[stretch] + x - x[heads][stretch]
    out[by] = np.minimum(end - x, differs[np.searchsorted(differs, place)] - place)
    return out


# Candidates


def super_strings(text_bytes: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, start, n, anchor, core, group, whole) of the maximal runs of windows of one anchor, starts and anchors in their texts.

    ``edges``: where each text begins in ``text_bytes``, and its end. The anchor of a window is the place of the
    least 16-byte hash in its interior; its core and its group name the CORE and the MARGIN bytes on either side of it,
    all inside the window; so equal windows are of one core and group. ``whole`` is the hash of a run's bytes.
    """
    size = np.diff(edges)
    count = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none, *[none.astype(np.uint64)] * 3
    at = np.arange(len(doc)) + np.repeat(edges[:-1] - (np.cumsum(count) - count), count)
    prefixes = Prefixes(_BYTES[text_bytes])
    order = prefixes.windows(GRAM) >> np.uint64(1)
    order = np.append(order, np.full(len(text_bytes) - len(order), np.iinfo(np.uint64).max >> 1, np.uint64))
    anchor = sliding_argmin(order, length - 2 * MARGIN)[at + MARGIN]
    runs = run_starts(doc, anchor)
    n = np.diff(np.append(runs, len(doc)))
    doc, at, anchor = doc[runs], at[runs], anchor[runs]
    core, group, whole = prefixes.runs(anchor - CORE, anchor + CORE), prefixes.runs(anchor - MARGIN, anchor + MARGIN), prefixes.runs(at, at + n + (length - 1))
    return doc, at - edges[doc], n, anchor - edges[doc], core, group, whole


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _cores(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    for _, _, texts, _ in chunks(batches, byte_segments, length - 1):
        yield super_strings(*_joined(texts), length)[4]


#: A run of windows, a window of a hot core by itself (``whole`` is its hash), a window of a hot core that its task has seen
#: twice before, a run of a hot core (which is known to be shared); the last two go by document.
RUN, SINGLE, SEEN, KNOWN = range(4)
RUNS = np.dtype([("kind", np.int8), ("id", np.int64), ("h", np.int64), ("start", np.int32), ("n", np.uint16), ("anchor", np.uint16), ("core", np.uint64), ("group", np.uint32), ("whole", np.uint64)])
#: Twins and groups are numbered within their bucket. The bytes of a run are needed ``whole``, or only a digest of them.
NEEDED = np.dtype([("bucket", np.int64), ("start", np.int32), ("n", np.uint16), ("twin", np.uint32), ("group", np.uint32), ("whole", np.bool_)])
PIECES = np.dtype([("n", np.uint16), ("twin", np.uint32), ("group", np.uint32), ("whole", np.bool_), ("digest", np.void, 16)])
MEMBERS = np.dtype([("twin", np.uint32), ("id", np.int64), ("h", np.int64), ("start", np.int32)])
SIFTED = "id long, h long, bucket long, blob binary, shared binary, needed binary, members binary"


class Seen:
    """How often a task has seen a hash so far, up to twice."""

    def __init__(self) -> None:
        self.once = self.twice = np.zeros(0, np.uint64)

    def places(self, values: np.ndarray) -> np.ndarray:
        """For each value how many equal ones came before it, those of earlier calls included; 2 stands for more."""
        order = np.argsort(values, kind="stable")
        heads = run_starts(values[order])
        sizes = np.diff(np.append(heads, len(order)))
        distinct = values[order[heads]]
        before = is_in(distinct, self.once).astype(np.int64) + is_in(distinct, self.twice)
        nth = np.empty(len(values), np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(heads - before, sizes)
        self.once = np.union1d(self.once, distinct)
        self.twice = np.union1d(self.twice, distinct[before + sizes > 1])
        return np.minimum(nth, 2)


def _deal(batches: Iterator[pa.RecordBatch], length: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of windows in buckets by core. Windows of hot cores go by themselves, of equal ones two from each task.

    A task has seen the others' bytes twice, so these repeat for sure: their records are marks for their documents.
    """
    seen = Seen()
    for ids, hashes, texts, offsets in chunks(batches, byte_segments, length - 1):
        data, edges = _joined(texts)
        doc, start, n, anchor, core, group, whole = super_strings(data, edges, length)
        if not len(doc):
            continue
        common = is_in(reduced(core, buckets), hot)
        rare = ~common
        parts = [(RUN, *(c[rare] for c in (doc, start, n, anchor, core, group, whole)))]
        if common.any():
            parts.append((KNOWN, *(c[common] for c in (doc, start, n, anchor, core, group, whole))))
            m = n[common]
            d, step = np.repeat(doc[common], m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            at, g = np.repeat(start[common], m) + step, np.repeat(core[common], m)
            match = Prefixes(_BYTES[data]).runs(at + edges[d], at + edges[d] + length)
            kind = np.where(seen.places(mix64(g * MATCH + match)) < 2, SINGLE, SEEN)
            parts.append((kind, d, at, 1, np.repeat(anchor[common], m), g, match, match))
        records = np.concatenate([rows_of_run(kind, ids[d], hashes[d], s + offsets[d], c, a - s, g, w >> np.uint64(32), v) for kind, d, s, c, a, g, w, v in parts])
        by_doc, alone = records["kind"] >= SEEN, records["kind"] == SINGLE
        key = np.where(alone, mix64(records["whole"] ^ records["core"]), mix64(records["core"]))
        key = np.where(by_doc, mix64(records["h"].view(np.uint64)), key)
        yield dealt((key % np.uint64(buckets)).astype(np.int64), records)


def rows_of_run(kind: np.ndarray | int, ids: np.ndarray, *columns: np.ndarray | int) -> np.ndarray:
    """Records of RUNS, anchors as distances from the runs' starts; a single value stands for all."""
    out = np.empty(len(ids), RUNS)
    for name, column in zip(RUNS.names, (kind, ids, *columns)):
        out[name] = column
    return out


def _sift(table: pa.Table) -> pa.Table:
    """What a bucket's records come to: marks and shared cores by document, runs whose bytes are needed, and their members.

    A run is needed if its group has another place too. Equal runs are twins: two of them are needed, and what is found
    of them holds for all. Of a group's different runs, one of each goes to a suffix array.
    """
    rows = joined(table.column("blob"), RUNS)
    bucket = table.column("bucket")[0].as_py()
    seen, known = rows[rows["kind"] == SEEN], rows[rows["kind"] == KNOWN]
    rows = rows[rows["kind"] < SEEN]
    rows = rows[np.lexsort((rows["start"], rows["h"], rows["id"], rows["whole"], rows["group"], rows["core"]))]
    rows = rows[run_starts(*(rows[c] for c in ("core", "group", "whole", "id", "h", "start")))]  # equal rows of the input are one document

    single = rows["kind"] == SINGLE
    heads, groups = run_starts(rows["core"], rows["group"], rows["whole"]), run_starts(rows["core"], rows["group"])
    twin = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(rows))))
    group = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, len(rows))))
    nth = np.arange(len(rows)) - heads[twin]
    needed = np.bincount(group)[group] > 1
    wanted = needed & (nth < 2)
    w = rows[wanted]
    kinds = np.bincount(group[heads])
    whole = (kinds[group[wanted]] > 1) & (nth[wanted] == 0)
    records = rows_of(NEEDED, np.full(len(w), bucket), w["start"], w["n"], twin[wanted], group[wanted], whole)
    members = rows_of(MEMBERS, twin[needed], *(rows[c][needed] for c in ("id", "h", "start")))
    # Cores that different documents hold.
    by_core = rows[~single]
    by_core = by_core[np.lexsort((by_core["h"], by_core["id"], by_core["core"]))]
    cores, owners = run_starts(by_core["core"]), run_starts(by_core["core"], by_core["id"], by_core["h"])
    n_owners = np.diff(np.append(np.searchsorted(owners, cores), len(owners)))
    shared = np.concatenate((by_core[np.repeat(n_owners > 1, np.diff(np.append(cores, len(by_core))))], known))
    return in_table(
        by_document("blob", SIFTED, seen["id"], seen["h"], rows_of(SPAN, seen["start"], seen["n"])),
        by_document("shared", SIFTED, shared["id"], shared["h"], rows_of(SPAN, shared["start"] + shared["anchor"] - CORE, np.full(len(shared), 2 * CORE))),
        by_document("needed", SIFTED, w["id"], w["h"], records),
        arrow({"bucket": np.array([bucket]), "members": blobs_of(members, np.array([0, len(members)]))}, SIFTED),
    )


def _extract(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The needed runs' bytes, or digests of them, in their buckets."""
    for part in slices(batches):
        records, pieces = [], []
        for text, blobs in zip(encoded(part.column("text")), part.column("blobs").to_pylist()):
            found = np.frombuffer(b"".join(blobs), NEEDED)
            pieces += [text[a : a + m + length - 1] for a, m in zip(found["start"].tolist(), found["n"].tolist())]
            records.append(found)
        every = np.concatenate(records)
        digests = np.frombuffer(b"".join(hashlib.md5(p, usedforsecurity=False).digest() for p in pieces), "V16")
        size = np.where(every["whole"], every["n"].astype(np.int64) + (length - 1), 0)

        def inner(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            chosen = order[every["whole"][order]]  # noqa: B023
            return np.frombuffer(b"".join(pieces[k] for k in chosen.tolist()), np.uint8), size[order]  # noqa: B023

        yield dealt(every["bucket"], rows_of(PIECES, *(every[c] for c in ("n", "twin", "group", "whole")), digests), inner)


def shard_matches(pieces: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether each place of the pieces' joined bytes starts a ``length``-byte string that the shard holds elsewhere.

    Pieces are separated by one symbol, which no such string may cross.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    text = np.zeros(len(pieces) + n + 1, np.uint16)
    gap = np.repeat(np.arange(n), sizes)
    at = np.arange(len(pieces)) + gap
    text[at] = pieces.astype(np.uint16) + np.uint16(2)
    text[ends + np.arange(n)] = 1
    longest = common_prefixes(text, suffix_array(text), length, length)[at]
    return (np.arange(len(pieces)) + length <= ends[gap]) & (longest >= length)


def _match(table: pa.Table, length: int) -> pa.Table:
    """(id, h, blob of spans) of a bucket's windows that occur elsewhere.

    Twins of one digest occur twice with all their windows. The different runs of a group share a suffix array.
    """
    pieces, data = joined(table.column("blob"), PIECES), joined(table.column("blobs"), np.uint8)
    members = joined(table.column("members"), MEMBERS)
    sizes = np.where(pieces["whole"], pieces["n"].astype(np.int64) + (length - 1), 0)
    offset = np.cumsum(sizes) - sizes
    order = np.lexsort((~pieces["whole"], pieces["twin"], pieces["group"]))
    firsts = run_starts(pieces["group"][order], pieces["twin"][order])
    pairs = firsts[np.diff(np.append(firsts, len(order))) > 1]
    same = np.zeros(len(pieces), bool)
    same[order[pairs]] = pieces["digest"][order[pairs]] == pieces["digest"][order[pairs + 1]]
    alike = np.flatnonzero(same)
    found = [(alike, np.zeros(len(alike), np.int64), pieces["n"][alike].astype(np.int64))]
    shared = order[pieces["whole"][order]]
    bounds = np.append(run_starts(pieces["group"][shared]), len(shared)).tolist()
    begin = taken = 0
    for left, right in zip(bounds, bounds[1:]):
        taken += int(sizes[shared[left:right]].sum())
        if taken < SHARD_BYTES and right < len(shared):
            continue
        runs, begin, taken = shared[begin:right], right, 0
        own = sizes[runs]
        local = np.cumsum(own) - own
        hit = np.flatnonzero(shard_matches(data[np.repeat(offset[runs] - local, own) + np.arange(own.sum())], own, length))
        piece = np.searchsorted(local, hit, "right") - 1
        hit, piece = hit[~same[runs[piece]]], piece[~same[runs[piece]]]
        place = hit - local[piece]
        heads = run_starts(piece, place - np.arange(len(place)))
        found.append((runs[piece[heads]], place[heads], np.diff(np.append(heads, len(place)))))
    piece, place, n = (np.concatenate(c) for c in zip(*found))
    # What holds for a twin's piece holds for all its members.
    twin = pieces["twin"][piece]
    by = np.argsort(twin, kind="stable")
    low, high = (np.searchsorted(twin[by], members["twin"], side) for side in ("left", "right"))
    m = high - low
    who = np.repeat(np.arange(len(members)), m)
    run = by[np.repeat(low - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    return in_table(by_document("blob", MARKS, members["id"][who], members["h"][who], rows_of(SPAN, members["start"][who] + place[run], n[run])))


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        counts, kept = [], []
        for text, marks, cores in zip(encoded(part.column("text")), part.column("blobs").to_pylist(), part.column("cores").to_pylist()):
            size, gone, spans, shared = len(text), 0, 0, 0
            if cores:
                found = np.frombuffer(b"".join(cores), SPAN)
                shared = int(covered_by(size, found["start"], found["start"] + found["n"]).sum())
            if marks:
                found = np.frombuffer(b"".join(marks), SPAN)
                covered = covered_by(size, found["start"], found["start"] + found["n"] + (length - 1))
                gone, spans = int(covered.sum()), int((covered & ~np.append(False, covered[:-1])).sum())
                text = np.frombuffer(text, np.uint8)[~covered].tobytes()
            counts.append((size, gone, spans, shared))
            kept.append(text)
        numbers = [pa.array(c, pa.int64()) for c in zip(*counts)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", "kept"])


def dedup_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_shared, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Every byte that a ``length``-byte string covers goes if the string also starts anywhere else, in this text or
    another. ``kept`` is binary: a cut may fall inside a character. Null and empty texts have no bytes; equal rows
    are one document and get equal results, so they do not remove each other. Very long texts are taken in segments
    that overlap by ``length`` - 1 bytes, with the same result. ``doc_id`` may be of any type, and null.

    ``n_shared`` tells of passages that are too short to go: the bytes around anchors (100 each) that another document
    holds too. A passage of ``length`` - 100 bytes or more has at least one. Cores of over HOT_ROWS occurrences count
    as shared without a look at their documents.

    Windows are grouped by the bytes around anchors. All different runs of windows of a group go to one suffix array,
    whose common prefixes decide; of equal runs two are compared by a digest of their bytes. Windows of groups that are
    too common for one task are dealt out by their hash.
    """
    if length < 2 * MARGIN + GRAM:
        raise ValueError(f"the length is {2 * MARGIN + GRAM} at least")
    rows = identified(docs)
    texts = rows.select("id", "h", "text")
    buckets = n_buckets(docs, BUCKET_BYTES)
    counts = texts.mapInArrow(lambda it: dealt_counts(_cores(it, length), buckets), DEALT)
    hot = docs.sparkSession.sparkContext.broadcast(common_groups(counts))
    in_buckets = texts.mapInArrow(lambda it: _deal(it, length, buckets, hot.value), DEALT)
    sifted = cut(in_buckets.groupBy("bucket").applyInArrow(lambda table: _sift(table), SIFTED))
    needed = sifted.filter("needed IS NOT NULL").groupBy("id", "h").agg(F.collect_list("needed").alias("blobs"))
    # The texts are shuffled as for the last join, so that one shuffle serves both.
    wanted = rows.join(needed, ["id", "h"]).select("id", "h", "doc_id", "text", "blobs").dropDuplicates(["id", "h"])
    pieces = wanted.mapInArrow(lambda it: _extract(it, length), DEALT).withColumn("members", F.lit(None).cast("binary"))
    members = sifted.filter("octet_length(members) > 0").select("bucket", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("binary").alias("blobs"), "members")
    matched = pieces.unionByName(members).groupBy("bucket").applyInArrow(lambda table: _match(table, length), MARKS)
    known = sifted.filter("blob IS NOT NULL OR shared IS NOT NULL").select("id", "h", "blob", "shared")
    marks = known.unionByName(matched.withColumn("shared", F.lit(None).cast("binary")))
    grouped = marks.groupBy("id", "h").agg(F.collect_list("blob").alias("blobs"), F.collect_list("shared").alias("cores"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(grouped, ["id", "h"], "left").select("doc_id", "text", "blobs", "cores").mapInArrow(
        lambda it: _cut_out(it, length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary"
    )


def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dedup of 400-byte strings leaves of every document, as a digest, and its bytes in shorter shared passages."""
    left = dedup_bytes(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
