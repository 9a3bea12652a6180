"""Vectorised hashes of runs of symbols, and records of fixed width for bucketed shuffles; runs on workers."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are taken in chunks of about so many bytes, which bounds a worker's arrays.
CHUNK_BYTES = 1_000_000
BLANK_RUN = re.compile(rb"[ \t-\r]+")
#: Stands for a null doc_id; such rows come after all others.
NULL_ID = (1 << 63) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Polynomial prefix sums modulo 2^64 over symbol hashes, for the hash of any run of symbols."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        cls = Prefixes
        if len(cls.powers) < n + 1:
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * cls.powers[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * Prefixes.inverses[start])

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of ``length`` symbols, by its start."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * Prefixes.inverses[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_argmin(order: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the least value among ``width`` ones, the leftmost of equals.

    ``order`` holds 64-bit hashes; their low bits give way to the place.
    """
    bits = np.uint64(max(1, int(len(order)).bit_length()))
    value = ((order >> bits) << bits) | np.arange(len(order), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    if span < width:
        rest = width - span
        value = np.minimum(value[:-rest], value[rest:])
    return (value & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that agree in all columns begins."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def slices(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, row: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes each, one row at least, so that only one part is ever unpacked.

    A row counts for ``row`` bytes beside its texts.
    """
    try:
        for batch in batches:
            weight = np.full(batch.num_rows, row, np.int64)
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                    weight += np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
            part = np.cumsum(weight) // size
            begin = 0
            for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
                if end > begin:
                    yield batch.slice(begin, end - begin)
                begin = end
    finally:
        release()


def release() -> None:
    """Gives freed memory back to the system: an idle worker should hold none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, nulls as empty ones."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def arrow(columns: dict, schema: str) -> pa.RecordBatch:
    """A record batch of the columns that ``schema`` (``name type, ...``) names; what is missing is null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    made = lambda v, kind: v if isinstance(v, pa.Array) else pa.array(v, kinds[kind])
    arrays = [made(columns[name], kind) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def byte_segments(text: bytes, size: int, overlap: int) -> Iterator[tuple[int, bytes]]:
    """(offset, part) of a long text; each part but the last goes on for ``overlap`` bytes into the next one."""
    for begin in range(0, max(len(text) - overlap, 1), size):
        yield begin, text[begin : begin + size + overlap]


def word_segments(text: bytes, size: int, overlap: int, blanks: re.Pattern = BLANK_RUN) -> Iterator[tuple[int, bytes]]:
    """The same in words: offsets count words, cuts fall between them and ``overlap`` words of the next part follow."""
    begin = words = 0
    while begin < len(text):
        stop = blanks.search(text, begin + size)
        end = stop.end() if stop else len(text)
        until = end
        for _ in range(overlap):
            if until == len(text):
                break
            stop = blanks.search(text, until)
            until = stop.end() if stop else len(text)
        yield words, text[begin:until]
        if until == len(text):
            return  # the rest has fewer words than would start another window
        words += len(blanks.sub(b" ", text[begin:end]).split())
        begin = end


def chunks(batches: Iterator[pa.RecordBatch], segments: Callable = byte_segments, overlap: int = 0, row: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, hashes, texts, offsets) of parts of the batches (``id``, ``h``, ``text``): a row for each pair (id, h), in their order.

    A text of over CHUNK_BYTES comes in segments, a part each, so the arrays that are made of it stay bounded.
    """
    for part in slices(batches, row=row):
        ids, hashes = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "h"))
        texts = encoded(part.column("text"))
        order = np.lexsort((hashes, ids))
        order = order[run_starts(ids[order], hashes[order])]
        long = [k for k in order.tolist() if len(texts[k]) > 2 * CHUNK_BYTES]
        if long:
            order = order[~np.isin(order, long)]
        if len(order):
            yield ids[order], hashes[order], [texts[k] for k in order], np.zeros(len(order), np.int64)
        for k in long:
            for offset, piece in segments(texts[k], CHUNK_BYTES, overlap):
                yield ids[k : k + 1], hashes[k : k + 1], [piece], np.array([offset])


def rows_of(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    """Records of fixed width with the columns as fields."""
    out = np.empty(len(columns[0]), kind)
    for name, column in zip(kind.names, columns):
        out[name] = column
    return out


def blobs_of(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary value for each stretch of ``data`` (records, or rows of bytes) between neighbouring edges, without copies."""
    raw = np.ascontiguousarray(data)
    width = raw.nbytes // max(len(raw), 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(raw)])


DEALT = "bucket long, blob binary, blobs binary"


def dealt(bucket: np.ndarray, records: np.ndarray, inner: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> pa.RecordBatch:
    """Rows of (bucket, blob, blobs) for a shuffle: all records of a bucket in one blob.

    Records have a fixed width and no header, so what they take hardly depends on how many buckets they go to: with
    many buckets each goes alone, beside its key. ``inner`` gives, for the records' new order, what belongs to them
    beside the records, joined, and how much of it each has.
    """
    order = np.argsort(bucket, kind="stable")
    heads = run_starts(bucket[order])
    edges = np.append(heads, len(order))
    columns = {"bucket": bucket[order[heads]], "blob": blobs_of(records[order], edges)}
    if inner is not None:
        data, n = inner(order)
        columns["blobs"] = blobs_of(data, np.concatenate(([0], np.cumsum(n)))[edges])
    return arrow(columns, DEALT)


def joined(column: pa.Array | pa.ChunkedArray, kind: np.dtype | type) -> np.ndarray:
    """The records of all blobs of a column."""
    return np.frombuffer(b"".join(b for b in column.to_pylist() if b), kind)


#: What comes back to a document: stretches of it.
SPAN = np.dtype([("start", np.int32), ("n", np.int32)])


def by_document(name: str, schema: str, ids: np.ndarray, hashes: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """Rows of (id, h, ...): the records of each document as one blob in the column ``name``."""
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    starts = run_starts(ids, hashes)
    return arrow({"id": ids[starts], "h": hashes[starts], name: blobs_of(records[order], np.append(starts, len(ids)))}, schema)


def in_table(*batches: pa.RecordBatch) -> pa.Table:
    """The batches as a group's result; what the group took is given back to the system."""
    release()
    return pa.Table.from_batches(batches)


def covered_by(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of the places in the union of [start, end)."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0
