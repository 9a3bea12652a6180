"""Near-duplicate documents by weighted minhash signatures from darts, banded joins and exact checks."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veingraph.llm.common import cut, small, table
from veingraph.llm.rolling import CHUNK_BYTES, Prefixes, arrow, chunks, encoded, in_table, mix64, run_starts, slices, word_segments
from veingraph.llm.substrings import with_identity, word_hashes
from veingraph.operators.components import least_neighbours

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares no band in 3 of a million cases: (1 - 0.8^5)^32.
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Expected darts of a document, so that few coordinates stay empty in the first throw.
DARTS = int(COORDINATES * np.log(COORDINATES) + 2 * COORDINATES)

#: A document's darts and signature take the memory of so many bytes of text, however short it is.
DOCUMENT_BYTES = 2_000

LAYER, THROW, PLACE, NAME = (np.uint64(x) for x in (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, element, weight) of each text's distinct shingles with their counts, each text's number of words and hash.

    A shingle is ``size`` consecutive words; a text of fewer, but not none, is one shingle.
    """
    words, edges = _hashed([t.translate(_WORDS) for t in texts])
    counts = np.diff(edges)
    width = np.minimum(counts, size)
    n = np.where(counts > 0, counts - width + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    at = edges[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    prefixes = Prefixes(words)
    element = prefixes.runs(at, at + width[doc])
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    heads = run_starts(doc, element)
    weight = np.diff(np.append(heads, len(doc)))
    return doc[heads], element[heads], weight, counts, prefixes.runs(edges[:-1], edges[1:])


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, very long texts being hashed in segments."""
    if max(map(len, texts), default=0) <= 2 * CHUNK_BYTES:
        return word_hashes(texts)
    words = [np.concatenate([word_hashes([part])[0] for _, part in word_segments(t, CHUNK_BYTES, 0)] or [np.zeros(0, np.uint64)]) for t in texts]
    return np.concatenate(words), np.cumsum([0, *map(len, words)])


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, COORDINATES): the name of the earliest dart of each coordinate, 0 for a document without elements.

    Darts fall on the plane of weight and rank at a rate of one per unit area, for each element anew but alike in
    all documents. In each unit layer of weight they are thrown in order of rank, so only those below the document's
    rank limit are made: about DARTS in all, whatever the weights are. A dart above the element's weight misses. Each
    has a random coordinate; coordinates that stay empty are thrown for again with twice the limit.
    """
    out = np.zeros((n_docs, COORDINATES), np.uint64)
    total = np.bincount(doc, weight, n_docs)
    todo = total > 0
    limit = DARTS / np.where(todo, total, 1)
    while todo.any():
        chosen = todo[doc]
        e, w, d = element[chosen], weight[chosen], doc[chosen]
        layers = np.ceil(w).astype(np.int64)
        row = np.repeat(np.arange(len(e)), layers)
        layer = np.arange(len(row)) - np.repeat(np.cumsum(layers) - layers, layers)
        source = mix64(e[row] + (layer.astype(np.uint64) + np.uint64(1)) * LAYER)
        room = w[row] - layer
        rank, owner = np.zeros(len(row)), d[row]
        darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        throw = 0
        while len(source):
            throw += 1
            seed = mix64(source + np.array([throw], np.uint64) * THROW)
            rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank < limit[owner]
            source, room, rank, owner, seed = (c[inside] for c in (source, room, rank, owner, seed))
            name = mix64(seed ^ NAME)
            hit = (name >> np.uint64(11)).astype(np.float64) * 2.0**-53 < room
            darts.append((owner[hit] * COORDINATES + (mix64(seed ^ PLACE) % np.uint64(COORDINATES)).astype(np.int64), rank[hit], name[hit]))
        cell, rank, name = (np.concatenate(c) for c in zip(*darts))
        order = np.argsort(rank, kind="stable")
        order = order[np.argsort(cell[order], kind="stable")]
        first = order[run_starts(cell[order])]
        flat = out.reshape(-1)
        flat[cell[first]] = name[first] | np.uint64(1)
        todo = todo & (out == 0).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return out


#: Pairs whose signatures agree in a smaller share are no links: 4.7 standard deviations below a similarity of 0.8.
MIN_AGREEMENT = 0.65
#: In buckets up to this size all pairs of different classes are compared as rows; in larger ones within a task.
SMALL_BUCKET = 64
#: Larger buckets than this are split by a further band, and so on up to MAX_SPLITS bands, which connects most of
#: their texts; what is still of different classes is then compared in blocks, two of which are as large as this.
LARGE_BUCKET = 4_096
#: ... or hold more bytes of text than this.
LARGE_BYTES = 32_000_000
MAX_SPLITS = 4
SIGNED = "id long, h long, c1 long, c2 long, size long, bands array<long>, marks binary, sig binary"


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS): a hash of each band's coordinates, different in each band."""
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS) * (2 * np.arange(ROWS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return mix64(mix64(parts).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, hashes, texts, _ in chunks(batches, lambda text, size, overlap: [(0, text)], row=DOCUMENT_BYTES):
        doc, element, weight, counts, whole = shingles(texts)
        signature = signatures(doc, element, weight, len(texts))
        bands = band_keys(signature).view(np.int64)
        short = (signature >> np.uint64(8)).astype(np.uint8)
        empty = counts == 0
        yield arrow({
            "id": ids,
            "h": hashes,
            "c1": np.where(empty, ids, whole.view(np.int64)),
            "size": np.array([len(t) for t in texts]),
            "c2": np.where(empty, hashes, mix64(whole + counts.astype(np.uint64)).view(np.int64)),
            "bands": [None if e else b for e, b in zip(empty, bands)],
            "marks": [b.astype(np.uint32).tobytes() for b in bands],
            "sig": [s.tobytes() for s in short],
        }, SIGNED)


def similarities(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The weighted Jaccard similarity of each pair's shingle counts; 0 where neither has a word."""
    d1, e1, w1, _, _ = shingles(left)
    d2, e2, w2, _, _ = shingles(right)
    d, e, w = np.concatenate((d1, d2)), np.concatenate((e1, e2)), np.concatenate((w1, w2))
    order = np.lexsort((e, d))
    d, e, w = d[order], e[order], w[order]
    twin = np.flatnonzero((d[1:] == d[:-1]) & (e[1:] == e[:-1]))
    shared = np.bincount(d[twin], np.minimum(w[twin], w[twin + 1]), len(left))
    every = np.bincount(d, w, len(left)) - shared
    return shared / np.maximum(every, 1)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree enough to be worth a check."""
    for part in slices(batches):
        x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sig_a", "sig_b"))
        yield part.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= MIN_AGREEMENT))


def _similar(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs that reach the threshold, by their whole texts."""
    for part in slices(batches):
        linked = similarities(encoded(part.column("text_a")), encoded(part.column("text_b"))) >= threshold - 1e-9
        yield part.select(["a", "b"]).filter(pa.array(linked))


def _compare_bucket(table: pa.Table, threshold: float) -> pa.Table:
    """Links between different classes of one large bucket: members outside the largest class are compared with all others."""
    _, group = np.unique(table.column("class").to_numpy(), return_inverse=True)
    rest = np.flatnonzero(group != np.bincount(group).argmax())
    return _links(table, threshold, group, rest, np.ones(len(group), bool))


def _compare_blocks(table: pa.Table, threshold: float) -> pa.Table:
    """Links between different classes of two blocks of an oversized bucket, or within one block."""
    _, group = np.unique(table.column("class").to_numpy(), return_inverse=True)
    block, first, second = (table.column(c).to_numpy() for c in ("block", "i", "j"))
    return _links(table, threshold, group, np.flatnonzero(block == first), block == second)


def _links(table: pa.Table, threshold: float, group: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """Links of the members ``left`` to members of the mask ``right`` in other classes (``group``); all share the bands of ``path``.

    Compared are those whose signatures agree enough and that share no band before the path's last one but those of
    the path: else an earlier bucket has the pair.
    """
    path = table.column("path")[0].as_py()
    texts = encoded(table.column("text").combine_chunks())
    doc, element, weight, _, _ = shingles(texts)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    total = np.bincount(doc, weight, len(texts))
    signature = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    bands = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint32).reshape(-1, BANDS)[:, [b for b in range(path[-1]) if b not in path]]
    node = table.column("node").to_numpy()
    found = []
    for x in left:
        other = np.flatnonzero(right & (group != group[x]))
        other = other[(signature[other] == signature[x]).mean(axis=1) >= MIN_AGREEMENT]
        other = other[~(bands[other] == bands[x]).any(axis=1)]
        if not len(other):
            continue
        n = edges[other + 1] - edges[other]
        at = np.repeat(edges[other] - np.cumsum(n) + n, n) + np.arange(n.sum())
        own, own_weight = element[edges[x] : edges[x + 1]], weight[edges[x] : edges[x + 1]]
        place = np.minimum(np.searchsorted(own, element[at]), len(own) - 1)
        both = np.where(own[place] == element[at], np.minimum(own_weight[place], weight[at]), 0)
        shared = np.bincount(np.repeat(np.arange(len(other)), n), both, len(other))
        linked = other[shared / (total[other] + total[x] - shared) >= threshold - 1e-9]
        linked = linked[np.unique(group[linked], return_index=True)[1]]
        found += [(node[x], node[y]) for y in linked]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return in_table(arrow({"a": pairs[:, 0], "b": pairs[:, 1]}, "a long, b long"))


def in_blocks(oversized: DataFrame) -> DataFrame:
    """Deals the members of oversized buckets (key, path, node, class) to block pairs that cover all pairs of different classes.

    Adds ``block`` and the pair ``i``, ``j`` (i <= j). Members outside a bucket's largest class fill its first blocks,
    each of which meets itself and all later ones; a block holds about half of LARGE_BUCKET members or LARGE_BYTES.
    """
    by_class = oversized.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    top = F.max(F.struct("n", "class", "bytes")).alias("top")
    sizes = by_class.groupBy("key").agg(top, F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter("n > top.n")
    blocks = lambda n, b: F.greatest(F.ceil(n / max(1, LARGE_BUCKET // 2)), F.ceil(b / (LARGE_BYTES // 2)))
    rest = blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes"))
    shape = sizes.select("key", F.col("top.class").alias("main"), rest.alias("n_rest"), blocks(F.col("top.n"), F.col("top.bytes")).alias("n_main"))
    h, is_main = F.xxhash64("node"), F.col("class") == F.col("main")
    place = F.when(is_main, F.col("n_rest") + F.pmod(h, "n_main")).otherwise(F.pmod(h, "n_rest"))
    last = F.col("n_rest") - 1 + F.when(is_main, 0).otherwise(F.col("n_main"))
    dealt = oversized.join(small(shape), "key").withColumn("block", place).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.select("key", "path", "node", "class", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node that each node of ``edges`` (a, b) is connected with, if it is another."""
    return least_neighbours(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).toDF("node", "class")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``class_id``, ``n_links`` and ``kept`` to each row of ``docs`` (doc_id, text; columns of these names are replaced).

    Documents are linked if the multisets of their 5-word shingles (words of ASCII letters and digits, lower-cased,
    and of all non-ASCII characters) have a weighted Jaccard similarity of ``threshold`` or more; a class is what
    links connect, and ``class_id`` its smallest doc_id (null if it has null ids only). ``kept`` is true for the
    class's first row alone, so for one document of each class. Texts of the same words are in one class from the
    start and take part as one. A text without words (or null) is a class of its own; rows that are equal in id
    and text are of one class. ``n_links``: verified links of the document's text to other texts that were needed
    to connect the class. Very long texts are hashed in segments, and their shingles compared as one document's.

    Every pair that shares a band of the signature is a candidate (a pair at 0.8 shares none in 3 of a million
    cases). In each band's bucket all members are first compared with one centre. Then members of different classes
    are compared with each other: as rows in buckets of up to SMALL_BUCKET texts, within a task in buckets of up to
    LARGE_BUCKET texts and LARGE_BYTES. Still larger buckets are first split by a second band, a third and a fourth, which connects most of
    their texts; then all their pairs that are still of different classes are compared in blocks, a task for every two.
    """
    keyed, ids = with_identity(docs.drop("class_id", "n_links", "kept"))
    texts = keyed.select(F.col("_vg_id").alias("id"), F.col("_vg_h").alias("h"), "text")
    signed = cut(texts.mapInArrow(_sign, SIGNED))
    least = signed.groupBy("c1", "c2").agg(F.min(F.struct("id", "h")).alias("first"))
    # Nodes are the distinct word sequences, numbered; the numbers are written down before they are used.
    own = least.select("c1", "c2", "first.id", "first.h")
    heads = cut(
        signed.join(own, ["c1", "c2", "id", "h"]).dropDuplicates(["c1", "c2"]).filter("bands IS NOT NULL")
        .select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "id", "h", "size", "bands", "marks", "sig")
    )
    placed = heads.select("node", "size", F.posexplode("bands").alias("band", "key"))
    buckets = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("centre")).filter("n > 1")
    members = cut(placed.join(buckets, "key"))
    candidates = heads.select("node", "id", "h").join(members.select("node").distinct(), "node")
    bodies = cut(texts.join(small(candidates), ["id", "h"]).select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        with_texts = pairs.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
            bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
        )
        return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _similar(it, threshold), "a long, b long")

    stars = members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = cut(verified(stars))
    classes = components(links)
    classed = members.join(classes, "node", "left").select("key", "band", "node", "size", "n", "bytes", F.coalesce("class", "node").alias("class"))
    split = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("key")
    open_ = cut(classed.join(split, "key"))
    few = open_.filter(F.col("n") <= SMALL_BUCKET)
    left = few.select("key", F.col("node").alias("a"), F.col("class").alias("class_a"))
    right = few.select("key", F.col("node").alias("b"), F.col("class").alias("class_b"))
    pairs = left.join(right, "key").filter("a > b AND class_a <> class_b").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    signs = heads.select("node", "sig")
    agreeing = (
        pairs.join(signs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(signs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_agreeing, "a long, b long")
    )
    marked = heads.select("node", "marks", "sig")
    large, found = open_.filter(F.col("n") > SMALL_BUCKET).select("key", "node", "size", "class", "n", "bytes", F.array("band").alias("path")), []
    oversized = None
    for depth in range(MAX_SPLITS):
        fits = (F.col("n") <= LARGE_BUCKET) & (F.col("bytes") <= LARGE_BYTES)
        fitting = large.filter(fits).join(marked, "node").join(bodies, "node")
        found.append(
            fitting.select("key", "path", "node", "class", "marks", "sig", "text").groupBy("key").applyInArrow(
                lambda table: _compare_bucket(table, threshold), "a long, b long"
            )
        )
        giant = cut(large.filter(~fits))
        if giant.isEmpty():
            break
        oversized = giant if oversized is None else oversized
        if depth + 1 == MAX_SPLITS:
            break
        finer = giant.join(heads.select("node", F.posexplode("bands").alias("band", "more")), "node").filter(F.col("band") > F.element_at("path", -1))
        finer = finer.select(F.xxhash64("key", "more").alias("key"), "node", "size", "class", F.concat("path", F.array("band")).alias("path"))
        sizes = finer.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("class").alias("lo"), F.max("class").alias("hi")
        ).filter("lo <> hi")
        large = cut(finer.join(sizes.select("key", "n", "bytes"), "key"))
    within = reduce(DataFrame.unionByName, found)
    links = cut(links.unionByName(verified(agreeing)).unionByName(within).distinct())
    classes = components(links)
    if oversized is not None:
        blocks = in_blocks(oversized.drop("class").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")))
        across = (
            blocks.join(marked, "node").join(bodies, "node")
            .groupBy("key", "i", "j").applyInArrow(lambda table: _compare_blocks(table, threshold), "a long, b long")
        )
        links = cut(links.unionByName(across).distinct())
        classes = components(links)
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    # A class's first document is the least of its heads.
    in_class = heads.select("node", "c1", "c2", F.struct("id", "h").alias("own")).join(
        classes.unionByName(classes.select(F.col("class").alias("node"), "class")).distinct(), "node"
    )
    firsts = in_class.groupBy("class").agg(F.min("own").alias("class_first"))
    linked = in_class.join(firsts, "class").join(degrees, "node", "left").select("c1", "c2", "class_first", "n_links")
    known = least.join(cut(linked), ["c1", "c2"], "left").select("c1", "c2", F.coalesce("class_first", "first").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    is_first = (F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h"))
    class_id = F.when(F.col("first.h").bitwiseAND(F.lit(1)) == 0, F.col("first.id"))  # else the class has null ids only
    judged = signed.select("id", "h", "c1", "c2").dropDuplicates(["id", "h"]).join(known, ["c1", "c2"])
    judged = judged.select("id", "h", class_id.alias("class_id"), "n_links", is_first.alias("kept"))
    if ids is not None:
        judged = judged.join(ids.select(F.col("id").alias("class_id"), "term"), "class_id", "left").drop("class_id").withColumnRenamed("term", "class_id")
    first = F.row_number().over(Window.partitionBy("_vg_id", "_vg_h").orderBy("_vg_id")) == 1  # of equal rows
    found = judged.select(F.col("id").alias("_vg_id"), F.col("h").alias("_vg_h"), "class_id", "n_links", "kept")
    return keyed.join(found, ["_vg_id", "_vg_h"]).withColumn("kept", F.col("kept") & first).drop("_vg_id", "_vg_h")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")
