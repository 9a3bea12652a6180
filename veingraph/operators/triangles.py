"""Triangle counts.

All counts are built on one enumeration: vertex pairs are oriented from the lower to the higher degree, so that even
a hub has few outgoing pairs, and each triangle is found once, as a wedge at its lowest vertex that a third pair closes.
Parallel edges become multiplicities of pairs before any join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import is_blank, str_of
from veingraph.plans.iteration import BROADCAST_ROWS, Held, Numbering, dictionary, fetch, numbered, slices


#: A pair's edge counts each way in one column, 31 bits for each.
def _both_ways(out: Column, in_: Column) -> Column:
    return F.shiftleft(out, 31).bitwiseOR(in_)


def _one_way(counts: Column) -> Column:
    return F.shiftright(counts, 31)


def _other_way(counts: Column) -> Column:
    return counts.bitwiseAND(F.lit(2**31 - 1))


def _oriented(edges: DataFrame, by: list[str], held: Held, n: int, counted: bool) -> DataFrame:
    """(u, v, m, du, dv, *by) by u: each pair of vertices that edges (src, dst, *by) join, from its lower end to its higher one.

    ``m`` has the edges from u to v and those from v to u, if ``counted``; if edges have a ``kind`` too, one of each kind counts.
    Ends are ordered by degree, then id. The degrees of as many vertices of high degree as may be broadcast count; all others
    count as 0, so that no pair is shuffled for it.
    """
    kind = [c for c in ("kind",) if c in edges.columns]
    ends = edges.select(F.explode(F.array("src", "dst")).alias("x"), *by)
    degrees = held.sliced(slices(n), lambda within: ends.filter(within("x")).groupBy("x", *by).agg(F.count(F.lit(1)).alias("d")))
    least, taken = None, 0
    for d, vertices in sorted(map(tuple, fetch(degrees.groupBy("d").count())), reverse=True):
        taken += vertices
        if taken > BROADCAST_ROWS:
            break
        least = d
    high = degrees.filter(F.lit(False) if least is None else F.col("d") >= least)
    of = lambda end: F.broadcast(high.select(F.col("x").alias(end), F.col("d").alias(f"d_{end}"), *by))
    d_src, d_dst = F.coalesce("d_src", F.lit(0)), F.coalesce("d_dst", F.lit(0))
    c = F.col
    forward = (d_src < d_dst) | (d_src == d_dst) & (c("src") < c("dst"))
    pick = lambda x, y, name: F.when(forward, x).otherwise(y).alias(name)
    ranked = edges.join(of("src"), ["src", *by], "left").join(of("dst"), ["dst", *by], "left").select(
        pick(c("src"), c("dst"), "u"), pick(c("dst"), c("src"), "v"), pick(d_src, d_dst, "du"), pick(d_dst, d_src, "dv"), forward.alias("out"), *kind, *by
    )
    if counted:
        way = lambda x: F.count_if(x).cast("long")
        apart = (lambda d: d.distinct()) if kind else (lambda d: d)
        once = lambda d: apart(d).groupBy("u", "v", "du", "dv", *by).agg(_both_ways(way(c("out")), way(~c("out"))).alias("m"))
    else:
        once = lambda d: d.select("u", "v", "du", "dv", *by).distinct()
    found = held.by(ranked, "u", n, once, SLICE)
    held.drop(degrees)
    return found


#: Edges and wedges that a slice shuffles, about; into so many ranges ids are put; and in one of so many parts wedges are counted first.
SLICE, WEDGES, RANGES, PART = 30_000_000, 20_000_000, 1000, 16
#: Predicates that are told apart by a number at most.
KINDS = 64


def _closed_wedges(out: DataFrame, by: list[str], held: Held, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``made`` makes of (u, v, w, uv, vu, uw, wu, vw, wv, *by): every triangle of the pairs of :func:`_oriented`, once.

    ``u`` is its lowest vertex, ``v`` the next one; the other columns are the pairs' edge counts each way, if ``out`` has
    them. ``out`` is dropped here. ``made`` gets the triangles in slices of ``v``.
    """
    c = F.col
    counted = "m" in out.columns
    m = lambda name: [c("m").alias(name)] if counted else []
    n, most = out.agg(F.count(F.lit(1)), F.max("u")).first()
    # What closes a wedge leaves v, so w is between the ends of v's pairs: known for each vertex of high degree, and for ranges of ids of the others.
    place = lambda x, d: F.when(d > 0, x).otherwise(-1 - F.call_function("div", x, F.lit((most or 0) // RANGES + 1)))
    bounds = held.keep(out.groupBy(place(c("u"), c("du")).alias("place")).agg(F.min("v").alias("low"), F.max("v").alias("high")))
    higher = (c("dv") < c("dw")) | (c("dv") == c("dw")) & (c("v") < c("w"))

    def wedges(within):
        first = out.filter(within("v")).select("u", "v", *m("m_uv"), "dv", place(c("v"), c("dv")).alias("place"), *by)
        first = first.join(F.broadcast(bounds), "place")
        second = out.select("u", c("v").alias("w"), *m("m_uw"), c("dv").alias("dw"), *by)
        # A slice's pairs are few beside all pairs, so these are the side that a hash table is built of.
        return first.hint("shuffle_hash").join(second, ["u", *by]).filter(higher & c("w").between(c("low"), c("high")))

    def one(within):
        third = out.filter(within("u")).select(c("u").alias("v"), c("v").alias("w"), *m("m_vw"), *by)
        open_ = wedges(within).select("u", "v", "w", *["m_uv", "m_uw"] * counted, *by)
        closed = open_.join(third.hint("shuffle_hash"), ["v", "w", *by])
        counts = [f(c(f"m_{pair}")).alias(name) for pair in ("uv", "uw", "vw") for f, name in ((_one_way, pair), (_other_way, pair[::-1]))]
        return made(closed.select("u", "v", "w", *counts * counted, *by))

    parts = slices(n)
    if parts > 1 or n > WEDGES // 8:
        some = fetch(wedges(lambda column: F.pmod(F.xxhash64(F.lit(1), F.col(column)), F.lit(PART)) == 0).agg(F.count(F.lit(1))))[0][0]
        parts = max(parts, -(-some * PART // WEDGES))
    found = held.sliced(parts, one)
    held.drop(out)
    held.drop(bounds)
    return found


def _ends(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("s", "o")).alias("v"))


def _apart(coded: DataFrame) -> DataFrame:
    """Edges of two vertices; a null end is none."""
    return coded.filter("src <> dst")


def _undirected(triples: DataFrame, made: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Numbering]:
    """What ``made`` makes of slices of (x, y, z, p) of :func:`undirected_triangles` as ids, and what numbers them."""
    held = Held(triples.sparkSession)
    names, coded = numbered(held, triples.select("s", "o", "p"))
    if not names.plain():  # ids in order of STR, then of terms; two vertices of one STR make no pair
        held.drop(coded)
        named = lambda c: F.struct(str_of(F.col(c)).alias("text"), F.col(c).alias("term"))
        both = triples.filter(~is_blank(F.col("s")) & ~is_blank(F.col("o")))
        ids = dictionary(_ends(both).select(named("v").alias("v")))
        names = Numbering(None, ids.select("id", "term.term"))
        coded = held.keep(names.edges(both.filter(str_of(F.col("s")) != str_of(F.col("o"))).select("s", "o", "p"), "p"))
    edges = _apart(coded).filter("p IS NOT NULL")
    kinds = fetch(edges.select("p").distinct().limit(2))
    by = ["p"] if len(kinds) > 1 else []  # one predicate need not be shuffled with each row
    out = _oriented(edges, by, held, coded.count(), False)
    held.drop(coded)
    p = F.col("p") if by else F.lit(kinds[0]["p"] if kinds else None).cast("string").alias("p")
    corners = F.array_sort(F.array("u", "v", "w"))
    xyz = lambda found: found.select(corners.alias("c"), p).select(*[F.col("c")[k].alias(n) for k, n in enumerate("xyz")], "p")
    return _closed_wedges(out, by, held, lambda found: made(xyz(found))), names


def undirected_triangles(triples: DataFrame) -> DataFrame:
    """(x, y, z, p): triangles of one predicate, reciprocal edges being one, with STR(x) < STR(y) < STR(z).

    Blank nodes have no STR and take no part; literals do.
    """
    found, names = _undirected(triples, lambda found: found)
    for corner in "xyz":
        found = names.terms(found, corner)
    return found.select("x", "y", "z", "p")


def triangle_count_undirected(triples: DataFrame) -> DataFrame:
    found, _ = _undirected(triples, lambda found: found.agg(F.count(F.lit(1)).alias("n")))
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"))


def triangle_count_undirected_per_node(triples: DataFrame) -> DataFrame:
    """(x, count): triangles by their smallest vertex; vertices that are smallest in none are absent."""
    found, names = _undirected(triples, lambda found: found.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    return names.terms(found.groupBy("x").agg(F.sum("n").alias("count")), "x").select("x", "count")


def _kinds(coded: DataFrame, held: Held) -> DataFrame:
    """(src, dst, kind) for ``coded`` (src, dst, p), a number for each predicate; if these are many, (src, dst) of each edge once."""
    found = fetch(coded.select("p").distinct().limit(KINDS + 1))
    if len(found) > KINDS:
        once = held.by(coded, "src", coded.count(), lambda d: d.distinct())
        held.drop(coded)
        return held.instead(once, once.select("src", "dst"))
    kind = F.lit(0)
    for k, row in enumerate(found):
        kind = F.when(F.col("p").eqNullSafe(F.lit(row["p"])), k).otherwise(kind)
    return held.instead(coded, coded.select("src", "dst", kind.alias("kind")))


def _multiplicities(triples: DataFrame, held: Held, repeated: bool = False) -> tuple[Numbering, DataFrame, DataFrame]:
    """What numbers vertices, their pairs as :func:`_oriented` has them, and (v, loops). Both are written by ``held``.

    If ``repeated``, triples may be there several times and count once.
    """
    names, coded = numbered(held, triples.select("s", "o", *["p"] * repeated))
    if repeated:
        coded = _kinds(coded, held)
    pairs = _oriented(_apart(coded), [], held, coded.count(), True)
    at_one = coded.filter("src = dst")
    loops = held.keep((at_one.distinct() if "kind" in coded.columns else at_one).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("loops")))
    held.drop(coded)
    return names, pairs, loops


def _pair_loops(pairs: DataFrame, loops: DataFrame) -> DataFrame:
    """(v, w, out, in, loops): for each vertex v with loops, the pairs that it is in."""
    out, in_ = _one_way(F.col("m")), _other_way(F.col("m"))
    both = pairs.select(F.col("u").alias("v"), F.col("v").alias("w"), out.alias("out"), in_.alias("in")).unionByName(
        pairs.select("v", F.col("u").alias("w"), in_.alias("out"), out.alias("in"))
    )
    return both.join(loops, "v")


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def triangle_count_directed_parts(triples: DataFrame) -> DataFrame:
    """(cycles_up, cycles_down, transitive): directed triangles over any predicates, parallel edges counting each.

    A cycle x -> y -> z -> x from its smallest vertex x goes up if y < z in STR order, else down; blank nodes are in
    none, and no two vertices may share their STR. A transitive triad is x -> y -> z with x -> z, for any vertices:
    loops make degenerate ones.
    """
    held = Held(triples.sparkSession)
    names, pairs, loops = _multiplicities(triples, held)
    c = F.col
    plain = names.plain()
    if plain:
        t, apart = [c(x) for x in "uvw"], F.lit(True)
    else:  # ids are in order of terms: cycles follow the order of their STR
        t = [str_of(c(x)) for x in "uvw"]
        apart = t[0].isNotNull() & t[1].isNotNull() & t[2].isNotNull() & (t[0] != t[1]) & (t[0] != t[2]) & (t[1] != t[2])
    one, other = c("uv") * c("vw") * c("wu"), c("uw") * c("wv") * c("vu")
    even = ((t[0] < t[1]).cast("int") + (t[1] < t[2]).cast("int") + (t[2] < t[0]).cast("int")) == 2
    up, down = F.when(even, one).otherwise(other), F.when(even, other).otherwise(one)
    orders = [("u", "w", "v"), ("v", "u", "w"), ("v", "w", "u"), ("w", "u", "v"), ("w", "v", "u")]
    triads = sum((c(x + y) * c(y + z) * c(x + z) for x, y, z in orders), c("uv") * c("vw") * c("uw"))

    def made(found: DataFrame) -> DataFrame:
        if not plain:
            for corner in "uvw":
                found = names.terms(found, corner)
        return found.agg(_total(F.when(apart, up)).alias("cycles_up"), _total(F.when(apart, down)).alias("cycles_down"), _total(triads).alias("t"))

    at_loops = _pair_loops(pairs, loops).agg(_total(c("loops") * (c("out") * c("out") + c("in") * c("in") + c("out") * c("in"))).alias("t"))
    alone = loops.agg(_total(c("loops") * c("loops") * c("loops")).alias("t"))
    degenerate = held.keep(at_loops.unionByName(alone).agg(F.sum("t").alias("extra")))
    main = _closed_wedges(pairs, [], held, made).agg(*[_total(c(x)).alias(x) for x in ("cycles_up", "cycles_down", "t")])
    # Both sides are one row each.
    return main.join(F.broadcast(degenerate)).select("cycles_up", "cycles_down", (c("t") + c("extra")).alias("transitive"))


def triangle_count_directed(triples: DataFrame) -> DataFrame:
    return triangle_count_directed_parts(triples).select((F.col("cycles_up") + F.col("cycles_down") + F.col("transitive")).alias("count"))


def vertex_triangles(triples: DataFrame, repeated: bool = False) -> DataFrame:
    """(v, count): matches of the four directed shapes anchored at a vertex, which cover each orientation of a triangle once.

    For three vertices that is the product of the pairs' edge counts; loops add degenerate matches. If ``repeated``, triples may
    be there several times and count once, as if distinct, without a shuffle for it.
    """
    held = Held(triples.sparkSession)
    names, pairs, loops = _multiplicities(triples, held, repeated)
    c = F.col
    every = (c("uv") + c("vu")) * (c("uw") + c("wu")) * (c("vw") + c("wv"))
    near = _pair_loops(pairs, loops)
    out, in_, n = c("out"), c("in"), c("loops")
    # The loop is at the anchor (paired with either other corner), or at both other corners.
    anchored = near.select("v", (n * (2 * out * in_ + 2 * in_ * in_ + 2 * out * in_ + 2 * out * out)).alias("n"))
    opposite = near.select(c("w").alias("v"), (n * (2 * out * in_ + out * out + in_ * in_)).alias("n"))
    alone = loops.select("v", (4 * n * n * n).alias("n"))
    looped = held.keep(anchored.unionByName(opposite).unionByName(alone).groupBy("v").agg(F.sum("n").alias("n")))
    proper = _closed_wedges(
        pairs, [], held, lambda found: found.select(F.explode(F.array("u", "v", "w")).alias("v"), every.alias("n")).groupBy("v").agg(F.sum("n").alias("n"))
    )
    return names.terms(proper.unionByName(looped).groupBy("v").agg(F.sum("n").alias("count"))).select("v", "count")


def triangle_dist(triples: DataFrame, limit: int | None = None, repeated: bool = False) -> DataFrame:
    """(count, distribution): how many vertices have how many triangles, by count; vertices with none are left out."""
    per_vertex = vertex_triangles(triples, repeated).filter("count > 0")
    ordered = per_vertex.groupBy("count").agg(F.count(F.lit(1)).alias("distribution")).orderBy("count")
    return ordered if limit is None else ordered.limit(limit)


def triangle_dist_label(triples: DataFrame, predicate: str, value: str | None = None, limit: int | None = None) -> DataFrame:
    """:func:`triangle_dist` over vertices with (v, predicate, value); any value if None, once for each."""
    labels = triples.filter(F.col("p") == predicate)
    if value is not None:
        labels = labels.filter(F.col("o") == value)
    times = labels.groupBy(F.col("s").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    counted = vertex_triangles(triples).filter("count > 0").join(times, "v").select((F.col("count") * F.col("k")).alias("count"))
    ordered = counted.groupBy("count").agg(F.count(F.lit(1)).alias("distribution")).orderBy("count")
    return ordered if limit is None else ordered.limit(limit)
