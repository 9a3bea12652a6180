"""Loops, parallel and reciprocal edges, literals, blank nodes, sources, empty tables; brute force on random graphs."""

import itertools
import random

import pytest

from veingraph.functions.terms import CONNECTED, TYPE
from veingraph.operators import clustering, components, degree, pagerank, profile, summary, traversal, triangles


def graph(spark, rows):
    return spark.createDataFrame(sorted(set(rows)), "s string, p string, o string")


def edges(spark, pairs, p=CONNECTED):
    return graph(spark, [(f"node:{a}", p, f"node:{b}") for a, b in pairs])


def pairs(df):
    return {tuple(r) for r in df.collect()}


def naive_shapes(rows):
    counts = {}
    for e1, e2, e3 in itertools.product(rows, repeat=3):
        (a, b), (c, d), (e, f) = (x[::2] for x in (e1, e2, e3))
        found = []
        if b == c and d == e and f == a:
            found.append(a)
        if d == b and e == c and f == a:
            found.append(a)
        if d == a and e == c and f == b:
            found.append(b)
        if d == b and e == a and f == c:
            found.append(a)
        for v in found:
            counts[v] = counts.get(v, 0) + 1
    return counts


@pytest.mark.parametrize("seed", range(4))
def test_triangles_of_random_multigraphs(spark, seed):
    rng = random.Random(seed)
    names = [f"node:{i}" for i in range(6)] + ['"lit"', "_:b"]
    rows = sorted({(rng.choice(names), rng.choice(["urn:p", "urn:q"]), rng.choice(names)) for _ in range(24)})
    t = graph(spark, rows)
    text = lambda v: None if v.startswith("_:") else v.strip('"')
    up = down = trans = 0
    for e1, e2, e3 in itertools.product(rows, repeat=3):
        if e1[2] == e2[0] and e2[2] == e3[0] and e3[2] == e1[0]:
            x, y, z = text(e1[0]), text(e2[0]), text(e3[0])
            if None not in (x, y, z):
                up += x < y < z
                down += y > z > x
        trans += e1[2] == e2[0] and e3[0] == e1[0] and e3[2] == e2[2]
    assert tuple(triangles.triangle_count_directed_parts(t).first()) == (up, down, trans)
    assert dict(pairs(triangles.vertex_triangles(t).filter("count > 0"))) == naive_shapes(rows)
    und = set()
    for p in ("urn:p", "urn:q"):
        linked = {frozenset((s, o)) for s, q, o in rows if q == p and s != o}
        vs = [v for v in names if not v.startswith("_:")]
        und |= {(p, frozenset(c)) for c in itertools.combinations(vs, 3) if all(frozenset(e) in linked for e in itertools.combinations(c, 2))}
    assert triangles.triangle_count_undirected(t).first()[0] == len(und)


def test_labels_multiply_degrees(spark):
    t = graph(spark, [("a", TYPE, "X"), ("a", TYPE, "Y"), ("a", "urn:p", "b"), ("b", "urn:p", "a"), ("c", "urn:p", "a")])
    assert pairs(degree.degree_dist_label(t, TYPE)) == {(6, 1)}
    assert pairs(degree.degree_dist_label(t, TYPE, "X")) == {(3, 1)}
    assert pairs(degree.degree_node_type(t)) == {("a", "X", 5), ("a", "Y", 5)}
    assert degree.degree_max(t).first()[0] == 5


def test_source_vertex_keeps_its_rank(spark):
    found = pagerank.pagerank(edges(spark, [(1, 2), (2, 3), (3, 2)]), limit=3, tolerance=0.0)
    by = {r["vertex"]: r["pagerank"] for r in found.ranks.collect()}
    assert by["node:1"] == pytest.approx(1 / 3)
    shell = pagerank.shell_pagerank(edges(spark, [(1, 2), (2, 3), (3, 2)]), max_iterations=1)
    assert {r["s"]: r["newPR"] for r in shell.ranks.collect()}["node:1"] == pytest.approx(1 / 3 * 0.15 + 0.15 / 3)


def test_shell_degrees_are_of_all_predicates(spark):
    t = graph(spark, [("a", "urn:p", "b"), ("a", "urn:q", '"5"'), ("b", "urn:p", "a")])
    by = {r["s"]: r["newPR"] for r in pagerank.shell_pagerank(t, "urn:p", max_iterations=1).ranks.collect()}
    assert by["b"] == pytest.approx(0.85 * (1 / 2) / 2 + 0.15 / 2)
    assert by["a"] == pytest.approx(0.85 * (1 / 2) / 1 + 0.15 / 2)


def test_ten_sorts_before_two(spark):
    t = edges(spark, [(10, 2), (3, 4), (4, 5)])
    assert pairs(components.connected_components(t)) == {
        ("node:10", "node:10"), ("node:2", "node:10"), ("node:3", "node:3"), ("node:4", "node:3"), ("node:5", "node:3"),
    }


def test_components_of_long_chains_and_blanks(spark):
    chain = edges(spark, [(i, i + 1) for i in range(1000, 1200)])
    assert {r["label"] for r in components.connected_components(chain).collect()} == {"node:1000"}
    t = graph(spark, [("_:b", CONNECTED, "x"), ("x", CONNECTED, "y")])
    assert pairs(components.connected_components(t)) == {("_:b", "_:b"), ("x", "x"), ("y", "x")}


def test_peer_pressure_oscillates(spark):
    found = clustering.peer_pressure(edges(spark, [(1, 2)]), max_iterations=4)
    assert found.changed == [2, 2, 2, 2]
    assert clustering.peer_pressure(edges(spark, [(1, 2)]), 20, percent_threshold=0.01, vertices_threshold=4).changed == [2]


def test_empty_tables(spark):
    t = graph(spark, [("a", "p", "b")]).filter("s = 'none'")
    assert triangles.triangle_count_undirected(t).first()[0] == 0
    assert tuple(triangles.triangle_count_directed_parts(t).first()) == (0, 0, 0)
    assert degree.degree_distribution(t).count() == 0
    assert pagerank.pagerank(t).ranks.count() == 0
    assert pagerank.shell_pagerank(t, "p").ranks.count() == 0
    assert components.connected_components(t).count() == 0
    assert clustering.peer_pressure(t).labels.count() == 0
    assert traversal.diameter(t).first()[0] is None
    for name, metric in summary.METRICS.items():
        assert metric(t).count() <= 1, name
    assert profile.network_stats(t).first()[0] == 0


def test_implicit_hierarchies(spark):
    rows = [("a", TYPE, "Dog"), ("b", TYPE, "Dog"), ("a", TYPE, "Animal"), ("b", TYPE, "Animal"), ("c", TYPE, "Animal")]
    rows += [("x", "urn:owns", "a"), ("x", "urn:has", "a"), ("y", "urn:has", "b")]
    t = graph(spark, rows)
    assert pairs(summary.implicit_class_hierarchy(t)) == {("Dog", "Animal")}
    assert pairs(summary.implicit_prop_hierarchy(t)) == {("urn:owns", "urn:has")}


def test_aliases_cover_the_interactive_names():
    assert len(summary.METRICS) == 24 and len(summary.ALIASES) == 30


def test_predicate_statistics_need_all_numbers(spark):
    t = graph(spark, [("a", "p", '"1"'), ("b", "p", '"3"'), ("a", "q", '"1"'), ("a", "q", "iri")])
    by = {r["pred"]: r for r in profile.pred_stats_all(t).collect()}
    assert (by["p"]["min"], by["p"]["max"], by["p"]["avg"]) == (1.0, 3.0, 2.0)
    assert by["q"]["avg"] is None and by["q"]["min_text"] == "1" and by["q"]["distinct_objects"] == 2
