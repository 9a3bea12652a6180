"""What operators write: ids without a dictionary where terms allow it, slices, and few bytes an edge."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veingraph.functions.terms import CONNECTED
from veingraph.operators import clustering, diffusion, pagerank, traversal, triangles
from veingraph.plans import iteration
from veingraph.plans.queries import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    context = spark.sparkContext
    before = context._jsc.sc().getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    yield tmp_path
    if before.isDefined():
        context.setCheckpointDir(str(Path(before.get().removeprefix("file:")).parent))


def left_behind(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def graph(spark, n=2000, edges=20_000, seed=1):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(edges)}
    rows = [(f"http://example.org/some/long/name/of/a/node/{a}", CONNECTED, f"http://example.org/some/long/name/of/a/node/{b}") for a, b in sorted(pairs) if a != b]
    return spark.createDataFrame(rows, "s string, p string, o string").repartition(4)


def test_coding_keeps_terms_and_their_order(spark):
    terms = ["a:", "a:0", "a:00", "a:1", "a:10", "a:2", "a:999", "b/x", "é5", '"7"', "_:e12"]
    df = spark.createDataFrame([(t,) for t in terms], "v string")
    code = iteration.coding(df)
    rows = df.select("v", code.of(F.col("v")).alias("i")).withColumn("back", code.term(F.col("i"))).collect()
    assert all(r["v"] == r["back"] for r in rows)
    assert [r["v"] for r in sorted(rows, key=lambda r: r["i"])] == sorted(terms, key=str.encode)


@pytest.mark.parametrize("terms", [["a1", "a:1"], ["1", "x2"], ["a12345678901234567890"], [f"p{k}x" for k in range(65)], [None]])
def test_coding_leaves_other_terms_to_a_dictionary(spark, terms):
    assert iteration.coding(spark.createDataFrame([(t,) for t in terms], "v string")) is None


def test_slices_hold_every_row_once(spark, folder):
    held = iteration.Held(spark)
    df = spark.range(1000).withColumnRenamed("id", "v")
    assert sorted(r["v"] for r in held.sliced(3, lambda within: df.filter(within("v"))).collect()) == list(range(1000))


@pytest.mark.parametrize("ids", ["computed", "dictionary"])
def test_diffusion_by_slices(spark, folder, monkeypatch, ids):
    t = graph(spark, 200, 3000)
    start = t.first()["s"]
    scores = lambda: {r["vertex"]: r["score"] for r in diffusion.graph_diffusion(t, start, max_iterations=3).collect()}
    whole = scores()
    monkeypatch.setattr(iteration, "SLICE_ROWS", 2000)
    if ids == "dictionary":
        monkeypatch.setattr(iteration, "PREFIXES", 0)
    assert scores() == pytest.approx(whole)


def test_a_start_outside_the_graph(spark, folder):
    assert diffusion.graph_diffusion(graph(spark, 50, 200), "x:1", max_iterations=2).count() == 0


def test_diffusion_writes_few_bytes_an_edge(spark, folder):
    t = graph(spark)
    diffusion.graph_diffusion(t, t.first()["s"], max_iterations=2).count()
    assert left_behind(folder) < 20 * t.count()


def test_paper_diffusion_by_slices(spark, folder, monkeypatch):
    t = graph(spark, 100, 1000)
    scores = lambda: {r["vertex"]: r["score"] for r in diffusion.graph_diffusion(t, t.first()["s"], max_iterations=2, variant="paper").collect()}
    whole = scores()
    monkeypatch.setattr(iteration, "SLICE_ROWS", 500)
    assert scores() == pytest.approx(whole)


def test_levels_writes_few_bytes_an_edge(spark, folder):
    t = graph(spark)
    traversal.eccentricity(t, t.first()["s"]).count()
    assert left_behind(folder) < 20 * t.count()


def test_a_source_outside_the_graph(spark, folder):
    assert [tuple(r) for r in traversal.eccentricity(graph(spark, 50, 200), "x:1").collect()] == [("x:1", 0)]


def test_directed_triangles_writes_few_bytes_an_edge(spark, folder):
    t = graph(spark)
    triangles.triangle_count_directed(t).count()
    assert left_behind(folder) < 20 * t.count()


@pytest.mark.parametrize("ids", ["computed", "dictionary"])
def test_directed_triangles_by_slices(spark, folder, monkeypatch, ids):
    t = graph(spark, 120, 3000)
    whole = triangles.triangle_count_directed_parts(t).collect()
    monkeypatch.setattr(iteration, "SLICE_ROWS", 2000)
    monkeypatch.setattr(triangles, "BROADCAST_ROWS", 5)  # most vertices are ordered by their ids
    if ids == "dictionary":
        monkeypatch.setattr(iteration, "PREFIXES", 0)
    assert triangles.triangle_count_directed_parts(t).collect() == whole


def test_undirected_triangles_writes_few_bytes_an_edge(spark, folder):
    t = graph(spark)
    triangles.triangle_count_undirected_per_node(t).count()
    assert left_behind(folder) < 20 * t.count()


def test_undirected_triangles_by_slices(spark, folder, monkeypatch):
    t = graph(spark, 120, 3000)
    whole = triangles.triangle_count_undirected(t).collect(), sorted(triangles.triangle_count_undirected_per_node(t).collect())
    monkeypatch.setattr(iteration, "SLICE_ROWS", 2000)
    monkeypatch.setattr(triangles, "BROADCAST_ROWS", 5)
    assert (triangles.triangle_count_undirected(t).collect(), sorted(triangles.triangle_count_undirected_per_node(t).collect())) == whole


def test_triangle_dist_writes_few_bytes_an_edge(spark, folder):
    t = graph(spark)
    triangles.triangle_dist(t).count()
    assert left_behind(folder) < 20 * t.count()


def test_vertex_triangles_by_slices(spark, folder, monkeypatch):
    t = graph(spark, 120, 3000)
    whole = sorted(triangles.vertex_triangles(t).collect())
    monkeypatch.setattr(iteration, "SLICE_ROWS", 2000)
    monkeypatch.setattr(triangles, "BROADCAST_ROWS", 5)
    assert sorted(triangles.vertex_triangles(t).collect()) == whole


def test_pagerank_writes_few_bytes_an_edge(spark, folder):
    t = graph(spark)
    pagerank.pagerank(t, limit=3, directed=False, only_large_updates=True).ranks.count()
    assert left_behind(folder) < 20 * t.count()


def test_peer_pressure_writes_few_bytes_an_edge(spark, folder):
    t = graph(spark)
    clustering.peer_pressure(t, 3).labels.count()
    assert left_behind(folder) < 20 * t.count()


def test_peer_pressure_by_slices(spark, folder, monkeypatch):
    t = graph(spark, 120, 1000)
    whole = sorted(clustering.peer_pressure(t, 3, CONNECTED, CONNECTED, -1.0, -1).labels.collect())
    monkeypatch.setattr(iteration, "SLICE_ROWS", 500)
    assert sorted(clustering.peer_pressure(t, 3, CONNECTED, CONNECTED, -1.0, -1).labels.collect()) == whole


@pytest.mark.parametrize(
    "run",
    [
        lambda t: triangles.triangle_count_directed(t).collect(),
        lambda t: triangles.triangle_count_undirected(t).collect(),
        lambda t: triangles.vertex_triangles(t).collect(),
        lambda t: clustering.peer_pressure(t, 2, CONNECTED, CONNECTED, -1.0, -1).labels.collect(),
        lambda t: diffusion.graph_diffusion(t, "a:1", max_iterations=2, variant="paper").collect(),
    ],
    ids=["directed", "undirected", "vertex", "peer_pressure", "diffusion"],
)
def test_triples_are_evaluated_once(spark, folder, run):
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return f"a:{x}"

    t = spark.range(40).select(F.udf(see, "string").asNondeterministic()("id").alias("s"), F.lit(CONNECTED).alias("p"), F.concat(F.lit("a:"), F.col("id") * 7 % 40).alias("o"))
    run(t)
    assert seen.value == 40


def test_edge_counts_each_way_in_one_column(spark):
    n = 2**31 - 1
    counts = triangles._both_ways(F.col("x"), F.col("y"))
    df = spark.createDataFrame([(0, 0), (3, 5), (n, n), (0, n), (n, 0)], "x long, y long").withColumn("m", counts)
    assert all((r["x"], r["y"]) == (r["a"], r["b"]) for r in df.select("x", "y", triangles._one_way(F.col("m")).alias("a"), triangles._other_way(F.col("m")).alias("b")).collect())


def test_diffusion_slices_follow_the_gifts(spark, folder, monkeypatch):
    t = graph(spark, 100, 1000)
    monkeypatch.setattr(iteration, "SLICE_ROWS", 500)
    parts, sliced = [], iteration.Held.sliced
    monkeypatch.setattr(iteration.Held, "sliced", lambda self, n, one: parts.append(n) or sliced(self, n, one))
    diffusion.graph_diffusion(t, t.first()["s"], max_iterations=2, variant="paper").count()
    assert parts[0] == 1  # one vertex gives


@pytest.mark.parametrize("query", ["triangle_count_undirected", "triangle_dist"])
def test_links_are_written_without_a_shuffle(spark, folder, monkeypatch, query):
    plans, keep = [], iteration.Held.keep
    monkeypatch.setattr(iteration.Held, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    QUERIES[query](spark, "/root/testdata/sf0.001").collect()
    assert "lineitem" in plans[0] and "Exchange" not in plans[0]


def test_wedges_of_few_pairs_go_by_slices(spark, folder, monkeypatch):
    t = graph(spark, 120, 3000)
    whole = triangles.triangle_count_undirected(t).collect()
    parts, sliced = [], iteration.Held.sliced
    monkeypatch.setattr(iteration.Held, "sliced", lambda self, n, one: parts.append(n) or sliced(self, n, one))
    monkeypatch.setattr(triangles, "WEDGES", 10_000)
    assert triangles.triangle_count_undirected(t.union(t)).collect() == whole
    assert parts[-1] > 1


@pytest.mark.parametrize("kinds", [64, 2])
@pytest.mark.parametrize("ids", ["computed", "dictionary"])
def test_repeated_triples_count_once(spark, folder, monkeypatch, ids, kinds):
    rng = random.Random(3)
    rows = [(f"a:{rng.randrange(12)}", rng.choice(["x", "y", "z", None]), f"a:{rng.randrange(12)}") for _ in range(300)]
    t = spark.createDataFrame([*rows, ("a:1", "x", None), (None, "x", "a:1"), *rows[:150]], "s string, p string, o string")
    monkeypatch.setattr(triangles, "KINDS", kinds)
    if ids == "dictionary":
        monkeypatch.setattr(iteration, "PREFIXES", 0)
    assert sorted(triangles.vertex_triangles(t, repeated=True).collect()) == sorted(triangles.vertex_triangles(t.distinct()).collect())
