"""Graph patterns, updates by pattern, stored profiles, entities, templates, the store's command line, extremes and components."""

import random

import pytest
from pyspark.sql import functions as F

from veingraph.functions.terms import CONNECTED, RDFS, TYPE
from veingraph.operators import components, traversal
from veingraph.operators.graphs import GraphStore
from veingraph.operators.patterns import construct, match
from veingraph.operators.profile import CREATED, MODIFIED, PROFILE
from veingraph.plans import cli, iteration
from veingraph.plans.templates import BlockTemplate
from veingraph.sources.entities import Entity, local_segment

NODES = [("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "c"), ("a", "age", '"5"'), ("b", "age", '"7"'), ("a", "knows", "c")]


@pytest.fixture
def store(spark):
    rows = spark.createDataFrame([(None, *t) for t in NODES] + [("urn:g", "x", "knows", "y")], "g string, s string, p string, o string")
    return GraphStore(spark, rows)


def triples_of(df):
    return {(r["s"], r["p"], r["o"]) for r in df.collect()}


def test_match(store):
    t = store.graph()
    assert {tuple(r) for r in match(t, [("?x", "knows", "?y"), ("?y", "age", "?n")]).select("x", "y", "n").collect()} == {("a", "b", '"7"')}
    assert [r["x"] for r in match(t, [("?x", "knows", "?x")]).collect()] == ["c"]
    assert match(t.union(t), [("a", "knows", "?y")]).count() == 2
    assert match(t, [("?x", "knows", "?y"), ("?y", "knows", "?z"), ("?z", "knows", "?w")]).count() == 4
    assert match(t, [("?x", "?p", "?y"), ("?y", "?p", "?z")]).count() == 4
    with pytest.raises(ValueError):
        match(t, [("?x", "knows", "?y"), ("?u", "age", "?v")])
    with pytest.raises(ValueError):
        match(t, [])


def test_construct(store):
    found = match(store.graph(), [("?x", "knows", "?y"), ("?x", "age", "?n")])
    assert triples_of(construct(found, [("?y", "knownBy", "?x"), ("?x", "of", "?none")])) == {("b", "knownBy", "a"), ("c", "knownBy", "a"), ("c", "knownBy", "b")}
    assert construct(found.filter("x = 'nobody'"), [("?y", "p", "?x")]).count() == 0
    assert construct(found, [("?x", "of", "?none")]).count() == 0


def test_updates_by_pattern(store):
    turned = store.modify([("?x", "knows", "?y")], [("?x", "knows", "?y")], [("?y", "knownBy", "?x")])
    assert triples_of(turned.graph()) == {t for t in NODES if t[1] == "age"} | {(o, "knownBy", s) for s, p, o in NODES if p == "knows"}
    assert triples_of(turned.graph("urn:g")) == {("x", "knows", "y")}
    assert triples_of(store.delete_where([("a", "?p", "?o")]).graph()) == {t for t in NODES if t[0] != "a"}
    copied = store.modify([("?x", "age", "?n")], insert=[("?x", "old", "?n")], into="urn:new")
    assert triples_of(copied.graph("urn:new")) == {("a", "old", '"5"'), ("b", "old", '"7"')} and copied.graph().count() == len(NODES)
    assert store.delete_where([("?x", "unknown", "?y")]).quads.count() == store.quads.count()


def test_stored_profile(store):
    once = store.profile("urn:p", "2024-01-01T00:00:00")
    found = triples_of(once.graph("urn:p"))
    assert ("urn:p", TYPE, f"{PROFILE}ProfileGraph") in found and sum(p in (CREATED, MODIFIED) for _, p, _ in found) == 8
    sizes = {s: {p: o for t, p, o in found if t == s} for s, p, o in found if o == f"{PROFILE}namedGraphCounts"}
    assert {r[f"{PROFILE}size"].split('"')[1] for r in sizes.values()} == {"6", "1"}
    # A profile leaves itself out, so a second one is the same; everything else stays.
    assert triples_of(once.profile("urn:p", "2024-01-01T00:00:00").graph("urn:p")) == found
    assert once.graph().count() == len(NODES) and store.profile("urn:p").graph("urn:p").count() == len(found)


def test_metadata(store):
    once = store.insert_metadata("urn:m")
    n = once.graph("urn:m").count()
    extra = once.insert(once.spark.createDataFrame([(f"{PROFILE}size", f"{RDFS}comment", '"stale"')], "s string, p string, o string"), "urn:m")
    assert extra.graph("urn:m").count() == n + 1 and extra.insert_metadata("urn:m").graph("urn:m").count() == n


def test_entities(store):
    a = Entity(store, "a", "")
    assert a.objects("knows") == ["b", "c"] and a.term("knows") == "b" and a.value("none", 3) == 3 and a.value("age") == "5"
    grown = a.add("size", 4).add("size", None).add("ok", True).set("knows", Entity(store, "d"))
    assert (grown.value("size"), grown.value("ok"), grown.objects("knows")) == (4, True, ["d"])
    assert grown.set("knows", None).objects("knows") == [] and store.graph().count() == len(NODES)
    assert Entity(store, "a", "urn:v#").predicate("knows") == "urn:v#knows"
    assert a.dump() == "a age=5 knows=b knows=c"
    assert [local_segment(x) for x in ("http://x/y#z", "http://x/y", "plain")] == ["z", "y", "plain"]


TEMPLATE = """--
#$ BLOCK COND
WHERE p = $o
#$ BLOCK BODY
FROM t
  #$ INCLUDE COND
#$ BLOCK ASKED
SELECT *
#$ INCLUDE BODY o='asked'
#$ BLOCK OWN x=own
#$ INCLUDE COND_OF
#$ BLOCK COND_OF o=block
${o}/${x}/${missing}
#$ BLOCK OVER
#$ INCLUDE COND_OF o=include
#$ BLOCK EACH
#$ FOREACH ITEM var=v list=vs
#$ BLOCK ITEM
item $v $$
#$ BLOCK LOOP
#$ INCLUDE LOOP
"""


def test_templates(spark):
    t = BlockTemplate(TEMPLATE)
    assert t.build("ASKED") == "SELECT *\nFROM t\n  WHERE p = 'asked'"
    assert t.build("ASKED", o=7) == "SELECT *\nFROM t\n  WHERE p = 7"
    assert t.build("BODY") == "FROM t\n  WHERE p = $o"
    assert t.build("OWN") == "block/own/${missing}" and t.build("OVER") == "include/${x}/${missing}"
    assert t.build("OVER", o="given", x=1) == "given/1/${missing}"
    assert t.build("EACH", vs=["a", "b"]) == "item a $\nitem b $" and t.build("EACH") == ""
    assert t.build("ASKED", COND="AND\nTRUE") == "SELECT *\nFROM t\n  AND\n  TRUE"
    assert t.build("ASKED", COND="ITEM", v=1) == "SELECT *\nFROM t\n  item 1 $" and t.build("ASKED", COND=None) == "SELECT *\nFROM t"
    assert t.build("UNKNOWN") == ""
    with pytest.raises(RecursionError):
        t.build("LOOP")
    found = BlockTemplate("--$ BLOCK Q\nSELECT id FROM {t} WHERE id > $n").query(spark, "Q", {"t": spark.range(5)}, n=2)
    assert [r[0] for r in found.orderBy("id").collect()] == [3, 4]


def test_store_commands(spark, tmp_path, capsys):
    path = tmp_path / "d.nt"
    path.write_text("<urn:a> <urn:p> <urn:b> .\n")
    run = lambda *args: cli.main(["--input", str(path), "--run", *args], spark)
    for name in ("one", "two", "three"):
        assert run("checkpoint", str(tmp_path / "cp"), name) == 0
    assert run("checkpoint_delete_first_n", str(tmp_path / "cp"), "1") == 0 and run("checkpoint_delete", str(tmp_path / "cp"), "three") == 0
    capsys.readouterr()
    assert run("checkpoint_list", str(tmp_path / "cp")) == 0 and capsys.readouterr().out.split() == ["two"]
    assert run("update", "<urn:a> <urn:p> <urn:c> .", str(tmp_path / "new")) == 0 and "1 triples before, 2 after" in capsys.readouterr().out
    assert run("query", "SELECT count(*) AS n FROM {triples}") == 0 and run("data_items") == 0 and run("db_validate") == 0
    assert run("profile", "urn:p", str(tmp_path / "prof")) == 0


def distances(edges):
    """{v: {w: distance}} within components, both ways."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for v in near:
        seen, frontier, level = {v: 0}, {v}, 0
        while frontier:
            level += 1
            frontier = {w for u in frontier for w in near[u]} - set(seen)
            seen |= {w: level for w in frontier}
        out[v] = seen
    return out


@pytest.mark.parametrize("seed", range(3))
def test_extremes_and_components_by_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(traversal, "PROBES", 2)
    rng = random.Random(seed)
    n, m = ((30, 32), (40, 90), (25, 20))[seed]
    edges = sorted({(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)})
    t = spark.createDataFrame([(a, CONNECTED, b) for a, b in edges], "s string, p string, o string")
    far = distances(edges)
    eccentricities = [max(d.values()) for d in far.values()]
    assert traversal.diameter(t).first()[0] == max(eccentricities)
    assert traversal.radius(t).first()[0] == min(eccentricities)
    labels = {r["node"]: r["label"] for r in components.connected_components(t).collect()}
    assert labels == {v: min(d) for v, d in far.items()}


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    df = spark.range(100).withColumn("texts", F.array(F.repeat(F.lit("x"), 1000)))
    assert iteration.small(df) is not df and iteration.small(df, rows=99) is df and iteration.small(df, size=50_000) is df
    nested = spark.range(3).select(F.array(F.struct(F.lit(1).alias("a"), F.array(F.lit("bc")).alias("b"))).alias("n"), F.lit(None).cast("string").alias("s"))
    assert iteration.small(nested) is not nested
