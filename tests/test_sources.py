"""N-Triples, relational rows, named graphs, results, the command line, tracking and the stream."""

import pytest

from veingraph.functions import terms
from veingraph.operators.graphs import GraphStore
from veingraph.operators.profile import ask, profile
from veingraph.plans import catalog, cli, results
from veingraph.plans.tracking import Tracker, tracking_high, tracking_stats
from veingraph.sources import triples
from veingraph.streaming.ingest import running_degrees, running_predicates, stream_ntriples
from pyspark.sql import functions as F

TEXT = r"""# a comment
<urn:a> <urn:p> <urn:b> .
_:x <urn:p> "say \"hi\"\n\\n" .
<urn:a> <urn:q> "5"^^<http://www.w3.org/2001/XMLSchema#int> . # trailing
<urn:a> <urn:p> <urn:b> .
not a triple
<urn:a> <urn:q> "chat"@fr .
"""


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "data.nt"
    path.write_text(TEXT)
    return str(path)


def test_read_write_ntriples(spark, file, tmp_path):
    t = triples.read_ntriples(spark, file)
    rows = {tuple(r)[1:] for r in t.collect()}
    assert rows == {
        ("urn:a", "urn:p", "urn:b"), ("_:x", "urn:p", '"say "hi"\n\\n"'),
        ("urn:a", "urn:q", '"5"^^<http://www.w3.org/2001/XMLSchema#int>'), ("urn:a", "urn:q", '"chat"@fr'),
    }
    triples.write_ntriples(t, str(tmp_path / "out"))
    again = triples.read_ntriples(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in t.collect()}


def test_quads_round_trip(spark, tmp_path):
    store = GraphStore(spark).insert_data("<urn:a> <urn:p> <urn:b> .", "urn:g").insert_data("<urn:a> <urn:p> <urn:c> .")
    triples.write_ntriples(store.quads, str(tmp_path / "q"), with_graph=True)
    assert {tuple(r) for r in triples.read_ntriples(spark, str(tmp_path / "q")).collect()} == {tuple(r) for r in store.quads.collect()}


def test_terms(spark):
    rows = [("http://x/y#z",), ("_:b",), ('"5"^^<urn:int>',), ('"a"@en',)]
    t = spark.createDataFrame(rows, "t string").select(
        "t", terms.is_iri(F.col("t")), terms.str_of(F.col("t")), terms.num_of(F.col("t")), terms.datatype_of(F.col("t")), terms.local_name(F.col("t"))
    )
    got = {r[0]: tuple(r)[1:] for r in t.collect()}
    assert got["http://x/y#z"] == (True, "http://x/y#z", None, None, "z")
    assert got["_:b"][:3] == (False, None, None)
    assert got['"5"^^<urn:int>'][:4] == (False, "5", 5.0, "urn:int")
    assert got['"a"@en'][:3] == (False, "a", None)


def test_table_to_triples(spark):
    rows = spark.createDataFrame([(1, "a b", None, True), (2, None, 7, False)], "k int, name string, boss int, ok boolean")
    t = triples.table_to_triples(rows, "http://e/", "person", "k", references={"boss": "person"})
    got = {tuple(r)[1:] for r in t.collect()}
    assert ("http://e/person/2", "http://e/p#boss", "http://e/person/7") in got
    assert ("http://e/person/1", "http://e/p#name", f'"a b"^^<{terms.XSD}string>') in got
    assert ("http://e/person/1", "http://e/p#ok", f'"true"^^<{terms.XSD}boolean>') in got
    assert len(got) == 2 + 1 + 1 + 2


def test_graph_store(spark, file, tmp_path):
    store = GraphStore(spark).load(file).load(file, "urn:g")
    assert store.quads.count() == 8 and store.load(file).quads.count() == 8
    assert store.clear_default().quads.count() == 4 and store.clear("urn:none").quads.count() == 8
    assert store.drop("urn:g").quads.count() == 4 and store.clear_all().quads.count() == 0
    less = store.delete(spark.createDataFrame([("urn:a", "urn:p", "urn:b")], "s string, p string, o string"))
    assert less.graph().count() == 3 and less.graph("urn:g").count() == 4
    assert [r[0] for r in store.names().collect()] == ["urn:g"]
    count, restored = store.checkpoint(str(tmp_path / "snap"))
    assert count == 8 and restored.quads.count() == 8
    assert triples.load_snapshot(spark, str(tmp_path / "snap"), "urn:q").count() == 4
    sizes = {r["ngraph"]: r["size"] for r in profile(store.quads)["named_graphs"].collect()}
    assert sizes == {terms.DEFAULT_GRAPH: 4, "urn:g": 4}
    assert GraphStore(spark).insert_rdfs_namespace().quads.count() > 30
    assert ask(store.graph()) and not ask(store.clear_all().graph())


def test_results(spark, ring, tmp_path):
    path = results.write_result("triangle_count_undirected", catalog.run("triangle_count_undirected", ring), str(tmp_path))
    assert path.read_text() == "Number of Triangles: 4.\n" and path.parent.name == "Triangle Count Undirected"
    lines = [r[0] for r in results.format_result("degree_distribution", catalog.run("degree_dist", ring).withColumnRenamed("count", "frequency")).collect()]
    assert lines[0] == "Degree: 2, Frequency: 3"
    results.write_csv(catalog.run("degree_dist", ring), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    assert results.single_int(catalog.run("countTriples", ring)) == 12
    assert results.first_binding(catalog.run("predicates", ring)) == ["urn:connectedTo"]
    assert results.to_json(catalog.run("countTriples", ring)).first()[0] == '{"numtriples":12}'


def test_xml_results(spark, tmp_path):
    import xml.etree.ElementTree as tree

    rows = spark.createDataFrame([("urn:a", '"x < y"@en', 1), ("_:b", f'"5"^^<{terms.XSD}int>', None)], "s string, o string, n int")
    results.write_xml("all", rows, str(tmp_path / "r.xml"))
    root = tree.parse(tmp_path / "r.xml").getroot()
    space = "{http://www.w3.org/2005/sparql-results#}"
    assert [v.get("name") for v in root.iter(f"{space}variable")] == ["s", "o", "n"]
    found = [{b.get("name"): (b[0].tag.removeprefix(space), b[0].text, b[0].get("datatype")) for b in r} for r in root.iter(f"{space}result")]
    assert found == [
        {"s": ("uri", "urn:a", None), "o": ("literal", "x < y", None), "n": ("literal", "1", None)},
        {"s": ("bnode", "b", None), "o": ("literal", "5", f"{terms.XSD}int")},
    ]


def test_catalog(ring):
    assert catalog.run("pr", ring, shell=True, limit=3).count() == 3
    assert catalog.run("pp", ring, shell=True, predicate="urn:connectedTo").count() == 8
    with pytest.raises(KeyError, match="not implemented"):
        catalog.run("trustrank", ring, shell=True)


def test_command_line(spark, file, tmp_path, capsys):
    assert cli.main(["--input", file, "--run", "count_preds", "--stats"], spark) == 0
    assert "urn:p" in capsys.readouterr().out
    assert cli.main(["--input", file, "--csv", str(tmp_path / "c"), "--run", "degree_dist", "limit=1"], spark) == 0
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
    assert cli.main(["--input", file, "--run", "import", str(tmp_path / "snap")], spark) == 0
    assert "4 triples" in capsys.readouterr().out
    assert cli.main(["--input", str(tmp_path / "snap"), "--snapshot", "--run", "profile"], spark) == 0
    assert cli.main(["--input", file, "--run", "list"], spark) == 0
    assert "pagerank" in capsys.readouterr().out


def test_tracking(spark):
    tracker = Tracker()
    for _ in range(11):
        with tracker.track("query", "ctx"):
            pass
    with pytest.raises(RuntimeError), tracker.track("update"):
        raise RuntimeError
    log = tracker.log(spark)
    assert {(r["label"], r["count"]) for r in tracking_stats(log).collect()} == {("query", 11), ("update", 1)}
    assert [r["label"] for r in tracking_high(log).collect()] == ["query"]
    assert log.filter("status = 'error'").count() == 1


def test_stream(spark, file, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.nt").write_text(TEXT)
    stream = stream_ntriples(spark, str(folder))
    for name, counts in (("degrees", running_degrees(stream)), ("sizes", running_predicates(stream))):
        query = counts.writeStream.outputMode("complete").format("memory").queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM sizes").collect()} == {("urn:p", 3), ("urn:q", 2)}
    assert spark.sql("SELECT degree FROM degrees WHERE v = 'urn:b'").first()[0] == 2
