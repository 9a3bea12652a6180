"""The graph queries over the test tables by name, and SQL for the same rows.

Queries over ``links`` use the seven kinds of links; the class library's operators take one predicate, so for them all
links are relabelled to one (``simple``). Iterative queries fix their rounds, so that SQL can chain as many steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.functions.terms import CONNECTED, DEFAULT_GRAPH, OWL, RDF, RDFS, SKOS, TYPE, XSD
from veingraph.operators import clustering, components, degree, diffusion, pagerank, patterns, profile, summary, traversal, triangles, walk
from veingraph.operators.graphs import GraphStore
from veingraph.plans.iteration import shared_folder
from veingraph.plans.templates import BlockTemplate
from veingraph.plans.tracking import LOG_SCHEMA, tracking_high, tracking_stats
from veingraph.sources.driver_graph import LINKS, RICH, links, pairs, rich
from veingraph.sources.triples import ntriples_lines, parse_ntriples, table_to_triples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ROUNDS = 5
LABEL = "urn:placedBy"
START = "nation:7"
DIFFUSION_START = "region:1"


def simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links under one predicate, each pair once."""
    return pairs(spark, sf_dir).select("s", F.lit(CONNECTED).alias("p"), "o")


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links as often as rows have them, for operators that take each once by themselves: no shuffle before what they do."""
    return links(spark, sf_dir, once=False)


def default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich(spark, sf_dir).filter("g IS NULL").select("s", "p", "o")


def _sub(*predicates: str) -> Callable[[SparkSession, str], DataFrame]:
    """The links of some predicates, under one."""
    return lambda spark, sf: links(spark, sf).filter(F.col("p").isin(*predicates)).select("s", F.lit(CONNECTED).alias("p"), "o").distinct()


def add(name: str, source: Query, operator: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(source(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


T = f"WITH RECURSIVE t AS MATERIALIZED ({LINKS})"
E = f"WITH RECURSIVE t AS MATERIALIZED (SELECT DISTINCT s, '{CONNECTED}' AS p, o FROM ({LINKS}) l)"
Q = f"WITH RECURSIVE q AS MATERIALIZED ({RICH}), t AS MATERIALIZED (SELECT s, p, o FROM q WHERE g IS NULL)"
_BOTH = "(SELECT s AS v, p, o AS w FROM t UNION ALL SELECT o, p, s FROM t)"

# Degrees

_deg = f"SELECT v, count(*) AS degree FROM {_BOTH} GROUP BY v"
add("degree_distribution", links, degree.degree_distribution, f"{T} SELECT degree, count(*) AS frequency FROM ({_deg}) GROUP BY degree")
add("degree_dist", links, degree.degree_dist, f"{T} SELECT degree, count(*) AS count FROM ({_deg}) GROUP BY degree")
add("degree_dist_limit", links, lambda t: degree.degree_dist(t, 10), f"{T} SELECT degree, count(*) AS count FROM ({_deg}) GROUP BY degree ORDER BY degree LIMIT 10")
_labelled = f"SELECT v, count(*) AS degree FROM {_BOTH} b JOIN (SELECT s AS u FROM t WHERE p = '{{p}}' {{o}}) l ON b.v = l.u WHERE p <> '{{p}}' GROUP BY v"
add("degree_dist_label", links, lambda t: degree.degree_dist_label(t, "urn:inNation", "nation:3"),
    f"{T} SELECT degree, count(*) AS count FROM ({_labelled.format(p='urn:inNation', o="AND o = 'nation:3'")}) GROUP BY degree")
add("degree_dist_label_any", default, lambda t: degree.degree_dist_label(t, TYPE),
    f"{Q} SELECT degree, count(*) AS count FROM ({_labelled.format(p=TYPE, o='')}) GROUP BY degree")
add("degree_all", links, degree.degree_all, f"{T} {_deg}")
add("degree_in", links, degree.degree_in, f"{T} SELECT o AS v, count(*) AS degree FROM t GROUP BY o")
add("degree_out", links, degree.degree_out, f"{T} SELECT s AS v, count(*) AS degree FROM t GROUP BY s")
add("degree_max", links, degree.degree_max, f"{T} SELECT max(degree) AS max_degree FROM ({_deg})")
add("degree_node_type", default, degree.degree_node_type,
    f"{Q} SELECT d.v, x.o AS type, d.degree FROM ({_deg}) d JOIN (SELECT DISTINCT s, o FROM t WHERE p = '{TYPE}') x ON d.v = x.s")

# Triangles

_u = f"{E}, u AS MATERIALIZED (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b, p FROM t WHERE s <> o)"
_tri = "u x JOIN u y ON x.b = y.a AND x.p = y.p JOIN u z ON z.a = x.a AND z.b = y.b AND z.p = x.p"
add("triangle_count_undirected", lambda spark, sf: repeated(spark, sf).withColumn("p", F.lit(CONNECTED)), triangles.triangle_count_undirected,
    f"{_u} SELECT count(*) AS count FROM {_tri}")
add("triangle_count_undirected_per_node", simple, triangles.triangle_count_undirected_per_node, f"{_u} SELECT x.a AS x, count(*) AS count FROM {_tri} GROUP BY x.a")
_cycle = "t e1 JOIN t e2 ON e1.o = e2.s JOIN t e3 ON e2.o = e3.s AND e3.o = e1.s"
_parts = f"""SELECT
  (SELECT count(*) FROM {_cycle} WHERE e1.s < e2.s AND e2.s < e3.s) AS cycles_up,
  (SELECT count(*) FROM {_cycle} WHERE e2.s > e3.s AND e3.s > e1.s) AS cycles_down,
  (SELECT count(*) FROM t e1 JOIN t e2 ON e1.o = e2.s JOIN t e3 ON e3.s = e1.s AND e3.o = e2.o) AS transitive"""
add("triangle_count_directed_parts", links, triangles.triangle_count_directed_parts, f"{T} {_parts}")
add("triangle_count_directed", links, triangles.triangle_count_directed, f"{T} SELECT cycles_up + cycles_down + transitive AS count FROM ({_parts})")
add("triangle_count_multithread", links, triangles.triangle_count_directed, SQL["triangle_count_directed"])
_shapes = " UNION ALL ".join(
    f"SELECT e1.{a} AS t1 FROM t e1 JOIN t e2 ON {b} JOIN t e3 ON {c}"
    for a, b, c in (
        ("s", "e2.s = e1.o", "e3.s = e2.o AND e3.o = e1.s"),
        ("s", "e2.o = e1.o", "e3.s = e2.s AND e3.o = e1.s"),
        ("o", "e2.o = e1.s", "e3.s = e2.s AND e3.o = e1.o"),
        ("s", "e2.o = e1.o", "e3.s = e1.s AND e3.o = e2.s"),
    )
)
_per = f"SELECT t1, count(*) AS n FROM ({_shapes}) GROUP BY t1"
add("triangle_dist", repeated, lambda t: triangles.triangle_dist(t, repeated=True), f"{T} SELECT n AS count, count(*) AS distribution FROM ({_per}) GROUP BY n")
add("triangle_dist_label", links, lambda t: triangles.triangle_dist_label(t, "urn:inNation", "nation:3"),
    f"{T} SELECT n AS count, count(*) AS distribution FROM ({_per}) JOIN (SELECT s FROM t WHERE p = 'urn:inNation' AND o = 'nation:3') l ON t1 = l.s GROUP BY n")

# Breadth-first levels and components


def _levels(sources: str, bound: int = 8) -> str:
    """Chained steps: what each level adds to what was seen."""
    steps = [f"e AS MATERIALIZED (SELECT s AS v, o AS w FROM t UNION SELECT o, s FROM t), l0 AS MATERIALIZED (SELECT v AS source, v, 0 AS level FROM ({sources}))"]
    for k in range(1, bound + 1):
        steps.append(
            f"l{k} AS MATERIALIZED (SELECT * FROM l{k - 1} UNION ALL SELECT DISTINCT l.source, e.w, {k} FROM l{k - 1} l JOIN e ON l.v = e.v "
            f"WHERE l.level = {k - 1} AND NOT EXISTS (SELECT 1 FROM l{k - 1} x WHERE x.source = l.source AND x.v = e.w))"
        )
    return f"{', '.join(steps)}, ecc AS (SELECT source AS v, max(level) AS eccentricity FROM l{bound} GROUP BY source)"


def _least_labels(rounds: int = 14) -> str:
    """Chained rounds that give each vertex the least label around it, more of them than the graph is wide."""
    steps = ["e AS MATERIALIZED (SELECT s AS v, o AS w FROM t UNION SELECT o, s FROM t), c0 AS MATERIALIZED (SELECT DISTINCT v, v AS label FROM e)"]
    for k in range(1, rounds + 1):
        steps.append(f"c{k} AS MATERIALIZED (SELECT c.v, least(c.label, m.label) AS label FROM c{k - 1} c JOIN (SELECT e.v, min(x.label) AS label FROM e JOIN c{k - 1} x ON x.v = e.w GROUP BY e.v) m ON m.v = c.v)")
    return f"{', '.join(steps)} SELECT v AS node, label FROM c{rounds}"


add("eccentricity", simple, lambda t: traversal.eccentricity(t, START), f"{E}, {_levels(f"SELECT '{START}' AS v")} SELECT * FROM ecc")
# Of all vertices of the places' links; SQL searches from each of them.
_placed = f"WITH t AS MATERIALIZED (SELECT DISTINCT s, o FROM ({LINKS}) l WHERE p IN ('urn:inNation', 'urn:inRegion')), {_levels('SELECT s AS v FROM t UNION SELECT o FROM t', 6)}"
add("diameter", _sub("urn:inNation", "urn:inRegion"), traversal.diameter, f"{_placed} SELECT max(eccentricity) AS diameter FROM ecc")
add("radius", _sub("urn:inNation", "urn:inRegion"), traversal.radius, f"{_placed} SELECT min(eccentricity) AS radius FROM ecc")
add("connected_components", simple, components.connected_components, f"{E}, {_least_labels()}")
add("connected_components_placed", _sub(LABEL), components.connected_components,
    f"WITH RECURSIVE t AS MATERIALIZED (SELECT s, o FROM ({LINKS}) l WHERE p = '{LABEL}'), e AS MATERIALIZED (SELECT s AS v, o AS w FROM t UNION SELECT o, s FROM t), "
    "r AS (SELECT DISTINCT v, v AS w FROM e UNION SELECT r.v, e.w FROM r JOIN e ON r.w = e.v) SELECT v AS node, min(w) AS label FROM r GROUP BY v")

# PageRank

D = 0.85


def _pagerank_sql(directed: bool, guarded: bool) -> str:
    both = "SELECT s AS u, o AS v FROM t" + ("" if directed else " UNION ALL SELECT o, s FROM t")
    steps = [
        f"e AS MATERIALIZED ({both}), vs AS MATERIALIZED (SELECT s AS v FROM t UNION SELECT o FROM t), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM vs), "
        "d AS MATERIALIZED (SELECT u, count(*) AS k FROM e GROUP BY u), r0 AS MATERIALIZED (SELECT v, 1.0 / n AS r FROM vs, n)"
    ]
    for k in range(1, ROUNDS + 1):
        new = f"(SELECT e.v, {D} * sum(r.r / d.k) + {1 - D} / any_value(n.n) AS x FROM e JOIN r{k - 1} r ON r.v = e.u JOIN d ON d.u = e.u, n GROUP BY e.v)"
        keep = "CASE WHEN abs(x - r.r) >= 1.0 / n / 10 THEN x ELSE r.r END" if guarded else "x"
        steps.append(f"r{k} AS MATERIALIZED (SELECT r.v, coalesce({keep}, r.r) AS r FROM r{k - 1} r LEFT JOIN {new} y ON y.v = r.v, n)")
    return f"{E}, {', '.join(steps)} SELECT v AS vertex, round(r * n, 6) AS scaled FROM r{ROUNDS}, n"


def _scaled(ranks: DataFrame, value: str, n: int) -> DataFrame:
    """Ranks times N, rounded to what two engines' sums agree in."""
    key = next(c for c in ranks.columns if c != value)
    return ranks.select(key, F.round(F.col(value) * n, 6).alias("scaled"))


def _ranked(directed: bool, guarded: bool) -> Callable[[DataFrame], DataFrame]:
    def query(t: DataFrame) -> DataFrame:
        found = pagerank.pagerank(t, D, ROUNDS, directed, tolerance=None if guarded else 0.0, only_large_updates=guarded)
        return _scaled(found.ranks, "pagerank", found.ranks.count())

    return query


for _directed, _word in ((True, "directed"), (False, "undirected")):
    add(f"pagerank_{_word}", simple, _ranked(_directed, False), _pagerank_sql(_directed, False))
    add(f"pagerank_threshold_{_word}", simple, _ranked(_directed, True), _pagerank_sql(_directed, True))
add("test_algorithm", simple, _ranked(True, False), SQL["pagerank_directed"])

FLOW = "urn:placedBy"


def _shell_sql(directed: bool, reverse: bool = False) -> str:
    base = f"{Q.replace('SELECT s, p, o FROM q', 'SELECT o AS s, p, s AS o FROM q') if reverse else Q}"
    both = f"SELECT s AS u, o AS v FROM t WHERE p = '{FLOW}'" + ("" if directed else f" UNION ALL SELECT o, s FROM t WHERE p = '{FLOW}'")
    ends = "SELECT s AS u FROM t" + ("" if directed else " UNION ALL SELECT o FROM t")
    steps = [
        f"e AS MATERIALIZED ({both}), n AS MATERIALIZED (SELECT count(DISTINCT v)::DOUBLE AS n FROM (SELECT s AS v FROM t UNION ALL SELECT o FROM t) WHERE v NOT LIKE '\"%'), "
        f"d AS MATERIALIZED (SELECT u, count(*) AS k FROM ({ends}) GROUP BY u), vs AS MATERIALIZED (SELECT s AS v FROM t WHERE p = '{FLOW}' UNION SELECT o FROM t WHERE p = '{FLOW}'), "
        "r0 AS MATERIALIZED (SELECT v, 1.0 / n AS r FROM vs, n)"
    ]
    for k in range(1, ROUNDS + 1):
        new = f"(SELECT e.v, {D} * sum(r.r / d.k) + {1 - D} / any_value(n.n) AS x FROM e JOIN r{k - 1} r ON r.v = e.u JOIN d ON d.u = e.u, n GROUP BY e.v)"
        other = f"r.r * {1 - D} + {1 - D} / n" if directed else "r.r"
        steps.append(f"r{k} AS MATERIALIZED (SELECT r.v, coalesce(x, {other}) AS r FROM r{k - 1} r LEFT JOIN {new} y ON y.v = r.v, n)")
    return f"{base}, {', '.join(steps)} SELECT v AS s, round(r * n, 6) AS scaled FROM r{ROUNDS}, n"


def _shell(directed: bool, bad: bool, reverse: bool = False) -> Callable[[DataFrame], DataFrame]:
    def query(t: DataFrame) -> DataFrame:
        make = pagerank.shell_badrank if bad else pagerank.shell_pagerank
        found = make(t, FLOW, directed, None, D, 0.0, ROUNDS, reverse=reverse)
        n = t.select(F.explode(F.array("s", "o")).alias("v")).filter("v NOT LIKE '\"%'").distinct().count()
        return _scaled(found.ranks, "newBR" if bad else "newPR", n)

    return query


for _directed, _word in ((True, "directed"), (False, "undirected")):
    add(f"shell_pagerank_{_word}", default, _shell(_directed, False), _shell_sql(_directed))
    add(f"badrank_{_word}", default, _shell(_directed, True), _shell_sql(_directed))
add("badrank_reverse", default, _shell(True, True, True), _shell_sql(True, True))
add("abs_diff", simple, lambda t: pagerank.abs_diff(
    degree.degree_in(t).select("v", F.col("degree").cast("double").alias("rank")), degree.degree_out(t).select("v", F.col("degree").cast("double").alias("rank"))),
    f"{E} SELECT coalesce(sum(abs(b.n - a.n)), 0)::DOUBLE AS diff FROM (SELECT o AS v, count(*) AS n FROM t GROUP BY o) a JOIN (SELECT s AS v, count(*) AS n FROM t GROUP BY s) b USING (v)")

# Peer pressure and diffusion


def _peer_sql(rounds: int) -> str:
    steps = ["e AS MATERIALIZED (SELECT s AS u, o AS v FROM t UNION ALL SELECT o, s FROM t), l0 AS MATERIALIZED (SELECT DISTINCT u AS v, u AS l FROM e)"]
    for k in range(1, rounds + 1):
        votes = f"(SELECT e.v, l.l, count(*) AS n FROM e JOIN l{k - 1} l ON l.v = e.u GROUP BY e.v, l.l)"
        steps.append(f"l{k} AS MATERIALIZED (SELECT v, l FROM (SELECT v, l, row_number() OVER (PARTITION BY v ORDER BY n DESC, l) AS k FROM {votes}) WHERE k = 1)")
    return f"{E}, {', '.join(steps)} SELECT v AS node, l AS label FROM l{rounds}"


add("peer_pressure", simple, lambda t: clustering.peer_pressure(t, ROUNDS).labels, _peer_sql(ROUNDS))
add("shell_peer_pressure", simple, lambda t: clustering.peer_pressure(t, 3, CONNECTED, CONNECTED, -1.0, -1).labels, _peer_sql(3))


def _diffusion_sql(variant: str, rounds: int = 3) -> str:
    distinct = "DISTINCT" if variant == "beta" else ""
    steps = [f"e AS MATERIALIZED (SELECT s AS u, o AS v FROM t UNION ALL SELECT o, s FROM t), s0 AS MATERIALIZED (SELECT '{DIFFUSION_START}' AS v, 100.0::DOUBLE AS x)"]
    for k in range(1, rounds + 1):
        steps.append(f"g{k} AS MATERIALIZED (SELECT {distinct} e.v, s.x * 0.95::DOUBLE AS g FROM s{k - 1} s JOIN e ON e.u = s.v)")
        over = "1" if variant == "paper" else f"(SELECT count(*) FROM g{k})"
        steps.append(f"s{k} AS MATERIALIZED (SELECT v, sum(g) / {over} AS x FROM g{k} GROUP BY v)")
    return f"{E}, {', '.join(steps)} SELECT v AS vertex, round(x * {1 if variant == 'paper' else 1_000_000}, 6) AS scaled FROM s{rounds}"


for _variant in ("standard", "paper", "beta"):
    add("graph_diffusion" + (f"_{_variant}" if _variant != "standard" else ""), simple,
        lambda t, v=_variant: diffusion.graph_diffusion(t, DIFFUSION_START, 100.0, 0.95, 3, v).select("vertex", F.round(F.col("score") * (1 if v == "paper" else 1_000_000), 6).alias("scaled")),
        _diffusion_sql(_variant))

# Random walks, which digests steer


def _walk_sql(rounds: int, length: int = 10, n_paths: int = 1000) -> str:
    """All visits of chained rounds and steps, and each vertex's share of them."""
    steps = []
    for r in range(rounds):
        steps.append(f"w{r}_0 AS MATERIALIZED (SELECT md5('0/{r}/' || s) AS path, 0 AS step, s AS v FROM (SELECT DISTINCT s FROM t) ORDER BY path, v LIMIT {n_paths})")
        for k in range(1, length + 1):
            steps.append(
                f"w{r}_{k} AS MATERIALIZED (SELECT path, {k} AS step, o AS v FROM (SELECT w.path, e.o, md5('{k}/' || w.path || '/' || e.p || '/' || e.o) AS r "
                f"FROM w{r}_{k - 1} w JOIN t e ON e.s = w.v) QUALIFY row_number() OVER (PARTITION BY path ORDER BY r, o) = 1)"
            )
    every = " UNION ALL ".join(f"SELECT * FROM w{r}_{k}" for r in range(rounds) for k in range(length + 1))
    return f"{E}, {', '.join(steps)}, visits AS MATERIALIZED ({every}), ranks AS (SELECT v, count(*) / (SELECT count(*) FROM visits)::DOUBLE AS percentage FROM visits GROUP BY v)"


add("random_walk", simple, lambda t: walk.random_walk(t, 10, 1000, 2).ranks, f"{_walk_sql(3)} SELECT v AS vertex, percentage FROM ranks")
add("path_rank", simple, lambda t: walk.path_rank(walk.random_walk(t, 10, 1000, 1)).withColumn("score", F.round("score", 9)),
    f"{_walk_sql(2)}, met AS (SELECT path, v, min(step) AS step FROM visits GROUP BY ALL) "
    "SELECT path, round(sum(percentage), 9) AS score, string_agg(v, '->' ORDER BY step, v) AS nodes FROM met JOIN ranks USING (v) GROUP BY path ORDER BY round(sum(percentage), 12) DESC, path LIMIT 100")
add("random_node", simple, walk.random_node, f"{E} SELECT s FROM (SELECT DISTINCT s FROM t) ORDER BY md5('0/' || s), s LIMIT 1")

# Summary metrics

_types = f"(SELECT s AS i, o AS class FROM t WHERE p = '{TYPE}')"
_use = f"SELECT class, p AS property, count(DISTINCT s) AS numInstances FROM t JOIN {_types} x ON t.s = x.i WHERE p <> '{TYPE}' GROUP BY ALL"
_inst = f"SELECT class, count(DISTINCT i) AS numInstances FROM {_types} GROUP BY class"
_SUMMARY = {
    "num_triples": (summary.num_triples, "SELECT count(*) AS numtriples FROM t"),
    "distinct_edges": (summary.distinct_edges, 'SELECT DISTINCT p AS "DistinctEdges" FROM t'),
    "triples_per_edge": (summary.triples_per_edge, "SELECT p AS property, count(*) AS count FROM t GROUP BY p"),
    "edge_occurrence": (summary.edge_occurrence, "SELECT p AS property, count(DISTINCT s) AS numprop FROM t GROUP BY p"),
    "distinct_prop_per_object": (summary.distinct_prop_per_object, "SELECT p, count(DISTINCT o) AS num FROM t GROUP BY p"),
    "properties_per_subject": (summary.properties_per_subject, "SELECT s, count(DISTINCT p) AS num FROM t GROUP BY s"),
    "properties_per_object": (summary.properties_per_object, "SELECT o, count(DISTINCT p) AS num FROM t GROUP BY o"),
    "typed_subj": (summary.typed_subj, _inst),
    "class_triples": (summary.class_triples, f'SELECT class, count(*) AS "numTriplesPerClass" FROM t JOIN {_types} x ON t.s = x.i GROUP BY class'),
    "class_subjects": (summary.class_triples, f'SELECT class, count(*) AS "numTriplesPerClass" FROM t JOIN {_types} x ON t.s = x.i GROUP BY class'),
    "class_prop_occurrence": (summary.class_prop_occurrence, _use),
    "common_class_prop": (summary.common_class_prop, f"SELECT a.class, a.property FROM ({_use}) a JOIN ({_inst}) b ON a.class = b.class AND a.numInstances = b.numInstances"),
    "triples_edge_class": (summary.triples_edge_class, f'SELECT class, p AS property, count(*) AS "numUses" FROM t LEFT JOIN {_types} x ON t.s = x.i WHERE p <> \'{TYPE}\' GROUP BY ALL'),
    "tensor_histo": (summary.tensor_histo, f"SELECT a.class AS type1, p, b.class AS type2, count(DISTINCT (s, o)) AS count FROM t JOIN {_types} a ON t.s = a.i JOIN {_types} b ON t.o = b.i GROUP BY ALL"),
    "blank_subjects": (summary.blank_subjects, 'SELECT count(DISTINCT s) AS "numBlanks" FROM t WHERE starts_with(s, \'_:\')'),
    "isolated_blanks": (summary.isolated_blanks, f"""SELECT count(DISTINCT s) AS "numIsolatedBlanks" FROM t WHERE starts_with(s, '_:')
        AND NOT EXISTS (SELECT 1 FROM t x WHERE x.o = t.s)
        AND NOT EXISTS (SELECT 1 FROM t y JOIN t z ON z.s = y.p AND z.p = '{TYPE}' AND z.o = '{OWL}InverseFunctionalProperty' WHERE y.s = t.s)"""),
    "num_typed_subj": (summary.num_typed_subj, f"""SELECT (SELECT count(DISTINCT t.s) FROM t JOIN {_types} x ON x.i = t.s WHERE class <> '{RDFS}Resource' AND p <> '{TYPE}') AS "numTypedSubjects",
        (SELECT count(DISTINCT s) FROM t WHERE p <> '{TYPE}') AS "numSubjects\""""),
    "ontology_ratio": (summary.ontology_ratio, f"""SELECT count(DISTINCT CASE WHEN class IN ('{RDFS}Class', '{OWL}Class') THEN i END) AS "numDefClasses",
        count(DISTINCT CASE WHEN class = '{SKOS}Concept' THEN i END) AS "numDefConcepts", count(DISTINCT CASE WHEN class = '{RDF}Property' THEN i END) AS "numDefProperties",
        count(DISTINCT CASE WHEN class <> '{RDFS}Resource' THEN i END) AS "numTypedResources" FROM {_types}"""),
    "explicit_class_hierarchy": (summary.explicit_class_hierarchy, f"SELECT s AS subclass, o AS superclass FROM t WHERE p = '{RDFS}subClassOf' AND s <> o AND o <> '{RDFS}Resource'"),
    "explicit_prop_hierarchy": (summary.explicit_prop_hierarchy, f"SELECT s AS subprop, o AS superprop FROM t WHERE p = '{RDFS}subPropertyOf' AND s <> o"),
    "implicit_class_hierarchy": (summary.implicit_class_hierarchy, f"""SELECT DISTINCT a.class AS "subClass", b.class AS "superClass" FROM {_types} a JOIN {_types} b ON a.i = b.i AND a.class <> b.class
        WHERE b.class <> '{RDFS}Resource' AND NOT EXISTS (SELECT 1 FROM {_types} c WHERE c.class = a.class AND NOT EXISTS (SELECT 1 FROM {_types} d WHERE d.i = c.i AND d.class = b.class))"""),
    "implicit_prop_hierarchy": (summary.implicit_prop_hierarchy, """SELECT DISTINCT a.p AS "subProp", b.p AS "superProp" FROM t a JOIN t b ON a.s = b.s AND a.o = b.o AND a.p <> b.p
        WHERE (SELECT count(*) FROM t x WHERE x.p = a.p) = (SELECT count(*) FROM t x JOIN t y ON x.s = y.s AND x.o = y.o WHERE x.p = a.p AND y.p = b.p)"""),
    "namespace_links": (summary.namespace_links, f"""SELECT regexp_replace(s, '[^/#]*$', '') AS "NS1", p AS prop, regexp_replace(o, '[^/#]*$', '') AS "NS2", count(*) AS "numLinks" FROM t
        WHERE NOT starts_with(s, '_:') AND NOT starts_with(s, '"') AND NOT starts_with(o, '_:') AND NOT starts_with(o, '"') GROUP BY ALL"""),
    "namespace_links_faithful": (lambda t: summary.namespace_links(t, "faithful"), """SELECT s AS "NS1", p AS prop, o AS "NS2", count(*) AS "numLinks" FROM t
        WHERE NOT starts_with(s, '_:') AND NOT starts_with(s, '"') AND NOT starts_with(o, '_:') AND NOT starts_with(o, '"') GROUP BY ALL"""),
    "same_as": (summary.same_as, f"SELECT count(*) AS \"numSameAs\" FROM t WHERE p = '{OWL}sameAs'"),
    "count_pred_voc": (summary.count_pred_voc, "SELECT count(DISTINCT regexp_replace(p, '[^/#]*$', '')) AS \"numVocabularies\" FROM t"),
}
for _name, (_operator, _sql) in _SUMMARY.items():
    add(f"summary_{_name}", default, _operator, f"{Q} {_sql}")

# Profiles

_g = f"coalesce(g, '{DEFAULT_GRAPH}')"
_text = "regexp_extract(o, '^\"(.*)\"(\\^\\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1)"
_str = f"CASE WHEN starts_with(o, '\"') THEN {_text} WHEN NOT starts_with(o, '_:') THEN o END"
_num = f"CASE WHEN starts_with(o, '\"') THEN try_cast({_text} AS DOUBLE) END"
_all = f"count({_num}) = count(*)"
_stats = f"""p AS pred, count(*) AS count, count(DISTINCT o) AS distinct_objects, CASE WHEN {_all} THEN min({_num}) END AS min, CASE WHEN {_all} THEN max({_num}) END AS max,
  CASE WHEN {_all} THEN round(avg({_num}), 6) END AS avg"""
_ranged = f"FROM t WHERE p IN (SELECT s FROM t WHERE p = '{RDFS}range' AND o = '{{r}}') GROUP BY p"
add("count_default", rich, profile.count_graph, f"{Q} SELECT count(*) AS count FROM t")
add("count_graph", rich, lambda q: profile.count_graph(q, "urn:graph/nations"), f"{Q} SELECT count(*) AS count FROM q WHERE g = 'urn:graph/nations'")
add("count_type", rich, lambda q: profile.count_type(q, "urn:class/Customer"), f"{Q} SELECT count(*) AS count FROM t WHERE p = '{TYPE}' AND o = 'urn:class/Customer'")
add("count_type_graph", rich, lambda q: profile.count_type(q, "urn:class/Nation", "urn:graph/nations"), f"{Q} SELECT count(*) AS count FROM q WHERE g = 'urn:graph/nations' AND p = '{TYPE}' AND o = 'urn:class/Nation'")
add("count_preds", default, profile.count_preds, f"{Q} SELECT p AS pred, count(*) AS count FROM t GROUP BY p")
add("count_types", default, profile.count_types, f"{Q} SELECT o AS type, count(*) AS count FROM t WHERE p = '{TYPE}' GROUP BY o")
_rounded = lambda df: df.withColumn("avg", F.round("avg", 6))
add("pred_stats_all", default, lambda t: _rounded(profile.pred_stats_all(t)),
    f"{Q} SELECT {_stats}, min({_str}) AS min_text, max({_str}) AS max_text, min(s) AS sample_subject, min(o) AS sample_object FROM t GROUP BY p")
add("pred_stats_number", default, lambda t: _rounded(profile.pred_stats_number(t, f"{XSD}long")),
    f"{Q} SELECT {_stats}, min(s) AS sample_subject, min(o) AS sample_object {_ranged.format(r=f'{XSD}long')}")
add("pred_stats_nan", default, lambda t: profile.pred_stats_nan(t, f"{XSD}string"),
    f"{Q} SELECT p AS pred, count(*) AS count, count(DISTINCT o) AS distinct_objects, min(s) AS sample_subject, min(o) AS sample_object {_ranged.format(r=f'{XSD}string')}")
_short = f"replace(replace(replace(replace(replace({{}}, '{RDF}', 'rdf:'), '{RDFS}', 'rdfs:'), '{OWL}', 'owl:'), '{SKOS}', 'skos:'), '{XSD}', 'xsd:')"
_term = "CASE WHEN starts_with({0}, '\"') THEN regexp_extract({0}, '^\"(.*)\"(\\^\\^<[^>]*>|@[A-Za-z0-9-]+)?$', 1) WHEN NOT starts_with({0}, '_:') THEN {0} END"
add("show_all", default, profile.show_all,
    f"{Q} SELECT {', '.join(_short.format(_term.format(c)) + f' AS {c}_s' for c in 'spo')} FROM (SELECT * FROM t ORDER BY s, p, o LIMIT 10000)")
add("ask", default, profile.ask_nothing, f"{Q} SELECT count(*) > 0 AS answer FROM t WHERE p = '{TYPE}' AND o = '{RDFS}Class'")
add("profile_named_graphs", rich, profile.profile_named_graphs, f"{Q} SELECT {_g} AS ngraph, count(*) AS size FROM q GROUP BY 1")
add("profile_types", rich, profile.profile_types, f"{Q} SELECT {_g} AS ngraph, o AS type, count(*) AS \"typeCt\" FROM q WHERE p = '{TYPE}' GROUP BY ALL")
add("profile_predicates", rich, profile.profile_predicates, f"{Q} SELECT {_g} AS ngraph, p AS predicate, count(*) AS size FROM q GROUP BY ALL")
_net = """SELECT count(*) AS "edgeCt", count(DISTINCT s) AS "subjectCt", count(DISTINCT o) AS "objectCt", (SELECT count(*) FROM (SELECT s FROM {0} UNION SELECT o FROM {0})) AS "nodeCt" FROM {0}"""
add("network_stats", links, profile.network_stats, f"{T} {_net.format('t')}")
add("network_stats_predicate", links, lambda t: profile.network_stats(t, "urn:soldBy"), f"{T}, n AS (SELECT * FROM t WHERE p = 'urn:soldBy') {_net.format('n')}")
add("predicates", links, profile.distinct_predicates, f"{T} SELECT DISTINCT p FROM t")
add("predicate_graph", links, lambda t: profile.predicate_graph(t, "urn:soldBy"), f"{T} SELECT DISTINCT s, o FROM t WHERE p = 'urn:soldBy'")
QUERIES["counting_table"] = lambda spark, sf_dir: profile.counting_table(spark)
SQL["counting_table"] = 'SELECT a AS "from", b AS "to", unnest(range(a, b + 1))::INTEGER AS value FROM (VALUES (0, 9), (1, 10), (0, 29)) v(a, b)'

# Tracking: the events stand in for a log of operations.

_LOG = "SELECT event_type AS label, 'user ' || user_id % 4 AS context, value AS seconds, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS dbmem_used FROM events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=events)
    return log.selectExpr("label", "context", "0.0D AS start", "CAST(seconds AS DOUBLE) AS seconds", "CAST(dbmem_used AS DOUBLE) AS dbmem_used", "'ok' AS status")


assert [c.split()[0] for c in LOG_SCHEMA.split(", ")] == ["label", "context", "start", "seconds", "dbmem_used", "status"]
_rough = lambda df: df.withColumns({"seconds": F.round("seconds", 4), "avg": F.round("avg", 4)})
_track = f"""SELECT label, context, count(*) AS count, round(sum(seconds), 4) AS seconds, round(avg(seconds), 4) AS avg, min(seconds) AS min, max(seconds) AS max, max(dbmem_used) AS dbmem_max
  FROM ({_LOG}) GROUP BY label, context"""
add("tracking_stats", _log, lambda log: _rough(tracking_stats(log)), _track)
add("tracking_high", _log, lambda log: _rough(tracking_high(log)), f"SELECT * FROM ({_track}) WHERE seconds > 4 OR count > 10 OR dbmem_max > 100")

# Sources: rows to triples, and triples to lines and back.

_BASE = "http://example.org/"


def _supplier_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return table_to_triples(suppliers, _BASE, "supplier", "s_suppkey", ["s_name", "s_nationkey"], {"s_nationkey": "nation"}).select("s", "p", "o")


_RELATIONAL = f"""SELECT s, unnest(['{TYPE}', '{_BASE}p#s_name', '{_BASE}p#s_nationkey']) AS p, unnest(['{_BASE}supplier', '"' || s_name || '"^^<{XSD}string>', '{_BASE}nation/' || s_nationkey]) AS o
  FROM (SELECT '{_BASE}supplier/' || s_suppkey AS s, * FROM supplier)"""
QUERIES["table_to_triples"] = _supplier_triples
SQL["table_to_triples"] = _RELATIONAL
add("ntriples_round_trip", default, lambda t: parse_ntriples(ntriples_lines(t)).select("s", "p", "o"), f"{Q} SELECT s, p, o FROM t")


# Named graphs: loads, inserts, clears, updates by pattern, constructed triples and stored profiles

_MADE = "urn:graph/made"


def _store(spark: SparkSession, sf_dir: str) -> GraphStore:
    return GraphStore(spark, rich(spark, sf_dir))


def add_store(name: str, change: Callable[[GraphStore], GraphStore], sql: str) -> None:
    """A query for the quads that a change of the graph store leaves."""
    QUERIES[name] = lambda spark, sf_dir: change(_store(spark, sf_dir)).quads
    SQL[name] = f"WITH q AS MATERIALIZED (SELECT DISTINCT g, s, p, o FROM ({RICH}) r) {sql}"


def _loaded(store: GraphStore) -> GraphStore:
    """The nations' graph written as an N-Triples file, and that loaded into a graph of its own."""
    path = f"{shared_folder(store.spark)}/{uuid.uuid4()}"
    ntriples_lines(store.graph("urn:graph/nations")).write.text(path)
    return store.load(path, _MADE)


_KEEP = "SELECT g, s, p, o FROM q"
add_store("store_clear_default", GraphStore.clear_default, f"{_KEEP} WHERE g IS NOT NULL")
add_store("store_clear_graph", lambda store: store.clear("urn:graph/nations").clear("urn:graph/none"), f"{_KEEP} WHERE g IS DISTINCT FROM 'urn:graph/nations'")
add_store("store_clear_all", lambda store: store.clear_all().insert_data("<urn:a> <urn:b> <urn:c> ."), "SELECT NULL::VARCHAR AS g, 'urn:a' AS s, 'urn:b' AS p, 'urn:c' AS o")
add_store("store_load", _loaded, f"{_KEEP} UNION ALL SELECT '{_MADE}', s, p, o FROM q WHERE g = 'urn:graph/nations'")
add_store("store_insert_data", lambda store: store.insert_data('<nation:1> <urn:inRegion> <region:0> .\n<nation:1> <urn:note> "new"@en .\n<nation:1> <urn:note> "new"@en .', _MADE),
    f"{_KEEP} UNION SELECT '{_MADE}', 'nation:1', unnest(['urn:inRegion', 'urn:note']), unnest(['region:0', '\"new\"@en'])")
add_store("store_delete_where", lambda store: store.delete_where([("?c", "urn:inNation", "nation:3"), ("?c", "?p", "?o")]),
    f"{_KEEP} WHERE NOT (g IS NULL AND s IN (SELECT s FROM q WHERE g IS NULL AND p = 'urn:inNation' AND o = 'nation:3'))")
add_store("store_modify", lambda store: store.modify([("?x", "urn:inNation", "?n"), ("?n", "urn:inRegion", "?r")], [("?x", "urn:inNation", "?n")], [("?x", "urn:inRegion", "?r")]),
    f"""{_KEEP} WHERE NOT (g IS NULL AND p = 'urn:inNation' AND o IN (SELECT s FROM q WHERE g IS NULL AND p = 'urn:inRegion'))
  UNION SELECT NULL, x.s, 'urn:inRegion', n.o FROM q x JOIN q n ON n.s = x.o WHERE x.g IS NULL AND n.g IS NULL AND x.p = 'urn:inNation' AND n.p = 'urn:inRegion'""")
add("construct_regions", default, lambda t: patterns.construct(patterns.match(t, [("?c", "urn:inNation", "?n"), ("?n", "urn:inRegion", "?r"), ("?c", TYPE, "?k")]), [("?k", "urn:foundIn", "?r"), ("?r", "urn:holds", "?k")]),
    f"""{Q}, f AS (SELECT DISTINCT k.o AS k, n.o AS r FROM t c JOIN t n ON n.s = c.o JOIN t k ON k.s = c.s WHERE c.p = 'urn:inNation' AND n.p = 'urn:inRegion' AND k.p = '{TYPE}')
  SELECT k AS s, 'urn:foundIn' AS p, r AS o FROM f UNION ALL SELECT r, 'urn:holds', k FROM f""")

_NOW = "2024-01-01T00:00:00"
_PARTS = {"namedGraphCounts": ("ngraph", "size"), "typeCounts": ("ngraph", "type", "typeCt"), "predCounts": ("ngraph", "predicate", "size")}
_COUNTED = {
    "namedGraphCounts": "SELECT coalesce(g, '{d}') AS ngraph, count(*) AS size FROM q GROUP BY ALL",
    "typeCounts": "SELECT coalesce(g, '{d}') AS ngraph, o AS type, count(*) AS \"typeCt\" FROM q WHERE p = '{t}' GROUP BY ALL",
    "predCounts": "SELECT coalesce(g, '{d}') AS ngraph, p AS predicate, count(*) AS size FROM q GROUP BY ALL",
}


def _profile_sql() -> str:
    """The stored profile's records and times, a record named by a digest of what it holds."""
    parts = []
    for part, columns in _PARTS.items():
        record = " || '|' || ".join(f'\"{c}\"::VARCHAR' for c in columns)
        values = [f"\"{c}\"" if c != columns[-1] else f"'\"' || \"{c}\" || '\"^^<{XSD}integer>'" for c in columns]
        predicates = [TYPE, f"{profile.PROFILE}memberOf", *(profile.PROFILE + c for c in columns)]
        objects = [f"'{profile.PROFILE}Record'", f"'{profile.PROFILE}{part}'", *values]
        counted = _COUNTED[part].format(d=DEFAULT_GRAPH, t=TYPE)
        parts.append(f"SELECT '_:' || md5('{part}|' || {record}) AS s, unnest([{', '.join(f"'{p}'" for p in predicates)}]) AS p, unnest([{', '.join(objects)}]) AS o FROM ({counted})")
    nodes = ", ".join(f"'{n}'" for n in (_MADE, *(profile.PROFILE + k for k in _PARTS)))
    stamps = f"SELECT n AS s, unnest(['{profile.CREATED}', '{profile.MODIFIED}']) AS p, '\"{_NOW}\"^^<{XSD}dateTime>' AS o FROM (SELECT unnest([{nodes}]) AS n)"
    return f"SELECT '{_MADE}' AS g, s, p, o FROM ({' UNION ALL '.join([*parts, stamps])})"


_records = lambda df: df.filter(F.col("s").startswith("_:") | F.col("p").isin(profile.CREATED, profile.MODIFIED))
QUERIES["store_profile"] = lambda spark, sf_dir: _records(GraphStore(spark, _store(spark, sf_dir).profile(_MADE, _NOW).graph(_MADE)).quads)
SQL["store_profile"] = f"WITH q AS MATERIALIZED (SELECT DISTINCT g, s, p, o FROM ({RICH}) r) {_profile_sql()}"

# A query text from blocks: one SELECT for each kind of link

_TEMPLATE = """
--$ BLOCK COUNTS links=links
--$ INCLUDE PER_LINK
ORDER BY p, s

--$ BLOCK PER_LINK list_of=links
SELECT s, p, n FROM (
  --$ FOREACH ONE var=link list=kinds
  SELECT '' AS s, '' AS p, CAST(0 AS BIGINT) AS n WHERE FALSE
)

--$ BLOCK ONE table=t
SELECT s, p, count(*) AS n FROM {${table}} WHERE p = '${link}' GROUP BY s, p UNION ALL
"""


def _templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BlockTemplate(_TEMPLATE).query(spark, "COUNTS", {"t": links(spark, sf_dir)}, kinds=["urn:inNation", "urn:inRegion"])


QUERIES["template_counts"] = _templated
SQL["template_counts"] = f"{T} SELECT s, p, count(*) AS n FROM t WHERE p IN ('urn:inNation', 'urn:inRegion') GROUP BY ALL"
