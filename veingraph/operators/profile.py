"""Profiles of a data set: counts by graph, type and predicate, predicate statistics and network statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.functions.terms import DEFAULT_GRAPH, OWL, RDF, RDFS, TYPE, XSD, num_of, shorten, str_of


def typed(text: str, kind: str) -> str:
    """A literal of one of the schema's data types."""
    return f'"{text}"^^<{XSD}{kind}>'


def _n() -> Column:
    return F.count(F.lit(1))


def in_graph(quads: DataFrame, graph: str | None) -> DataFrame:
    """The triples of one graph; of the default one if None."""
    return quads.filter(F.col("g").isNull() if graph is None else F.col("g") == graph)


def graph_name() -> Column:
    return F.coalesce("g", F.lit(DEFAULT_GRAPH))


def count_graph(quads: DataFrame, graph: str | None = None) -> DataFrame:
    return in_graph(quads, graph).agg(_n().alias("count"))


def count_type(quads: DataFrame, rdf_type: str, graph: str | None = None) -> DataFrame:
    return in_graph(quads, graph).filter((F.col("p") == TYPE) & (F.col("o") == rdf_type)).agg(_n().alias("count"))


def count_preds(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.col("p").alias("pred")).agg(_n().alias("count")).orderBy("count", "pred")


def count_types(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p") == TYPE).groupBy(F.col("o").alias("type")).agg(_n().alias("count")).orderBy("count", "type")


def _stats() -> list[Column]:
    """Counts and, of numbers, extremes and mean: the mean is null if any object is not a number.

    Extremes are of numbers if all objects are numbers, else null in ``min``/``max`` and by text in ``min_text``/``max_text``.
    """
    number = num_of(F.col("o"))
    all_numbers = F.count(number) == _n()
    return [
        _n().alias("count"),
        F.countDistinct("o").alias("distinct_objects"),
        F.when(all_numbers, F.min(number)).alias("min"),
        F.when(all_numbers, F.max(number)).alias("max"),
        F.when(all_numbers, F.avg(number)).alias("avg"),
        F.min(str_of(F.col("o"))).alias("min_text"),
        F.max(str_of(F.col("o"))).alias("max_text"),
        F.min("s").alias("sample_subject"),
        F.min("o").alias("sample_object"),
    ]


def pred_stats_all(triples: DataFrame) -> DataFrame:
    return triples.groupBy(F.col("p").alias("pred")).agg(*_stats()).orderBy("pred")


def _of_range(triples: DataFrame, range_: str) -> DataFrame:
    ranged = triples.filter((F.col("p") == f"{RDFS}range") & (F.col("o") == range_)).select(F.col("s").alias("p")).distinct()
    return triples.join(ranged, "p")


def pred_stats_number(triples: DataFrame, range_: str) -> DataFrame:
    """Statistics of the predicates whose declared range is ``range_``."""
    return _of_range(triples, range_).groupBy(F.col("p").alias("pred")).agg(*_stats()).drop("min_text", "max_text").orderBy("pred")


def pred_stats_nan(triples: DataFrame, range_: str) -> DataFrame:
    return pred_stats_number(triples, range_).select("pred", "count", "distinct_objects", "sample_subject", "sample_object")


def show_all(triples: DataFrame, limit: int = 10_000) -> DataFrame:
    """(s_s, p_s, o_s): the first triples in order, with known namespaces shortened."""
    first = triples.orderBy("s", "p", "o").limit(limit)
    return first.select(*[shorten(F.col(c)).alias(f"{c}_s") for c in "spo"])


def ask(found: DataFrame) -> bool:
    """Whether there is any row."""
    return not found.isEmpty()


def ask_nothing(triples: DataFrame) -> DataFrame:
    """(answer): whether any class is declared."""
    declared = triples.filter((F.col("p") == TYPE) & (F.col("o") == f"{RDFS}Class")).limit(1)
    return declared.agg((_n() > 0).alias("answer"))


def profile_named_graphs(quads: DataFrame) -> DataFrame:
    """(ngraph, size): triples of the default graph and of each named one."""
    return quads.groupBy(graph_name().alias("ngraph")).agg(_n().alias("size"))


def profile_types(quads: DataFrame) -> DataFrame:
    return quads.filter(F.col("p") == TYPE).groupBy(graph_name().alias("ngraph"), F.col("o").alias("type")).agg(_n().alias("typeCt"))


def profile_predicates(quads: DataFrame) -> DataFrame:
    return quads.groupBy(graph_name().alias("ngraph"), F.col("p").alias("predicate")).agg(_n().alias("size"))


def profile(quads: DataFrame) -> dict[str, DataFrame]:
    """The three profiles, each stamped with when it was made."""
    parts = {"named_graphs": profile_named_graphs, "types": profile_types, "predicates": profile_predicates}
    return {name: make(quads).withColumn("created", F.current_timestamp()) for name, make in parts.items()}


#: Terms of stored profiles.
PROFILE = "urn:profile:"
CREATED, MODIFIED = "http://purl.org/dc/terms/created", "http://purl.org/dc/terms/modified"
#: Each part of a stored profile: its class, its title and its columns.
PARTS = {
    "namedGraphCounts": ("NamedGraphCounts", "Named Graph Triple Counts", ("ngraph", "size")),
    "typeCounts": ("TypeCounts", "Type Counts", ("ngraph", "type", "typeCt")),
    "predCounts": ("PredicateCounts", "Predicate Counts", ("ngraph", "predicate", "size")),
}


def profile_triples(quads: DataFrame, graph: str, now: str | None = None) -> DataFrame:
    """(s, p, o) of the profile that is to be stored in ``graph``, which the profile itself leaves out.

    The graph and each part have a class, a title, when they were made and when they were completed; a part's records
    are blank nodes, named by a digest of what they hold, with one triple for each column. ``now`` fixes the time.
    """
    spark = quads.sparkSession
    time = F.lit(typed(now, "dateTime")) if now else F.concat(F.lit('"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f'"^^<{XSD}dateTime>'))
    others = quads.filter(~F.col("g").eqNullSafe(F.lit(graph)))
    makers = dict(zip(PARTS, (profile_named_graphs, profile_types, profile_predicates)))
    heads = [(graph, TYPE, f"{PROFILE}ProfileGraph"), (graph, f"{RDFS}label", typed("Profile results", "string"))]
    rows = []
    for part, (kind, title, columns) in PARTS.items():
        node = PROFILE + part
        heads += [(node, TYPE, PROFILE + kind), (node, TYPE, f"{PROFILE}Result"), (node, f"{RDFS}label", typed(title, "string"))]
        found = makers[part](others)
        texts = [F.col(c).cast("string") for c in columns]
        record = F.concat(F.lit("_:"), F.md5(F.concat_ws("|", F.lit(part), *texts)))
        number = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit(f'"^^<{XSD}integer>'))
        pairs = [(TYPE, F.lit(f"{PROFILE}Record")), (f"{PROFILE}memberOf", F.lit(node))]
        pairs += [(PROFILE + c, number(c) if c == columns[-1] else F.col(c)) for c in columns]
        triples = F.array(*[F.struct(record.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in pairs])
        rows.append(found.select(F.explode(triples).alias("t")).select("t.s", "t.p", "t.o"))
    fixed = spark.createDataFrame(heads, "s string, p string, o string")
    stamps = spark.createDataFrame([(n, p) for n in (graph, *(PROFILE + k for k in PARTS)) for p in (CREATED, MODIFIED)], "s string, p string").withColumn("o", time)
    return reduce(DataFrame.unionByName, rows, fixed.unionByName(stamps))


def network_stats(triples: DataFrame, predicate: str | None = None) -> DataFrame:
    """(edgeCt, subjectCt, objectCt, nodeCt) of one predicate's network, or of all."""
    edges = triples if predicate is None else triples.filter(F.col("p") == predicate)
    ends = edges.select(F.explode(F.array(F.struct("s", F.lit(1).alias("k")), F.struct(F.col("o").alias("s"), F.lit(2).alias("k")))).alias("e"))
    roles = ends.groupBy("e.s").agg(F.count_if(F.col("e.k") == 1).alias("out"), F.count_if(F.col("e.k") == 2).alias("in"))
    return roles.agg(
        F.coalesce(F.sum("out"), F.lit(0)).cast("long").alias("edgeCt"),
        F.count_if(F.col("out") > 0).alias("subjectCt"),
        F.count_if(F.col("in") > 0).alias("objectCt"),
        _n().alias("nodeCt"),
    )


#: The vocabulary of stored profiles: (name, kind, comment); a property's range is the last one's.
VOCABULARY = (
    ("ProfileGraph", "Class", "A graph that holds a stored profile"), ("Result", "Class", "A part of a profile; it may be out of date"),
    ("Record", "Class", "A row of a part"), ("NamedGraphCounts", "Class", "Triples by graph"), ("TypeCounts", "Class", "Instances by graph and type"),
    ("PredicateCounts", "Class", "Triples by graph and predicate"), ("memberOf", "Property", "The part that a record is of"),
    ("ngraph", "Property", "The graph that was counted"), ("type", "Property", "The type that was counted"),
    ("predicate", "Property", "The predicate that was counted"), ("size", "Property", "A number of triples"), ("typeCt", "Property", "A number of instances"),
)


def profile_vocabulary(spark: SparkSession) -> DataFrame:
    """(s, p, o) that describe the classes and properties of stored profiles."""
    rows = [(PROFILE, TYPE, f"{OWL}Ontology"), (PROFILE, f"{RDFS}label", typed("Profiles", "string"))]
    for name, kind, comment in VOCABULARY:
        whole = f"{RDFS}Class" if kind == "Class" else f"{RDF}Property"
        rows += [(PROFILE + name, TYPE, whole), (PROFILE + name, f"{RDFS}isDefinedBy", PROFILE)]
        rows += [(PROFILE + name, f"{RDFS}label", typed(name, "string")), (PROFILE + name, f"{RDFS}comment", typed(comment, "string"))]
    return spark.createDataFrame(rows, "s string, p string, o string")


def counting_table(spark: SparkSession) -> DataFrame:
    """(from, to, value): the ranges 0-9, 1-10 and 0-29 with their numbers."""
    ranges = spark.createDataFrame([(0, 9), (1, 10), (0, 29)], "from int, to int")
    return ranges.withColumn("value", F.explode(F.sequence("from", "to")))


def distinct_predicates(triples: DataFrame) -> DataFrame:
    """(p) in order; the first is the default where a predicate is to be chosen."""
    return triples.select("p").distinct().orderBy("p")


def predicate_graph(triples: DataFrame, predicate: str) -> DataFrame:
    """(s, o): the distinct links of one predicate."""
    return triples.filter(F.col("p") == predicate).select("s", "o").distinct()
