"""Triple tables: N-Triples files, relational rows, and edge or vertex views of triples.

A triple table has the columns ``g`` (graph, null for the default one), ``s``, ``p`` and ``o``, and no row twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veingraph.functions.terms import TYPE, is_iri, is_literal, literal

COLUMNS = ["g", "s", "p", "o"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
#: XSD types of column types by name.
XSD_TYPES = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double",
    "string": "string", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime",
}

_TERM = r'<([^>]*)>|(_:[^\s]+)|("(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
_LINE = rf"^\s*(?:{_TERM})\s+<([^>]*)>\s+(?:{_TERM})\s*(?:<([^>]*)>\s*)?\.\s*(?:#.*)?$"
_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"'), ("\r", "\\r"))


def as_triples(df: DataFrame) -> DataFrame:
    """Columns in order, a null ``g`` where there is none, and no row twice."""
    g = F.col("g").cast("string") if "g" in df.columns else F.lit(None).cast("string").alias("g")
    return df.select(g, "s", "p", "o").dropDuplicates()


def _inner(term: Column) -> Column:
    body = F.regexp_extract(term, r'(?s)\A"(.*)"((?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\z', 1)
    suffix = F.regexp_extract(term, r'(?s)\A"(.*)"((?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\z', 2)
    # A doubled backslash becomes a mark first, so that it starts no other escape.
    for plain, escaped in (("\u0000", "\\\\"), ("\n", "\\n"), ('"', '\\"'), ("\r", "\\r"), ("\t", "\\t"), ("\\", "\u0000")):
        body = F.replace(body, F.lit(escaped), F.lit(plain))
    return F.concat(F.lit('"'), body, F.lit('"'), suffix)


def parse_ntriples(lines: DataFrame, graph: str | None = None) -> DataFrame:
    """Triples from a column ``value`` of N-Triples (or N-Quads) lines; blank lines, comments and malformed lines yield none."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    s = F.concat(part(1), part(2), part(3))
    o = F.when(part(7) != "", _inner(part(7))).otherwise(F.concat(part(5), part(6)))
    named = F.lit(graph).cast("string") if graph else F.nullif(part(8), F.lit(""))
    return lines.filter(F.col("value").rlike(_LINE)).select(named.alias("g"), s.alias("s"), part(4).alias("p"), o.alias("o"))


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """The triples of N-Triples files, into ``graph`` or the graphs that the lines name."""
    return as_triples(parse_ntriples(spark.read.text(path), graph))


def ntriples_lines(triples: DataFrame, with_graph: bool = False) -> DataFrame:
    """A column ``value`` of N-Triples lines (N-Quads with ``with_graph``)."""

    def written(name: str) -> Column:
        term = F.col(name)
        body = F.regexp_extract(term, r'(?s)\A"(.*)"((?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\z', 1)
        for plain, escaped in _ESCAPES:
            body = F.replace(body, F.lit(plain), F.lit(escaped))
        suffix = F.regexp_extract(term, r'(?s)\A"(.*)"((?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\z', 2)
        quoted = F.concat(F.lit('"'), body, F.lit('"'), suffix)
        return F.when(is_literal(term), quoted).when(is_iri(term), F.concat(F.lit("<"), term, F.lit(">"))).otherwise(term)

    parts = [written("s"), written("p"), written("o")]
    if with_graph:
        parts.append(F.concat(F.lit("<"), F.col("g"), F.lit(">")))
    return triples.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, with_graph: bool = False) -> None:
    ntriples_lines(triples, with_graph).write.mode("overwrite").text(path)


def save_snapshot(triples: DataFrame, path: str) -> None:
    """A snapshot by predicate, so that a scan of one predicate reads its folder alone."""
    triples.withColumn("predicate", F.col("p")).repartition("predicate").write.mode("overwrite").partitionBy("predicate").parquet(path)


def load_snapshot(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    if predicate is not None:
        found = found.filter(F.col("predicate") == predicate)
    return found.select(*COLUMNS)


def escape_iri(value: Column) -> Column:
    """Blanks and colons of a key become underscores."""
    return F.translate(value.cast("string"), " :", "__")


def table_to_triples(
    rows: DataFrame, base: str, kind: str, key: str, columns: list[str] | None = None, references: dict[str, str] | None = None
) -> DataFrame:
    """Triples of relational rows: ``base + kind/key`` is the subject, each column a predicate with a typed literal.

    ``references`` maps a column to the kind that its values are keys of; nulls are left out; every row gets its type.
    One pass over the rows: the pairs of a row are one array that is exploded.
    """
    references = references or {}
    columns = [c for c in rows.columns if c != key] if columns is None else columns
    types = dict(rows.dtypes)

    def value(c: str) -> Column:
        if c in references:
            return F.concat(F.lit(f"{base}{references[c]}/"), escape_iri(F.col(c)))
        name = "decimal" if types[c].startswith("decimal") else XSD_TYPES.get(types[c], "string")
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if name == "dateTime" else F.col(c)
        return literal(text, name)

    pairs = [F.struct(F.lit(TYPE).alias("p"), F.lit(f"{base}{kind}").alias("o"))]
    pairs += [F.struct(F.lit(f"{base}p#{c}").alias("p"), value(c).alias("o")) for c in columns]
    subject = F.concat(F.lit(f"{base}{kind}/"), escape_iri(F.col(key)))
    exploded = rows.filter(F.col(key).isNotNull()).select(subject.alias("s"), F.explode(F.array(*pairs)).alias("po"))
    return as_triples(exploded.select("s", "po.p", "po.o").filter("o IS NOT NULL"))


def with_predicate(triples: DataFrame, predicate: str | None) -> DataFrame:
    """(s, o) of one predicate (pushed down to the scan), or of all."""
    return (triples if predicate is None else triples.filter(F.col("p") == predicate)).select("s", "o")


def vertices(edges: DataFrame) -> DataFrame:
    """(v): the distinct ends of (s, o)."""
    return edges.select(F.explode(F.array("s", "o")).alias("v")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """(s, o) in both directions, from one scan."""
    both = F.array(F.struct("s", "o"), F.struct(F.col("o").alias("s"), F.col("s").alias("o")))
    return edges.select(F.explode(both).alias("e")).select("e.s", "e.o")


def rdfs_vocabulary(spark: SparkSession) -> DataFrame:
    """The RDFS vocabulary's classes and properties with their types, superclasses, domains and ranges."""
    rdfs, rdf = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    #: Fixed values: (class, superclass) and (property, domain, range) of the RDFS recommendation.
    classes = (
        ("Resource", None), ("Class", "Resource"), ("Literal", "Resource"), ("Container", "Resource"),
        ("ContainerMembershipProperty", None), ("Datatype", "Class"),
    )
    properties = (
        ("subClassOf", "Class", "Class"), ("subPropertyOf", None, None), ("comment", "Resource", "Literal"),
        ("label", "Resource", "Literal"), ("domain", None, "Class"), ("range", None, "Class"),
        ("seeAlso", "Resource", "Resource"), ("isDefinedBy", "Resource", "Resource"), ("member", "Resource", "Resource"),
    )
    rows = []
    for name, parent in classes:
        rows += [(rdfs + name, TYPE, rdfs + "Class"), (rdfs + name, rdfs + "label", f'"{name}"')]
        rows += [(rdfs + name, rdfs + "subClassOf", rdfs + parent)] if parent else []
    for name, domain, range_ in properties:
        rows += [(rdfs + name, TYPE, rdf + "Property"), (rdfs + name, rdfs + "label", f'"{name}"')]
        rows += [(rdfs + name, rdfs + "domain", rdfs + domain)] if domain else []
        rows += [(rdfs + name, rdfs + "range", rdfs + range_)] if range_ else []
    rows.append((rdfs + "isDefinedBy", rdfs + "subPropertyOf", rdfs + "seeAlso"))
    return as_triples(spark.createDataFrame(rows, "s string, p string, o string"))
