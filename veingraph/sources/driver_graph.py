"""A graph over the relational test tables, in SQL that Spark and other engines read alike.

Keys become IRIs, foreign keys links. ``LINKS`` has the seven kinds of links; ``RICH`` adds types, a class
hierarchy, literals, blank nodes and named graphs for the profile and summary operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.functions.terms import OWL, RDF, RDFS, SKOS, XSD

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

LINKS = """
SELECT DISTINCT 'order:' || l_orderkey AS s, 'urn:contains' AS p, 'part:' || l_partkey AS o FROM lineitem
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'urn:suppliedBy', 'supplier:' || l_suppkey FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'urn:soldBy', 'supplier:' || l_suppkey FROM lineitem
UNION ALL SELECT DISTINCT 'order:' || o_orderkey, 'urn:placedBy', 'customer:' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'customer:' || c_custkey, 'urn:inNation', 'nation:' || c_nationkey FROM customer
UNION ALL SELECT DISTINCT 'supplier:' || s_suppkey, 'urn:inNation', 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT DISTINCT 'nation:' || n_nationkey, 'urn:inRegion', 'region:' || n_regionkey FROM nation
"""

RICH = f"""
SELECT CAST(NULL AS VARCHAR(100)) AS g, s, p, o FROM ({LINKS}) links
UNION ALL SELECT NULL, 'customer:' || c_custkey, '{RDF}type', 'urn:class/Customer' FROM customer
UNION ALL SELECT NULL, 'customer:' || c_custkey, '{RDF}type', 'urn:class/Customer/' || c_mktsegment FROM customer
UNION ALL SELECT NULL, 'supplier:' || s_suppkey, '{RDF}type', 'urn:class/Supplier' FROM supplier
UNION ALL SELECT NULL, 'nation:' || n_nationkey, '{RDF}type', 'urn:class/Nation' FROM nation
UNION ALL SELECT NULL, 'region:' || r_regionkey, '{RDF}type', 'urn:class/Region' FROM region
UNION ALL SELECT NULL, 'region:' || r_regionkey, '{RDF}type', '{RDFS}Resource' FROM region
UNION ALL SELECT DISTINCT NULL, 'urn:class/Customer/' || c_mktsegment, '{RDFS}subClassOf', 'urn:class/Customer' FROM customer
UNION ALL SELECT NULL, 'urn:class/Customer', '{RDFS}subClassOf', '{RDFS}Resource'
UNION ALL SELECT NULL, 'urn:class/Customer', '{RDF}type', '{RDFS}Class'
UNION ALL SELECT NULL, 'urn:class/Supplier', '{RDF}type', '{OWL}Class'
UNION ALL SELECT NULL, 'urn:concept/Trade', '{RDF}type', '{SKOS}Concept'
UNION ALL SELECT NULL, 'urn:contains', '{RDF}type', '{RDF}Property'
UNION ALL SELECT NULL, 'urn:soldBy', '{RDFS}subPropertyOf', 'urn:suppliedBy'
UNION ALL SELECT NULL, 'urn:soldBy', '{RDFS}subPropertyOf', 'urn:soldBy'
UNION ALL SELECT NULL, 'urn:eventKey', '{RDF}type', '{OWL}InverseFunctionalProperty'
UNION ALL SELECT NULL, 'urn:total', '{RDFS}range', '{XSD}long'
UNION ALL SELECT NULL, 'urn:balance', '{RDFS}range', '{XSD}long'
UNION ALL SELECT NULL, 'urn:kind', '{RDFS}range', '{XSD}string'
UNION ALL SELECT NULL, 'order:' || o_orderkey, 'urn:total', '"' || CAST(floor(o_totalprice) AS BIGINT) || '"^^<{XSD}long>' FROM orders
UNION ALL SELECT NULL, 'customer:' || c_custkey, 'urn:balance', '"' || CAST(floor(c_acctbal) AS BIGINT) || '"^^<{XSD}long>' FROM customer
UNION ALL SELECT NULL, 'customer:' || c_custkey, '{OWL}sameAs', 'http://example.org/customer#' || c_custkey FROM customer WHERE c_acctbal < 0
UNION ALL SELECT NULL, 'http://example.org/customer#' || c_custkey, 'http://example.org/terms#of', 'http://example.org/nations/' || c_nationkey FROM customer WHERE c_acctbal < 0
UNION ALL SELECT NULL, 'supplier:' || s_suppkey, 'urn:basedIn', 'nation:' || s_nationkey FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT NULL, '_:e' || event_id, 'urn:kind', '"' || event_type || '"' FROM events
UNION ALL SELECT NULL, '_:e' || event_id, 'urn:eventKey', '"' || event_id || '"' FROM events WHERE event_type <> 'error'
UNION ALL SELECT NULL, 'user:' || user_id, 'urn:did', '_:e' || event_id FROM events WHERE event_type = 'click'
UNION ALL SELECT 'urn:graph/suppliers', 'supplier:' || s_suppkey, '{RDF}type', 'urn:class/Supplier' FROM supplier
UNION ALL SELECT 'urn:graph/suppliers', 'supplier:' || s_suppkey, 'urn:inNation', 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'urn:graph/nations', 'nation:' || n_nationkey, 'urn:inRegion', 'region:' || n_regionkey FROM nation
UNION ALL SELECT 'urn:graph/nations', 'nation:' || n_nationkey, '{RDF}type', 'urn:class/Nation' FROM nation
"""


def _keys_first(text: str) -> str:
    """The same links, each DISTINCT over the keys and not over the strings made of them, which takes a fraction of the bytes."""
    return re.sub(
        r"SELECT DISTINCT ('\w+:' \|\| )(\w+)((?: AS s)?, '[\w:]+'(?: AS p)?, )('\w+:' \|\| )(\w+)((?: AS o)?) FROM (\S+)",
        r"SELECT \1\2\3\4\5\6 FROM (SELECT DISTINCT \2, \5 FROM \7) d_\5_\2", text,
    )


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def links(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(s, p, o) of the seven kinds of links; unless ``once``, each as often as rows have it, which takes no shuffle."""
    text = _keys_first(LINKS) if once else LINKS.replace("SELECT DISTINCT", "SELECT")
    views = _views(spark, sf_dir)
    for name in TABLES:
        text = text.replace(f" FROM {name}", f" FROM {{{name}}}")
    return spark.sql(text, **{n: views[n] for n in TABLES if f"{{{n}}}" in text})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, o) of the links, each pair once.

    Different kinds of links never have the same two ends, as these begin with what they are, and most kinds are distinct
    by themselves; only the others, and links with a null end, can repeat.
    """
    found = links(spark, sf_dir)
    whole = F.col("s").isNotNull() & F.col("o").isNotNull()
    apart = F.col("p").isin("urn:contains", "urn:suppliedBy", "urn:soldBy")
    rest = found.filter(~(whole & apart)).select("s", "o").distinct()
    return found.filter(whole & apart).select("s", "o").unionByName(rest)


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, s, p, o) of everything; the default graph has a null ``g``."""
    views = _views(spark, sf_dir)
    text = RICH
    for name in TABLES:
        text = text.replace(f" FROM {name}", f" FROM {{{name}}}")
    return spark.sql(text.replace("VARCHAR(100)", "STRING"), **views)
