"""RDF terms as strings, and the column expressions that read them.

An IRI is stored bare, a blank node as ``_:label``, a literal as ``"lexical"`` with an optional ``^^<datatype>`` or
``@language``. Two terms are equal if and only if their strings are, so joins and groupings need no decoding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = f"{RDF}type"
CONNECTED = "urn:connectedTo"
#: What a default graph is called where graphs are listed by name.
DEFAULT_GRAPH = "urn:x-arq:DefaultGraphNode"
PREFIXES = {"rdf:": RDF, "rdfs:": RDFS, "owl:": OWL, "skos:": SKOS, "xsd:": XSD}

_LITERAL = r'(?s)\A"(.*)"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?\z'


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_iri(term: Column) -> Column:
    return ~is_blank(term) & ~is_literal(term)


def str_of(term: Column) -> Column:
    """STR(): the IRI, or a literal's lexical form; null for a blank node."""
    return F.when(is_literal(term), F.regexp_extract(term, _LITERAL, 1)).when(~is_blank(term), term)


def num_of(term: Column) -> Column:
    """The number that a literal spells, else null."""
    return F.when(is_literal(term), str_of(term).try_cast("double"))


def datatype_of(term: Column) -> Column:
    """A typed literal's datatype IRI, else null."""
    return F.nullif(F.regexp_extract(term, r'(?s)\A".*"\^\^<([^>]*)>\z', 1), F.lit(""))


def local_name(iri: Column) -> Column:
    """What follows the last ``/`` or ``#``."""
    return F.regexp_extract(iri, r"[^/#]*\z", 0)


def namespace(iri: Column, mode: str = "intended") -> Column:
    """The IRI up to its last ``/`` or ``#``; ``faithful`` leaves it whole, as the pattern with stray blanks did."""
    return iri if mode == "faithful" else F.regexp_replace(iri, r"[^/#]*\z", "")


def shorten(term: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """STR() with every known namespace replaced by its prefix."""
    text = str_of(term)
    for prefix, iri in prefixes.items():
        text = F.replace(text, F.lit(iri), F.lit(prefix))
    return text


def literal(value: Column, xsd_type: str | None = None) -> Column:
    """A literal term with the given XSD type (``int``, ``string``, ...); null stays null."""
    return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}{xsd_type}>' if xsd_type else '"'))
