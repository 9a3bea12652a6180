"""Entities of a graph: a subject with its properties, as values of the host language or as terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veingraph.functions.terms import PREFIXES, XSD, datatype_of, shorten, str_of
from veingraph.operators.graphs import GraphStore

#: Lexical forms to values, by data type.
READERS = {f"{XSD}{kind}": read for kind, read in {"integer": int, "int": int, "long": int, "double": float, "float": float, "decimal": float, "boolean": lambda x: x == "true"}.items()}


def local_segment(iri: str) -> str:
    """What follows the last ``/`` or ``#``."""
    return iri[max(iri.rfind("/"), iri.rfind("#")) + 1 :]


def as_term(value: object) -> str | None:
    """An entity's IRI, a literal of the value's type, or a string as the term that it spells."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, Entity):
        return value.iri
    if isinstance(value, bool):
        return f'"{str(value).lower()}"^^<{XSD}boolean>'
    kind = {int: "integer", float: "double"}.get(type(value), "string")
    return f'"{value}"^^<{XSD}{kind}>'


@dataclass(frozen=True)
class Entity:
    """One subject of a graph in a store; ``namespace`` stands before predicates that are no whole IRIs.

    Changes give a new entity of a new store. Lookups read the one subject's triples.
    """

    store: GraphStore
    iri: str
    namespace: str = ""
    graph: str | None = None

    def predicate(self, name: str) -> str:
        return name if ":" in name else self.namespace + name

    def triples(self) -> DataFrame:
        return self.store.graph(self.graph).filter(F.col("s") == self.iri)

    def objects(self, predicate: str) -> list[str]:
        """All terms that the predicate links to, in order."""
        found = self.triples().filter(F.col("p") == self.predicate(predicate)).select("o").distinct()
        return sorted(r["o"] for r in found.collect())

    def term(self, predicate: str, default: str | None = None) -> str | None:
        """The first of them."""
        return next(iter(self.objects(predicate)), default)

    def value(self, predicate: str, default: object = None) -> object:
        """The first of them: a number or a boolean of a literal so typed, the text of others, the IRI."""
        term = self.term(predicate)
        if term is None:
            return default
        row = self.store.spark.range(1).select(str_of(F.lit(term)).alias("text"), datatype_of(F.lit(term)).alias("kind")).first()
        return READERS.get(row["kind"], str)(term if row["text"] is None else row["text"])

    def _with(self, store: GraphStore) -> Entity:
        return Entity(store, self.iri, self.namespace, self.graph)

    def add(self, predicate: str, value: object) -> Entity:
        """One more object; None adds nothing."""
        if value is None:
            return self
        row = self.store.spark.createDataFrame([(self.iri, self.predicate(predicate), as_term(value))], "s string, p string, o string")
        return self._with(self.store.insert(row, self.graph))

    def set(self, predicate: str, value: object) -> Entity:
        """The only object; None takes all away."""
        gone = self.triples().filter(F.col("p") == self.predicate(predicate)).select("s", "p", "o")
        return self._with(self.store.delete(gone, self.graph)).add(predicate, value)

    def dump(self) -> str:
        """The entity on one line: its last segment, then its predicates' last segments with their objects, shortened."""
        rows = self.triples().select("p", F.coalesce(shorten(F.col("o"), PREFIXES), "o").alias("o")).orderBy("p", "o").collect()
        return " ".join([local_segment(self.iri), *(f"{local_segment(r['p'])}={r['o']}" for r in rows)])
