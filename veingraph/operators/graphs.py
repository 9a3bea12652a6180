"""Named graphs: loading, inserting, clearing and snapshots, each giving a new quad table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.functions.terms import RDFS
from veingraph.operators.patterns import Pattern, construct, match
from veingraph.operators.profile import PROFILE, profile_triples, profile_vocabulary
from veingraph.plans.iteration import cut
from veingraph.sources.triples import SCHEMA, as_triples, load_snapshot, parse_ntriples, rdfs_vocabulary, read_ntriples, save_snapshot


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's snapshots, the oldest first."""
    files, at = _folder(spark, folder)
    found = files.listStatus(at) if files.exists(at) else []
    return [name for _, name in sorted((f.getModificationTime(), f.getPath().getName()) for f in found if f.isDirectory())]


def drop_snapshot(spark: SparkSession, folder: str, name: str) -> None:
    """Deletes one; one that does not exist is no error."""
    files, at = _folder(spark, f"{folder}/{name}")
    files.delete(at, True)


class GraphStore:
    """A quad table that operations replace by a new one; every operation sees the state before it."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None) -> None:
        self.spark = spark
        self.quads = spark.createDataFrame([], SCHEMA) if quads is None else as_triples(quads)

    def graph(self, name: str | None = None) -> DataFrame:
        return self.quads.filter(F.col("g").isNull() if name is None else F.col("g") == name)

    def names(self) -> DataFrame:
        return self.quads.filter("g IS NOT NULL").select("g").distinct()

    def _add(self, more: DataFrame) -> GraphStore:
        return GraphStore(self.spark, self.quads.unionByName(as_triples(more)))

    def load(self, path: str, graph: str | None = None) -> GraphStore:
        """Adds the triples of N-Triples files to a graph."""
        return self._add(read_ntriples(self.spark, path, graph))

    def insert(self, triples: DataFrame, graph: str | None = None) -> GraphStore:
        """Adds rows (s, p, o) to a graph; what it holds already stays once."""
        return self._add(triples.select(F.lit(graph).cast("string").alias("g"), "s", "p", "o"))

    def insert_data(self, text: str, graph: str | None = None) -> GraphStore:
        """Adds ground triples given as N-Triples text."""
        lines = self.spark.createDataFrame([(line,) for line in text.splitlines()], "value string")
        return self._add(parse_ntriples(lines, graph))

    def insert_rdfs_namespace(self, graph: str | None = None) -> GraphStore:
        return self.insert(rdfs_vocabulary(self.spark), graph)

    def insert_metadata(self, graph: str | None = None) -> GraphStore:
        """Replaces what describes the profiles' vocabulary: everything that it defines goes first."""
        of_ontology = self.graph(graph).filter(F.col("s") == PROFILE)
        defined = [("?s", f"{RDFS}isDefinedBy", PROFILE), ("?s", "?p", "?o")]
        without = self.delete_where(defined, graph).delete(of_ontology, graph)
        return without.insert(profile_vocabulary(self.spark), graph)

    def profile(self, graph: str, now: str | None = None) -> GraphStore:
        """Empties ``graph`` and stores the profile of all others in it."""
        return self.clear(graph).insert(profile_triples(self.quads, graph, now), graph)

    def delete(self, triples: DataFrame, graph: str | None = None) -> GraphStore:
        """Takes rows (s, p, o) out of a graph."""
        gone = triples.select(F.lit(graph).cast("string").alias("dg"), F.col("s").alias("ds"), F.col("p").alias("dp"), F.col("o").alias("do"))
        q = self.quads
        same = q["g"].eqNullSafe(gone["dg"]) & (q["s"] == gone["ds"]) & (q["p"] == gone["dp"]) & (q["o"] == gone["do"])
        return GraphStore(self.spark, q.join(gone, same, "left_anti"))

    def delete_where(self, patterns: list[Pattern], graph: str | None = None) -> GraphStore:
        """Takes the triples of all solutions of the patterns out of a graph."""
        return self.modify(patterns, delete=patterns, graph=graph)

    def modify(
        self, where: list[Pattern], delete: list[Pattern] = (), insert: list[Pattern] = (), graph: str | None = None, into: str | None = None
    ) -> GraphStore:
        """Deletes and inserts, in a graph, what the templates give with each solution of ``where`` in it; deletes go first.

        ``into`` names another graph for what is inserted.
        """
        solutions = cut(match(self.graph(graph), list(where)))
        store = self.delete(construct(solutions, list(delete)), graph) if delete else self
        return store.insert(construct(solutions, list(insert)), graph if into is None else into) if insert else store

    def clear_default(self) -> GraphStore:
        return GraphStore(self.spark, self.quads.filter("g IS NOT NULL"))

    def clear(self, graph: str) -> GraphStore:
        """Empties a graph; one that does not exist is no error."""
        return GraphStore(self.spark, self.quads.filter(~F.col("g").eqNullSafe(F.lit(graph))))

    drop = clear

    def clear_all(self) -> GraphStore:
        return GraphStore(self.spark)

    def checkpoint(self, path: str) -> tuple[int, GraphStore]:
        """Writes a snapshot; returns its number of quads and a store that reads it."""
        save_snapshot(self.quads, path)
        store = GraphStore.restore(self.spark, path)
        return store.quads.count(), store

    @staticmethod
    def restore(spark: SparkSession, path: str) -> GraphStore:
        return GraphStore(spark, load_snapshot(spark, path))
