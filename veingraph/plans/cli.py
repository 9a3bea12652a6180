"""Command line: ``python -m veingraph.plans.cli --input graph.nt --run degree_dist limit=5``."""

from __future__ import annotations

import argparse
import ast
import sys

from pyspark.sql import DataFrame, SparkSession

from veingraph.operators.graphs import GraphStore, drop_snapshot, snapshots
from veingraph.operators.profile import profile, profile_named_graphs
from veingraph.plans import catalog
from veingraph.plans.results import write_csv
from veingraph.plans.tracking import Tracker, tracking_stats
from veingraph.sources.triples import load_snapshot, read_ntriples


def _option(text: str) -> tuple[str, object]:
    name, _, value = text.partition("=")
    try:
        return name, ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return name, value


def _put(result: DataFrame, options: argparse.Namespace) -> None:
    """Shows the result or writes it."""
    if options.csv:
        write_csv(result, options.csv)
    else:
        result.show(options.rows, truncate=False)


def _import(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """import PATH: writes the graph as a snapshot."""
    count, _ = store.checkpoint(rest[0])
    print(f"{count} triples")


def _checkpoint(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """checkpoint FOLDER NAME: a named snapshot in a folder of them."""
    count, _ = store.checkpoint(f"{rest[0]}/{rest[1]}")
    print(f"{count} triples in {rest[1]}")


def _checkpoint_list(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """checkpoint_list FOLDER: the snapshots' names, the oldest first."""
    print("\n".join(snapshots(store.spark, rest[0])))


def _checkpoint_delete(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """checkpoint_delete FOLDER NAME."""
    drop_snapshot(store.spark, rest[0], rest[1])


def _checkpoint_delete_first(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """checkpoint_delete_first_n FOLDER N: the oldest ones."""
    for name in snapshots(store.spark, rest[0])[: int(rest[1])]:
        drop_snapshot(store.spark, rest[0], name)


def _data_items(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """data_items: the graphs with their sizes."""
    _put(profile_named_graphs(store.quads).orderBy("ngraph"), options)


def _query(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """query SQL: Spark SQL over the tables {quads} (g, s, p, o) and {triples} (s, p, o) of the chosen graph."""
    tables = {"quads": store.quads, "triples": store.graph(options.graph).select("s", "p", "o")}
    _put(store.spark.sql(rest[0], **{k: v for k, v in tables.items() if f"{{{k}}}" in rest[0]}), options)


def _update(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """update NTRIPLES PATH: inserts ground triples and writes the new state as a snapshot; tells the sizes before and after."""
    count, _ = store.insert_data(rest[0], options.graph).checkpoint(rest[1])
    print(f"{store.quads.count()} triples before, {count} after")


def _profile(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """profile: the three profiles; profile GRAPH PATH: stored in a graph, the new state being written as a snapshot."""
    if rest:
        count, _ = store.profile(rest[0]).checkpoint(rest[1])
        print(f"{count} triples")
        return
    for title, part in profile(store.quads).items():
        print(title)
        part.show(options.rows, truncate=False)


def _validate(store: GraphStore, rest: list[str], options: argparse.Namespace) -> None:
    """validate: whether the graph can be read, by asking it for nothing."""
    store.quads.limit(1).collect()
    print("valid")


#: Operations on the whole store, beside the operators.
STORE = {
    "import": _import, "data_import": _import, "checkpoint": _checkpoint, "checkpoint_list": _checkpoint_list, "checkpoint_delete": _checkpoint_delete,
    "checkpoint_delete_first_n": _checkpoint_delete_first, "data_items": _data_items, "query": _query, "update": _update, "profile": _profile,
    "db_validate": _validate,
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Operators over a graph of triples")
    parser.add_argument("--input", required=True, help="N-Triples file or folder, or a snapshot folder")
    parser.add_argument("--snapshot", action="store_true", help="the input is a snapshot")
    parser.add_argument("--graph", help="the graph to work on; the default graph if not given")
    parser.add_argument("--shell", action="store_true", help="short names and defaults of the interactive shell")
    parser.add_argument("--csv", help="write the result to this folder instead of showing it")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    parser.add_argument("--stats", action="store_true", help="show timings at the end")
    parser.add_argument("--run", nargs="+", required=True, metavar="OPERATION", help="operation, then name=value options; list; or one of STORE")
    options = parser.parse_args(args)
    name, *rest = options.run
    if name == "list":
        print("\n".join(sorted(catalog.SHELL if options.shell else catalog.OPERATORS)))
        return 0
    spark = spark or SparkSession.builder.appName("veingraph").getOrCreate()
    tracker = Tracker()
    quads = load_snapshot(spark, options.input) if options.snapshot else read_ntriples(spark, options.input, options.graph)
    store = GraphStore(spark, quads)
    with tracker.track(name, options.graph or ""):
        if name in STORE:
            STORE[name](store, rest, options)
        else:
            whole = name in ("profile_named_graphs", "profile_types", "profile_predicates", "count_graph", "count_type")
            result = catalog.run(name, store.quads if whole else store.graph(options.graph), options.shell, **dict(map(_option, rest)))
            _put(result, options)
    if options.stats:
        tracking_stats(tracker.log(spark)).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
