"""What iterative operators share: tables that survive lost executors, and ids that keep the order of terms."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Tables of up to so many rows and bytes are small enough to be sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only on a local master that has none, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veingraph-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the plan ends there, and lost executors cost no recomputation.

    Spark removes the files with the DataFrame if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Removes an action's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions within go when each ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def fetch(df: DataFrame) -> list[Row]:
    """The few rows of ``df``; its shuffle files are removed at once."""
    with _tidy(df.sparkSession):
        return df.select("*").collect()


class Held:
    """Tables in the shared folder that one operator has written; ``drop`` removes one as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str, str | None]] = {}

    def _written(self, df: DataFrame, path: str, name: str | None) -> DataFrame:
        self._paths[id(df)] = df, path, name
        return df

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as Parquet: its plan ends there, lost executors cost no recomputation, and it takes a few bytes a value."""
        path = f"{shared_folder(self.spark)}/{uuid.uuid4()}"
        with _tidy(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self._written(self.spark.read.schema(df.schema).parquet(path), path, None)

    def by(self, df: DataFrame, column: str, rows: int, then: Callable[[DataFrame], DataFrame] = lambda d: d, slice_rows: int | None = None) -> DataFrame:
        """``df`` of about ``rows`` rows, and ``then`` what is made of each bucket, as a table in buckets of ``column``.

        Joins and groupings on the column need not shuffle it again. It is written by :func:`slices`, of ``slice_rows`` at most
        if given, which bounds the shuffle.
        """
        path, name = f"{shared_folder(self.spark)}/{uuid.uuid4()}", f"veingraph_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n = max(slices(rows), -(-rows // slice_rows) if slice_rows else 1)
        for k in range(n):
            one = df.filter(F.pmod(F.xxhash64(column), F.lit(n)) == k) if n > 1 else df
            dealt = then(one.repartition(parts, column)).sortWithinPartitions(column)
            with _tidy(self.spark):
                dealt.write.mode("append").option("compression", "zstd").option("path", path).format("parquet").bucketBy(parts, column).saveAsTable(name)
        return self._written(self.spark.table(name), path, name)

    def instead(self, df: DataFrame, view: DataFrame) -> DataFrame:
        """``view``, which reads ``df`` and from now on is what ``drop`` takes for it."""
        _, path, name = self._paths.pop(id(df))
        return self._written(view, path, name)

    def drop(self, df: DataFrame) -> None:
        _, path, name = self._paths.pop(id(df))
        if name is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def sliced(self, parts: int, one: Callable[[Callable[[str], Column]], DataFrame]) -> DataFrame:
        """The rows of ``one`` for each of ``parts`` slices of a column's values, one after another, as one table.

        ``one`` takes a filter by column name. Each slice's shuffles are gone before the next, so disk holds one at a time.
        """
        path, schema = f"{shared_folder(self.spark)}/{uuid.uuid4()}", None
        for k in range(parts):
            df = one(lambda column, k=k: F.pmod(F.xxhash64(column), F.lit(parts)) == k if parts > 1 else F.lit(True))
            schema = df.schema
            with _tidy(self.spark):
                df.write.mode("append").option("compression", "zstd").parquet(path)
        return self._written(self.spark.read.schema(schema).parquet(path), path, None)


#: Rows of a join that go through one slice.
SLICE_ROWS = 40_000_000


def slices(rows: int) -> int:
    return max(1, -(-rows // SLICE_ROWS))


def width(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a + b, [width(column[f.name], f.dataType) for f in kind.fields], F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType)):
            inner = F.aggregate(column, F.lit(0), lambda n, x: n + width(x, kind.elementType).cast("int"))
        else:
            inner = 8 * F.size(column)
        return F.coalesce(inner, F.lit(0)) + 16
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if ``df`` has at most so many rows and bytes, else ``df`` as it is for a shuffled join."""
    wide = reduce(lambda a, b: a + b, [width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    n, total = df.select(wide.cast("long").alias("wide")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("wide")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def dictionary(terms: DataFrame) -> DataFrame:
    """(id, term) for the distinct values of the one column of ``terms``: ids ascend with the terms.

    Range partitions are sorted by themselves and numbered in order, so no step sees all terms.
    """
    column = terms.columns[0]
    distinct = terms.filter(F.col(column).isNotNull()).distinct()
    ordered = distinct.repartitionByRange(column).sortWithinPartitions(column)
    return cut(ordered.select(F.monotonically_increasing_id().alias("id"), F.col(column).alias("term")))


#: Names before numbers that :func:`coding` takes at most, and the ids that fit a long.
PREFIXES, IDS = 64, 2**62
DIGITS = "0123456789"


@dataclass(frozen=True)
class Coding:
    """Ids for terms that are one of a few prefixes and a number: computed from the term and back, in the order of terms.

    An id has the rank of the prefix, the digits as if followed by zeros, and how many digits there are.
    """

    prefixes: tuple[str, ...]
    digits: int

    @property
    def base(self) -> int:
        return 10**self.digits * (self.digits + 1)

    def of(self, term: Column) -> Column:
        found = F.lit(None).cast("long")
        for rank, prefix in reversed(list(enumerate(self.prefixes))):
            number = F.substring(term, len(prefix) + 1, self.digits)
            value = F.rpad(number, self.digits, "0").cast("long") * (self.digits + 1) if self.digits else F.lit(0)
            found = F.when(term.startswith(prefix), value + F.char_length(number) + rank * self.base).otherwise(found)
        return found

    def of_parts(self, prefix: Column, number: Column, n: Column) -> Column:
        """The same id from a term's prefix, the number after it and how many digits that has."""
        tens = F.element_at(F.array(*[F.lit(10**k * (self.digits + 1)).cast("long") for k in range(self.digits + 1)]), F.lit(self.digits + 1) - n)
        rank = F.lit(None).cast("long")
        for k, name in reversed(list(enumerate(self.prefixes))):
            rank = F.when(prefix == name, F.lit(k * self.base).cast("long")).otherwise(rank)
        return rank + number * tens + n

    def term(self, id_: Column) -> Column:
        div = lambda x, y: F.call_function("div", x, F.lit(y))
        prefix = F.element_at(F.array(*map(F.lit, self.prefixes)), (div(id_, self.base) + 1).cast("int"))
        rest = id_ % self.base
        number = F.lpad(div(rest, self.digits + 1).cast("string"), self.digits, "0").substr(F.lit(1), (rest % (self.digits + 1)).cast("int"))
        return F.concat(prefix, number) if self.digits else prefix


def _split(term: Column) -> tuple[Column, Column]:
    """What stands before the digits at the end of a term, and how many digits these are."""
    prefix = F.rtrim(term, F.lit(DIGITS))
    return prefix, F.char_length(term) - F.char_length(prefix)


def _coding(digits: dict[str, int]) -> Coding | None:
    """The coding for terms of these prefixes, each with so many digits at most, if there are few and numbers fit."""
    names = sorted(digits, key=str.encode)
    # A prefix that begins another one would not tell where the number starts.
    if not names or len(names) > PREFIXES or any(y.startswith(x) for x, y in zip(names, names[1:])):
        return None
    code = Coding(tuple(names), max(digits.values()))
    return code if len(names) * code.base < IDS else None


def coding(ends: DataFrame) -> Coding | None:
    """How to compute ids for the terms in the one column of ``ends``, if they are few prefixes and numbers that fit."""
    term = F.col(ends.columns[0])
    prefix, n = _split(term)
    parts = ends.filter(term.isNotNull()).select(prefix.alias("prefix"), n.alias("n"))
    return _coding(dict(map(tuple, fetch(parts.groupBy("prefix").agg(F.max("n").alias("n")).limit(PREFIXES + 1)))))


@dataclass(frozen=True)
class Numbering:
    """Ids in the order of terms: computed by ``code`` if the terms allow it, else looked up in ``ids`` (id, term)."""

    code: Coding | None
    ids: DataFrame | None

    def edges(self, edges: DataFrame, *keep: str) -> DataFrame:
        """(src, dst, *keep) for ``edges`` (s, o, *keep); edges with a null end are dropped."""
        if self.code is not None:
            return edges.filter("s IS NOT NULL AND o IS NOT NULL").select(self.code.of(F.col("s")).alias("src"), self.code.of(F.col("o")).alias("dst"), *keep)
        known = small(self.ids)
        of = lambda end, name: known.select(F.col("term").alias(end), F.col("id").alias(name))
        return edges.join(of("s", "src"), "s").join(of("o", "dst"), "o").select("src", "dst", *keep)

    def vertices(self, terms: DataFrame) -> DataFrame:
        """(v): ids of the distinct values of the one column of ``terms``, all of which were numbered; null has none."""
        column = terms.columns[0]
        if self.code is not None:
            return terms.filter(F.col(column).isNotNull()).select(self.code.of(F.col(column)).alias("v")).distinct()
        return terms.select(F.col(column).alias("term")).distinct().join(self.ids, "term").select(F.col("id").alias("v"))

    def terms(self, state: DataFrame, column: str = "v") -> DataFrame:
        """``state`` with the ids in ``column`` turned back to terms."""
        if self.code is not None:
            return state.withColumn(column, self.code.term(F.col(column)))
        return decode(state, self.ids, column)

    def plain(self) -> bool:
        """Whether all terms are IRIs, so that ids are in STR order too."""
        if self.code is not None:
            return not any(p.startswith(("_:", '"')) for p in self.code.prefixes)
        return self.ids.filter(F.col("term").startswith("_:") | F.col("term").startswith('"')).isEmpty()


def numbering(ends: DataFrame) -> Numbering:
    """Ids for the values of the one column of ``ends``."""
    code = coding(ends)
    return Numbering(code, dictionary(ends) if code is None else None)


def numbered(held: Held, edges: DataFrame, also: tuple[str, ...] = ()) -> tuple[Numbering, DataFrame]:
    """Ids for the ends of ``edges`` (s, o, ...) and for ``also``, and (src, dst, ...) of all edges, null for a null end.

    The edges are written by ``held`` as prefixes and numbers before it is known whether ids can be computed from these, so
    ``edges`` is evaluated once if they can.
    """
    keep = [c for c in edges.columns if c not in ("s", "o")]
    parts = []
    for end in "so":
        prefix, n = _split(F.col(end))
        number = F.when(n > 0, F.col(end).substr(F.char_length(prefix) + 1, n).try_cast("long")).otherwise(F.when(n == 0, F.lit(0).cast("long")))
        parts += [prefix.alias(f"{end}_prefix"), number.alias(f"{end}_number"), n.alias(f"{end}_n")]
    split = held.keep(edges.select(*parts, *keep))
    digits = {t.rstrip(DIGITS): 0 for t in also}
    for t in also:
        digits[t.rstrip(DIGITS)] = max(digits[t.rstrip(DIGITS)], len(t) - len(t.rstrip(DIGITS)))
    for end in "so":
        found = split.filter(f"{end}_prefix IS NOT NULL").groupBy(f"{end}_prefix").agg(F.max(f"{end}_n")).limit(PREFIXES + 1)
        for prefix, n in map(tuple, fetch(found)):
            digits[prefix] = max(n, digits.get(prefix, 0))
    code = _coding(digits)
    if code is not None:
        of = lambda end: code.of_parts(*[F.col(f"{end}_{x}") for x in ("prefix", "number", "n")])
        return Numbering(code, None), held.instead(split, split.select(of("s").alias("src"), of("o").alias("dst"), *keep))
    held.drop(split)
    ends = edges.select(F.explode(F.array("s", "o")).alias("v"))
    names = Numbering(None, dictionary(ends.unionByName(edges.sparkSession.createDataFrame([(t,) for t in also], "v string")) if also else ends))
    known = small(names.ids)
    id_of = lambda end, name: known.select(F.col("term").alias(end), F.col("id").alias(name))
    return names, held.keep(edges.join(id_of("s", "src"), "s", "left").join(id_of("o", "dst"), "o", "left").select("src", "dst", *keep))


def encode(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst) as ids for ``edges`` (s, o) of terms; a term without an id drops its edge."""
    return (
        edges.join(ids.select(F.col("term").alias("s"), F.col("id").alias("src")), "s")
        .join(ids.select(F.col("term").alias("o"), F.col("id").alias("dst")), "o")
        .select("src", "dst")
    )


def decode(state: DataFrame, ids: DataFrame, column: str = "v") -> DataFrame:
    """``state`` with the ids in ``column`` turned back to terms."""
    return state.join(ids.select(F.col("id").alias(column), "term"), column).drop(column).withColumnRenamed("term", column)
