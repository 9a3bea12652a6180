"""Column helpers and small plan helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veingraph.plans.iteration import cut, shared_folder, small

__all__ = ["cut", "shared_folder", "small"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java classes of the characters that separate words in the two word definitions.
BLANKS = r"[\x20\x09-\x0D]"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, even inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII texts take the fast built-in."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs of non-separator characters; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{separators}+")
    return F.filter(parts, lambda w: w != "")


def blank_words(text: Column) -> Column:
    """Words between ASCII white space, unchanged."""
    return split_words(text, BLANKS)


def plain_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits and of all non-ASCII characters."""
    return split_words(ascii_lower(text), NON_WORD)


def row_key(doc_id: Column, text: Column) -> Column:
    """Joins a row's derived data back to it: rows that agree in id and text share results."""
    return F.struct(doc_id.alias("id"), F.xxhash64(doc_id, text).alias("h"))


#: Parts that a key's rows are dealt to where one key may hold a third of them.
SALT = 32


def salted(many: DataFrame, few: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with the written table ``few``, which has a row for each value of ``on``.

    A small table is broadcast. Else each of its rows goes to all parts of its key, and the many rows of a key to the
    part that their column ``by`` falls in, so that a hot key is no single task's.
    """
    known = small(few)
    if known is not few:
        return many.join(known, on, how)
    parts = few.withColumn("_vg_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.withColumn("_vg_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(parts, [on, "_vg_salt"], how).drop("_vg_salt")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and where it lies."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes what ``stored`` has written, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
