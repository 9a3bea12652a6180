"""A log of operations and its statistics."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "label string, context string, start double, seconds double, dbmem_used double, status string"


@dataclass
class Tracker:
    """Collects one entry for each tracked operation."""

    entries: list[tuple] = field(default_factory=list)

    @contextmanager
    def track(self, label: str, context: str = "") -> Iterator[None]:
        began = time.time()
        status = "ok"
        try:
            yield
        except Exception:
            status = "error"
            raise
        finally:
            self.entries.append((label, context, began, time.time() - began, None, status))

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, LOG_SCHEMA)


def tracking_stats(log: DataFrame) -> DataFrame:
    """(label, context, count, seconds, avg, min, max, dbmem_max) by operation and context, least time first."""
    stats = log.groupBy("label", "context").agg(
        F.count(F.lit(1)).alias("count"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("avg"),
        F.min("seconds").alias("min"), F.max("seconds").alias("max"), F.max("dbmem_used").alias("dbmem_max"),
    )
    return stats.orderBy("seconds", "avg", "label")


def tracking_high(log: DataFrame) -> DataFrame:
    """The statistics over 4 seconds, 10 operations or 100 units of memory."""
    return tracking_stats(log).filter("seconds > 4 OR count > 10 OR dbmem_max > 100")
