"""Prefix scans over all rows of a table without bringing them into one task.

Rows are dealt to ranges of their order and written to the checkpoint folder with the number of their range. A window runs within
each range; one summary a range (as many as there are partitions) gives what comes before or after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.streaming.folder import shared_folder

PART = "_part"


def in_ranges(rows: DataFrame, *by: Column, parts: int | None = None) -> DataFrame:
    """The rows with the number of their range of the order `by`; equal rows may stand on both sides of a boundary only if `by` doesn't tell them apart."""
    shared_folder(rows.sparkSession)
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *by).withColumn(PART, F.spark_partition_id()).checkpoint(eager=True)


def carried(rows: DataFrame, summary: Column, add: Callable[[float, float], float], start, after: bool = False) -> Column:
    """For the range that a row stands in, the summaries of all ranges before it (or after it) put together."""
    each = sorted(((r[PART], r["s"]) for r in rows.groupBy(PART).agg(summary.alias("s")).collect()), reverse=after)  # one row a range
    at, total = {}, start
    for part, s in each:
        at[part] = total
        total = total if s is None else s if total is None else add(total, s)
    if not at:
        return F.lit(start)
    return F.element_at(F.map_from_arrays(F.lit(list(at)), F.array(*[F.lit(v) for v in at.values()])), F.col(PART))
