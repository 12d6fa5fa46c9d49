"""Versions, latest rows and validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_versions(rows: DataFrame, key: Sequence[str], revision: Sequence[Column], fingerprint: str) -> DataFrame:
    """version, is_current and superseded_by within each logical key; `revision` must order rows fully."""
    w = Window.partitionBy(*key).orderBy(*revision)
    return rows.withColumns({"version": F.row_number().over(w), "superseded_by": F.lead(fingerprint).over(w)}).withColumn("is_current", F.col("superseded_by").isNull())


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in this order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def keep_first(rows: DataFrame, key: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One row for each derived key, the first in this order."""
    keyed = rows.withColumns({f"_k{i}": c for i, c in enumerate(key)})
    return latest(keyed, [f"_k{i}" for i in range(len(key))], order).drop(*[f"_k{i}" for i in range(len(key))])


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """start <= at < end; an open end never passes."""
    return (start <= at) & (end.isNull() | (at < end))


def valid_through(at: Column, start: Column, end: Column) -> Column:
    """start <= at <= end; either side may be open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at <= end))


def as_of(rows: DataFrame, versions: DataFrame, on: Sequence[str], at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each row with the latest version that is valid at its date, both ends inclusive; rows without one keep nulls.

    Versions are few for each key, so rows meet their key's versions first and the latest is taken by a grouped maximum.
    """
    extra = [c for c in versions.columns if c not in on]
    packed = versions.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(F.col(start), *[c for c in extra if c != start])), asc=False).alias("_v"))
    joined = rows.join(packed, list(on), "left")
    fits = F.filter("_v", lambda v: (v[start] <= F.col(at)) & (v[end].isNull() | (v[end] >= F.col(at))))
    return joined.withColumn("_m", F.get(fits, F.lit(0))).select(*rows.columns, *[F.col("_m")[c].alias(c) for c in extra])


def flips(rows: DataFrame, key: Sequence[str], order: Column, status: str) -> DataFrame:
    """Rows whose status differs from the one before in their key."""
    before = F.lag(status).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("previous", before).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)))
