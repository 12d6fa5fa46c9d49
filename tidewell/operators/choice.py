"""Order-dependent choices over small sorted lists, as folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_budget(rows: DataFrame, key: Sequence[str], row_id: str, ratio: Column, cost: str, gain: str, budget: float, most: int) -> DataFrame:
    """For each key the actions taken in order of ratio, skipping what no longer fits, `most` at most, and their joint gain.

    A fold over one key's sorted list of candidates, which is short by nature.
    """
    listed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-ratio).alias("o"), F.col(row_id).alias("id"), F.col(cost).cast("double").alias("c"), F.col(gain).cast("double").alias("g")))).alias("l"))
    empty = F.struct(F.lit(0.0).alias("spent"), F.lit(1.0).alias("miss"), F.array().cast(f"array<{dict(rows.dtypes)[row_id]}>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["spent"] + x["c"] <= budget + 1e-9) & (F.size(acc["ids"]) < most)
        return F.when(fits, F.struct((acc["spent"] + x["c"]).alias("spent"), (acc["miss"] * (1 - x["g"])).alias("miss"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))).otherwise(acc)

    out = listed.withColumn("r", F.aggregate("l", empty, step))
    return out.select(*key, F.col("r.ids").alias("chosen"), F.col("r.spent").alias("spent"), (1 - F.col("r.miss")).alias("joint_gain"))


def weighted_geometric(dims: dict[str, tuple[Column, int]]) -> Column:
    """Integer-weighted geometric mean over the positive dimensions."""
    logs = [F.when(c > 0, w * F.ln(c)).otherwise(0.0) for c, w in dims.values()]
    weights = [F.when(c > 0, w).otherwise(0) for c, w in dims.values()]
    total, weight = logs[0], weights[0]
    for a, b in zip(logs[1:], weights[1:]):
        total, weight = total + a, weight + b
    return F.when(weight > 0, F.exp(total / F.nullif(weight, F.lit(0))))


def verdict_envelope(base: Column, penalties: Sequence[tuple[Column, float]], upside: float = 0.05) -> tuple[Column, Column]:
    """Worst and best score under the penalties whose condition holds."""
    lost = F.lit(0.0)
    for condition, size in penalties:
        lost = lost + F.when(condition, size).otherwise(0.0)
    return F.greatest(F.lit(0.0), base - lost), F.least(F.lit(1.0), base + upside)


def certificate(checks: Sequence[Column]) -> Column:
    """robust if all checks hold, then by how many."""
    held = F.lit(0)
    for c in checks:
        held = held + F.when(c, 1).otherwise(0)
    n = len(checks)
    return F.when(held == n, "robust").when(held >= n - 1, "conditionally-robust").when(held >= n // 2, "limited").otherwise("fragile")
