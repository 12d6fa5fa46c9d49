"""Statistics over grouped series: trends, false discovery, pooling, tails, interpolation."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidewell.functions.statistics import normal_quantile
from tidewell.operators.ranks import rises
from tidewell.operators.scan import PART, carried, in_ranges
from tidewell.streaming.folder import shared_folder


def _rises(rows: DataFrame, key: Sequence[str], order: Column, value: str) -> DataFrame:
    """(key, n, s_stat): each series' rising less its falling pairs. A series is sorted in one task, its values alone, in n log n."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([*(StructField(k, types[k]) for k in key), StructField("n", IntegerType()), StructField("s_stat", DoubleType())])

    def count(table: pa.Table) -> pa.Table:
        values = table.sort_by("_o")["_v"].to_numpy()
        return pa.table([*(table[k][:1] for k in key), pa.array([len(values)], pa.int32()), pa.array([float(rises(values))])], names=[*key, "n", "s_stat"])

    return rows.filter(F.col(value).isNotNull()).select(*key, order.alias("_o"), F.col(value).cast("double").alias("_v")).groupBy(*key).applyInArrow(count, schema)


def mann_kendall(rows: DataFrame, key: Sequence[str], order: Column, value: str) -> DataFrame:
    """S, its variance without tie correction, continuity-corrected z and direction of each series, of any length."""
    n = F.col("n").cast("double")  # an integer's cube would overflow
    z = F.when(F.col("variance") == 0, 0.0).when(F.col("s_stat") > 0, (F.col("s_stat") - 1) / F.sqrt("variance")).when(F.col("s_stat") < 0, (F.col("s_stat") + 1) / F.sqrt("variance")).otherwise(0.0)
    out = _rises(rows, key, order, value).withColumn("variance", n * (n - 1) * (2 * n + 5) / 18).withColumn("z", z)
    return out.withColumn("direction", F.when(F.col("z") > 0, "increasing").when(F.col("z") < 0, "decreasing").otherwise("no-monotonic-direction"))


def seasonal_kendall(rows: DataFrame, key: Sequence[str], season: str, order: Column, value: str, least: int = 6) -> DataFrame:
    """S and compared pairs of each series, summed over its seasons; fewer pairs than `least` give no direction."""
    each = _rises(rows, [*key, season], order, value).withColumn("pairs", (F.col("n").cast("long") * (F.col("n") - 1) / 2).cast("long")).filter("pairs > 0")
    out = each.groupBy(*key).agg(F.sum("s_stat").alias("s_stat"), F.sum("pairs").alias("pairs"))
    return out.withColumn("direction", F.when(F.col("pairs") < least, "insufficient").when(F.col("s_stat") > 0, "increasing").when(F.col("s_stat") < 0, "decreasing").otherwise("no-trend"))


def benjamini_hochberg(rows: DataFrame, row_id: str, p: str) -> DataFrame:
    """q-values: running minimum from the largest p of p * n / rank. Ranks and minima are carried over ranges of p."""
    parted = in_ranges(rows.filter(F.col(p).isNotNull()), F.col(p), F.col(row_id))
    w = Window.partitionBy(PART).orderBy(F.col(p).asc(), F.col(row_id).asc())
    n = parted.count()
    ranked = parted.withColumn("rank", (carried(parted, F.count("*"), lambda a, b: a + b, 0) + F.row_number().over(w)).cast("int"))
    ratio = F.col(p) * F.lit(float(n)) / F.col("rank")
    later = carried(ranked, F.min(ratio), min, 1.0, after=True)
    own = F.min(ratio).over(w.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("q", F.least(F.lit(1.0), own, later)).select(row_id, p, "rank", "q")


def half_life(rows: DataFrame, key: Sequence[str], date: str, value: str) -> DataFrame:
    """Lag-1 correlation of each series, its mean lag in days, and the half-life that follows from them."""
    w = Window.partitionBy(*key).orderBy(date)
    pairs = rows.withColumns({"_v": F.lag(value).over(w), "_d": F.lag(date).over(w)}).filter("_v is not null")
    out = pairs.groupBy(*key).agg(F.count("*").alias("pairs"), F.corr(value, "_v").alias("rho"), F.avg(F.datediff(date, "_d")).alias("mean_lag"))
    life = F.when((F.col("pairs") >= 3) & (F.col("rho") > 0) & (F.col("rho") < 1) & (F.col("mean_lag") > 0), -math.log(2) * F.col("mean_lag") / F.ln(F.when(F.col("rho") > 0, F.col("rho"))))
    return out.withColumn("half_life_days", life)


def partial_pooling(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Group means shrunk to the grand mean by the share of between-group variance, with a 95 % interval."""
    groups = rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var")).filter("n > 0")
    grand = groups.agg(F.avg("mean").alias("grand"), F.greatest(F.coalesce(F.var_samp("mean"), F.lit(0.0)) - F.avg(F.col("var") / F.col("n")), F.lit(1e-9)).alias("tau2"))
    out = groups.crossJoin(F.broadcast(grand))  # one row
    se2 = F.greatest(F.col("var"), F.lit(1e-9)) / F.col("n")
    weight = F.col("tau2") / (F.col("tau2") + se2)
    out = out.withColumns({"weight": weight, "pooled": weight * F.col("mean") + (1 - weight) * F.col("grand"), "_sd": F.sqrt(1 / (1 / F.col("tau2") + 1 / se2))})
    return out.select(key, "n", "mean", "weight", "pooled", (F.col("pooled") - 1.96 * F.col("_sd")).alias("low"), (F.col("pooled") + 1.96 * F.col("_sd")).alias("high"))


def extreme_tail(rows: DataFrame, key: Sequence[str], value: str, threshold: float, least: int = 8) -> DataFrame:
    """Generalised Pareto shape and scale of exceedances by moments."""
    out = rows.filter(F.col(value) > threshold).groupBy(*key).agg(F.count("*").alias("exceedances"), F.avg(F.col(value) - threshold).alias("m"), F.var_samp(F.col(value) - threshold).alias("v")).filter(F.col("exceedances") >= least)
    shape = F.greatest(F.lit(-0.49), F.least(F.lit(0.49), 0.5 * (1 - F.col("m") * F.col("m") / F.nullif(F.col("v"), F.lit(0.0)))))
    return out.withColumn("shape", shape).withColumn("scale", F.greatest(F.col("m") * (1 - F.col("shape")), F.lit(1e-9))).drop("m", "v")


def inverse_distance(pairs: DataFrame, key: str, value: str, distance: str, power: float = 2.0, least: int = 3, same: str | None = None, apart: str | None = None) -> DataFrame:
    """Weighted mean, its spread and standard error of neighbours' values, from pairs that a bounded nearest-k join has made.

    same: whether a neighbour shares the place's aquifer, which doubles its weight; apart: how far their depths differ, which
    divides it by 1 and a hundredth of that. Missing ones change nothing.
    """
    w = 1 / F.pow(F.col(distance) + 1e-3, F.lit(power))
    w = w * F.when(F.coalesce(F.col(same), F.lit(False)), 2.0).otherwise(1.0) if same else w
    w = w / (1 + F.abs(F.coalesce(F.col(apart), F.lit(0.0))) / 100) if apart else w
    out = pairs.filter(F.col(value).isNotNull()).withColumn("_w", w).groupBy(key).agg(F.count("*").alias("points"), (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("estimate"), (F.sum(F.col("_w") * F.col(value) * F.col(value)) / F.sum("_w")).alias("_m2"))
    spread = F.sqrt(F.greatest(F.col("_m2") - F.col("estimate") * F.col("estimate"), F.lit(0.0)))
    return out.filter(F.col("points") >= least).withColumn("spread", spread).withColumn("standard_error", F.col("spread") / F.sqrt("points")).drop("_m2")


def change_points(rows: DataFrame, key: str, order: str, value: str, least: int = 4) -> DataFrame:
    """Binary segmentation of each series: split where squared error falls most, while it falls by more than ln(n) * variance.

    A recursion over a bounded series, so each series is one pandas group.
    """

    def split(v: np.ndarray, a: int, b: int, penalty: float) -> list[int]:
        if b - a < 2 * least:
            return []
        s, q = np.concatenate([[0], np.cumsum(v[a:b])]), np.concatenate([[0], np.cumsum(v[a:b] ** 2)])
        k = np.arange(least, b - a - least + 1)
        cost = q[k] - s[k] ** 2 / k + (q[-1] - q[k]) - (s[-1] - s[k]) ** 2 / (b - a - k)
        i = int(np.argmin(cost))
        if q[-1] - s[-1] ** 2 / (b - a) - cost[i] <= penalty:
            return []
        m = a + int(k[i])
        return [*split(v, a, m, penalty), m, *split(v, m, b, penalty)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        found = split(v, 0, len(v), math.log(max(len(v), 2)) * float(np.var(v))) if len(v) else []
        return pd.DataFrame({key: pdf[key].iloc[0], "position": np.array(found, np.int32)})

    return rows.select(key, order, value).dropna().groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, position int")


def order_statistics_fit(rows: DataFrame, key: Sequence[str], value: str, least: int = 3) -> DataFrame:
    """Regression of the logs of detected values on normal quantiles of their plotting positions: intercept, slope, n."""
    w = Window.partitionBy(*key).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*key))
    p = (F.row_number().over(w) - 0.375) / (n + 0.25)
    # logistic approximation of the normal quantile: monotone, closed form
    z = rows.filter(F.col(value) > 0).withColumns({"_p": p, "_y": F.log(value)}).withColumn("_z", 4.91 * (F.pow(F.col("_p"), F.lit(0.14)) - F.pow(1 - F.col("_p"), F.lit(0.14))))
    return z.groupBy(*key).agg(F.count("*").alias("detects"), F.regr_slope("_y", "_z").alias("slope"), F.regr_intercept("_y", "_z").alias("intercept")).filter(F.col("detects") >= least)


def digit_profile(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Chi-square of first digits against Benford's law, the share of the commonest third decimal, and whether either is odd.

    Values of zero or below, by size alone, and missing ones take no part. A screening signal: rounding makes patterns too.
    """
    size = F.abs(F.col(value))
    rows = rows.filter(size > 0).withColumns({"d": F.regexp_extract(F.format_string("%.12e", size.cast("double")), "^([1-9])", 1).try_cast("int"), "t": (F.round(size * 1000) % 10).cast("int")})
    n = rows.groupBy(*key).pivot("d", list(range(1, 10))).agg(F.count(F.lit(1))).fillna(0, [str(i) for i in range(1, 10)])
    total = sum((F.col(str(i)) for i in range(2, 10)), F.col("1"))
    share = lambda i: F.log10(F.lit(1 + 1 / i)) * total
    chi = sum((F.pow(F.col(str(i)) - share(i), F.lit(2)) / share(i) for i in range(2, 10)), F.pow(F.col("1") - share(1), F.lit(2)) / share(1))
    last = rows.groupBy(*key, "t").agg(F.count("*").alias("c")).groupBy(*key).agg((F.max("c") / F.sum("c")).alias("terminal_share"))
    out = n.select(*key, total.alias("n"), chi.alias("chi_square")).join(last, list(key))
    return out.withColumn("flag", (F.col("n") >= 30) & ((F.col("chi_square") > 20.09) | (F.col("terminal_share") > 0.25)))


def ridge_residuals(rows: DataFrame, key: str, order: str, value: str, features: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """Residuals of each series after a ridge regression on its features, solved in closed form; one bounded series a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf[list(features)].to_numpy(float), pdf[value].to_numpy(float)
        x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0)
        beta = np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ (y - y.mean()))
        return pd.DataFrame({key: pdf[key], "position": np.arange(len(pdf), dtype=np.int32), "residual": np.round(y - y.mean() - x @ beta, 6)})

    return rows.select(key, order, value, *features).dropna().groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, position int, residual double")


def impute_censored(rows: DataFrame, key: Sequence[str], row_id: str, value: str, limit: str, censored: str, least: int = 3) -> DataFrame:
    """Regression on order statistics: the detected values, and for each censored row one from their fitted line.

    Returns key, row id, censored, value: a censored row's value is the line's at its rank among limits, never above its
    own limit. A group with fewer than `least` detected values above zero gets no values for its censored rows.
    Rows are dealt to ranges of their order and written sorted to the shared folder; a row's rank is its place in its range
    and the sizes of the ranges before, so no group is sorted in one task.
    """
    spark = rows.sparkSession
    v = F.when(F.col(censored), F.col(limit)).otherwise(F.col(value))
    known = rows.filter(F.when(F.col(censored), F.col(limit).isNotNull()).otherwise(F.col(value) > 0)).select(*key, F.col(row_id), F.col(censored).alias("_c"), v.alias("_v"))
    order = [*key, "_c", "_v", row_id]
    folder = f"{shared_folder(spark)}/ranks-{uuid.uuid4().hex}"
    placed = known.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.select(*order, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).write.parquet(folder)
    known = spark.read.parquet(folder)
    w = Window.partitionBy(*key, "_c")
    sizes = known.groupBy(*key, "_c", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_m": F.sum("_n").over(w)})
    of = [*key, "_c", "_part"]
    sizes = sizes.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(of)], "_first", "_before", "_m")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(of)])  # a null key is a group too
    known = known.join(sizes, same).select(*order, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("_i"), "_m")
    z = normal_quantile((F.col("_i") - 0.375) / (F.col("_m") + 0.25))
    found = known.filter(~F.col("_c")).select(*key, F.ln("_v").alias("_y"), z.alias("_z"))
    line = found.groupBy(*key).agg(F.count("*").alias("_n"), F.regr_slope("_y", "_z").alias("_slope"), F.regr_intercept("_y", "_z").alias("_at0"))
    out = known.join(line, list(key), "left")
    guess = F.exp(F.col("_at0") + F.col("_slope") * normal_quantile((F.col("_i") - 0.5) / (F.col("_m") + F.col("_n"))))
    filled = F.when(~F.col("_c"), F.col("_v")).when(F.col("_n") >= least, F.least(F.col("_v"), guess))
    return out.select(*key, row_id, F.col("_c").alias("censored"), filled.alias("value"))


def censored_summary(rows: DataFrame, key: Sequence[str], value: str, censored: str) -> DataFrame:
    """How many results are detected and left-censored, and which method they call for; nothing is substituted."""
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~F.col(censored) & F.col(value).isNotNull()).alias("detected_n"), F.count_if(censored).alias("left_censored_n"))
    return out.withColumn("method", F.when((F.col("detected_n") >= 3) & (F.col("left_censored_n") > 0), "ROS/Kaplan-Meier-required").otherwise("descriptive-only"))


#: Points in a block of series.
SERIES_BLOCK = 256


def inferred_links(series: DataFrame, point: str, date: str, value: str, overlap: int = 6, least: float = 0.75) -> DataFrame:
    """Pairs of points whose series correlate at `least` or more on enough common dates, with a certainty of 0.5 to 1: a, b, days, correlation, certainty.

    Points are dealt to blocks, and blocks meet in pairs: of two blocks' values by date, matrix products give the counts and sums of
    all their points' pairs at once, and only pairs that pass leave the task. Work grows with pairs of points, as it must; no date
    pairs its points. Several values of a date are averaged, missing ones left out; a series without spread has no links.
    """
    one = series.filter(F.col(value).isNotNull() & F.col(point).isNotNull()).groupBy(F.unix_date(F.col(date).cast("date")).alias("d"), F.col(point).alias("p")).agg(F.avg(value).alias("v")).filter("d is not null")
    blocks = max(1, -(-one.select("p").distinct().count() // SERIES_BLOCK))
    kind = dict(one.dtypes)["p"]

    def pack(t: pa.Table) -> pa.Table:
        points, row = np.unique(t["p"].to_numpy(), return_inverse=True)
        v = t["v"].to_numpy().astype(float)
        v = v - (np.bincount(row, v) / np.bincount(row))[row]  # about a point's mean, which keeps the sums small
        order = np.argsort(t["d"].to_numpy(), kind="stable")
        cols = [t["block"][:1].combine_chunks(), pa.array([points.tolist()], pa.list_(t.schema.field("p").type)), *(pa.array([x[order].astype(k).tobytes()], pa.binary()) for x, k in ((row, np.int32), (t["d"].to_numpy(), np.int32), (v, np.float64)))]
        return pa.table(cols, names=["block", "points", "row", "d", "v"])

    packed = one.withColumn("block", F.pmod(F.xxhash64("p"), F.lit(blocks))).groupBy("block").applyInArrow(pack, f"block long, points array<{kind}>, row binary, d binary, v binary")
    left = packed.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1).cast("long"))))
    right = packed.select(F.col("block").alias("_b"), *[F.col(c).alias(f"_{c}") for c in ("points", "row", "d", "v")]).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))))

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        x, y = mine.to_pylist()[0], {k.removeprefix("_"): v for k, v in theirs.to_pylist()[0].items()}
        days = np.intersect1d(np.frombuffer(x["d"], np.int32), np.frombuffer(y["d"], np.int32))

        def dense(side: dict) -> tuple[np.ndarray, np.ndarray]:
            row, d, v = (np.frombuffer(side[c], k) for c, k in (("row", np.int32), ("d", np.int32), ("v", np.float64)))
            at = np.minimum(np.searchsorted(days, d), max(0, len(days) - 1))
            on = days[at] == d if len(days) else np.zeros(len(d), bool)
            m, known = (np.zeros((len(days), len(side["points"]))) for _ in range(2))
            m[at[on], row[on]], known[at[on], row[on]] = v[on], 1.0
            return m, known

        (a, p), (b, q) = dense(x), dense(y)
        n, sa, sb, ab = p.T @ q, a.T @ q, p.T @ b, a.T @ b
        va, vb = (a * a).T @ q - sa * sa / np.maximum(n, 1), p.T @ (b * b) - sb * sb / np.maximum(n, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.where((va > 1e-12) & (vb > 1e-12), (ab - sa * sb / np.maximum(n, 1)) / np.sqrt(va * vb), np.nan)
        keep = (n >= overlap) & (corr >= least)
        i, j = np.nonzero(np.triu(keep, 1) if x["block"] == y["b"] else keep)
        pairs = [sorted((x["points"][k], y["points"][m])) for k, m in zip(i.tolist(), j.tolist())]
        of = mine.schema.field("points").type.value_type
        return pa.table([pa.array([f for f, _ in pairs], of), pa.array([s for _, s in pairs], of), pa.array(n[i, j].astype(np.int64)), pa.array(np.minimum(corr[i, j], 1.0))], names=["a", "b", "days", "correlation"])

    out = left.groupBy("block", "other").cogroup(right.groupBy("_a", "_b")).applyInArrow(meet, f"a {kind}, b {kind}, days long, correlation double")
    certainty = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("correlation") - least) / (1 - least) * 0.5 + 0.5))
    return out.withColumn("certainty", certainty)
