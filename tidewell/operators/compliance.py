"""Rule-specific compliance statistics over measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.measure import year_quarter

# Action levels in ug/L.
P90_LEVELS = {"LEAD": 10.0, "COPPER": 1300.0}
LRAA_LEVELS = {"TOTAL THMS": 80.0, "TTHM": 80.0, "TOTAL HALOACETIC ACIDS (HAA5)": 60.0, "HAA5": 60.0}
RAA_LEVELS = {"URANIUM": 30.0, "COMBINED RADIUM 226/228": 5.0, "GROSS ALPHA": 15.0}  # the last two in pCi/L
SINGLE_LEVELS = {"NITRATE": 10000.0, "NITRITE": 1000.0}


def _level(levels: dict[str, float], analyte: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in levels.items() for x in p]), analyte)


def percentile_90(rows: DataFrame, value: str = "value", least: int = 5) -> DataFrame:
    """Nearest-rank 90th percentile of tap samples for each system and analyte, its status, and whether there are samples enough to claim compliance by it."""
    rows = rows.filter(F.col("analyte").isin(*P90_LEVELS) & F.col("sample_type").rlike("(?i)TAP|LCR|FIRST"))
    out = rows.groupBy("pwsid", "analyte").agg(F.expr(f"percentile_disc(0.9) within group (order by {value})").alias("p90"), F.count(value).alias("samples"))
    status = F.when(F.col("p90").isNull(), "insufficient-data").when(F.col("p90") > _level(P90_LEVELS, F.col("analyte")), "action-level-exceedance").otherwise("below-action-level")
    return out.withColumns({"status": status, "claim_allowed": F.col("samples") >= least})


def locational_average(rows: DataFrame, value: str = "value", quarters: int = 4) -> DataFrame:
    """Mean of the means of the last quarters that have data, by system, location and analyte."""
    key = ["pwsid", "location_code", "analyte"]
    by_quarter = rows.filter(F.col("analyte").isin(*LRAA_LEVELS)).groupBy(*key, year_quarter(F.col("sample_date")).alias("quarter")).agg(F.avg(value).alias("mean")).filter("mean is not null")
    recent = by_quarter.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("quarter").desc()))).filter(F.col("n") <= quarters)
    out = recent.groupBy(*key).agg(F.avg("mean").alias("lraa"), F.count("*").alias("quarters"))
    return out.withColumn("status", F.when(F.col("quarters") < quarters, "incomplete-window").when(F.col("lraa") > _level(LRAA_LEVELS, F.col("analyte")), "exceeds").otherwise("within"))


def running_average(rows: DataFrame, order: Sequence[Column], value: str = "value", samples: int = 4) -> DataFrame:
    """Mean of the last samples, by system, location and analyte."""
    key = ["pwsid", "location_code", "analyte"]
    recent = rows.filter(F.col("analyte").isin(*RAA_LEVELS)).withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("n") <= samples)
    out = recent.groupBy(*key).agg(F.avg(value).alias("raa"), F.count("*").alias("samples"))
    return out.withColumn("status", F.when(F.col("samples") < samples, "incomplete-window").when(F.col("raa") > _level(RAA_LEVELS, F.col("analyte")), "exceeds").otherwise("within"))


def confirmed_exceedance(rows: DataFrame, order: Sequence[Column], value: str = "value", days: int = 30) -> DataFrame:
    """A system's latest sample against the level; above it, whether another day's sample within `days` is above it too."""
    key = ["pwsid", "analyte"]
    rows = rows.filter(F.col("analyte").isin(*SINGLE_LEVELS) & F.col(value).isNotNull() & F.col("sample_date").isNotNull()).withColumn("_level", _level(SINGLE_LEVELS, F.col("analyte")))
    w = Window.partitionBy(*key)
    rows = rows.withColumns({"_last": F.max("sample_date").over(w), "_n": F.row_number().over(w.orderBy(*order))})
    again = (F.col("sample_date") < F.col("_last")) & (F.datediff("_last", "sample_date") <= days) & (F.col(value) > F.col("_level"))
    out = rows.groupBy(*key).agg(F.max("sample_date").alias("latest"), F.max(F.when(F.col("_n") == 1, F.col(value))).alias("value"), F.bool_or(again).alias("confirmation_found"), F.first("_level").alias("_level"))
    status = F.when(F.col("value") <= F.col("_level"), "below-mcl").when(F.col("confirmation_found"), "confirmed-exceedance").otherwise("confirmation-required")
    return out.withColumn("status", status).drop("_level")


def positives(rows: DataFrame, result: str, analytes: Sequence[str] = ("TOTAL COLIFORM", "E. COLI")) -> DataFrame:
    """Positive records of microbial analytes; any calls for an assessment, none proves nothing."""
    out = rows.filter(F.col("analyte").isin(*analytes)).groupBy("pwsid", "analyte").agg(F.count_if(F.col(result).rlike("(?i)POS|PRESENT|DETECT")).alias("positive_count"), F.count("*").alias("records"))
    return out.withColumn("status", F.when(F.col("positive_count") > 0, "assessment-or-condition-review-required").otherwise("no-positive-records-in-input"))


def screening(rows: DataFrame, order: Sequence[Column], value: str = "value") -> DataFrame:
    """The latest result of analytes without a rule of their own, which allows no claim of compliance."""
    ruled = [*P90_LEVELS, *LRAA_LEVELS, *RAA_LEVELS, *SINGLE_LEVELS]
    rest = rows.filter(~F.col("analyte").isin(*ruled) & F.col(value).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("pwsid", "analyte").orderBy(*order))).filter("_n = 1")
    return rest.select("pwsid", "analyte", value, F.lit("screening-result-only").alias("status"))


def trailing_average(rows: DataFrame, key: Sequence[str], value: str, date: str, days: int = 365, least: int = 4) -> DataFrame:
    """Mean over the days up to each key's latest date, non-detects counted as zero, and whether there are enough."""
    last = F.max(date).over(Window.partitionBy(*key))
    recent = rows.withColumn("_last", last).filter(F.datediff("_last", date) <= days)
    out = recent.groupBy(*key).agg(F.avg(F.coalesce(F.col(value), F.lit(0.0))).alias("raa"), F.count("*").alias("samples"), F.max(date).alias("latest"))
    return out.withColumn("sufficient", F.col("samples") >= least)


def hazard_index(rows: DataFrame, key: Sequence[str], analyte: str, value: str, order: Sequence[Column], levels: dict[str, float]) -> DataFrame:
    """Sum of each analyte's latest value over its health-based level; 1 or more exceeds."""
    recent = rows.filter(F.col(analyte).isin(*levels) & F.col(value).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*key, analyte).orderBy(*order))).filter("_n = 1")
    out = recent.groupBy(*key).agg(F.sum(F.col(value) / _level(levels, F.col(analyte))).alias("hazard_index"), F.count("*").alias("analytes"))
    return out.withColumn("exceeds", F.col("hazard_index") >= 1)
