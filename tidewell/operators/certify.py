"""Report-level judgements by rule: what evidence to get next, how robust a conclusion is, how strategic sampling looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import clamp

# Actions with the chance to flip a verdict, the gain in confidence, severity and effort.
ACTIONS = {
    "utility-confirmation": (0.75, 0.45, 0.9, 0.35),
    "household-sample": (0.65, 0.5, 1.0, 0.8),
    "lab-accreditation": (0.25, 0.25, 0.55, 0.25),
    "current-ccr": (0.25, 0.2, 0.5, 0.15),
    "violation-resolution": (0.7, 0.35, 0.9, 0.25),
    "fresh-chemistry": (0.45, 0.35, 0.7, 0.35),
    "coverage-gap": (0.35, 0.3, 0.65, 0.5),
    "contradiction-resolution": (0.5, 0.3, 0.8, 0.4),
}
# Weights of the signs of strategic sampling.
SIGNS = {"limit_bunching": 0.25, "mdl_bunching": 0.15, "censoring_drift": 0.2, "peer_divergence": 0.25, "protocol_shift": 0.15}


def next_evidence(reports: DataFrame, report: str) -> DataFrame:
    """(report, action, priority, rank) for every rule that holds, the most urgent first; ties go by the rules' order.

    reports: accepted, stability, household_samples, unverified_labs, has_ccr, active_violations, freshness, coverage,
    contradictions. A missing number counts as 0 and a missing flag as false; a missing stability alone doesn't ask for
    the utility's confirmation.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    holds = {
        "utility-confirmation": ~yes("accepted") | F.coalesce(F.col("stability") < 0.75, F.lit(False)), "household-sample": n("household_samples") == 0, "lab-accreditation": n("unverified_labs") > 0, "current-ccr": ~yes("has_ccr"),
        "violation-resolution": n("active_violations") > 0, "fresh-chemistry": n("freshness") < 0.55, "coverage-gap": n("coverage") < 0.55, "contradiction-resolution": n("contradictions") > 0,
    }
    made = [F.when(holds[a], F.struct(F.lit(a).alias("action"), F.lit(round(f * g * s / max(0.1, e), 4)).alias("priority"), F.lit(i).alias("_i"))) for i, (a, (f, g, s, e)) in enumerate(ACTIONS.items())]
    each = reports.select(report, F.explode(F.filter(F.array(*made), lambda q: q.isNotNull())).alias("q")).select(report, "q.*")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy(report).orderBy(F.col("priority").desc(), "_i"))).drop("_i")


def robustness(accepted: Column, stability: Column, household_samples: Column, household_claim: Column, identity_veto: Column, confidence: Column, contradictions: Column) -> Column:
    """Struct of checks passed, level and scope over six checks; a missing score counts as 0 and fails its check."""
    no = lambda c: F.coalesce(c, F.lit(False))
    some = F.coalesce(household_samples, F.lit(0)) > 0
    checks = [no(accepted), no(stability >= 0.75), some | ~no(household_claim), ~no(identity_veto), no(confidence >= 0.55), F.coalesce(contradictions, F.lit(0)) <= 3]
    passed = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    level = F.when(passed == 6, "robust").when(passed == 5, "conditionally-robust").when(passed >= 3, "limited").otherwise("fragile")
    return F.struct(passed.alias("passed"), level.alias("level"), F.when(some, "household-and-system").otherwise("system-level-only").alias("scope"))


def strategic_sampling(rows: DataFrame, key: str, value: str, limit: Column, at_mdl: Column, censored: str, period: str, divergence: Column, shift: Column, band: float = 0.05) -> DataFrame:
    """Five signs, their weighted sum and a tier for each key: a screening signal, never a finding.

    Bunching is the share of values within the band below their limit less the share in the band below that; the drift
    is the last period's censored share less the first one's, if it grew. divergence and shift are 0 to 1, averaged.
    """
    v = F.col(value)
    near, before = v.between(limit * (1 - band), limit), (v < limit * (1 - band)) & (v >= limit * (1 - 2 * band))
    each = rows.groupBy(key, period).agg(
        F.avg(F.col(censored).cast("int")).alias("_rate"), F.count(value).alias("_n"), F.count_if(near).alias("_near"), F.count_if(before).alias("_before"), F.count_if(at_mdl).alias("_mdl"),
        F.sum(divergence).alias("_d"), F.sum(shift).alias("_s"), F.count("*").alias("_all"),
    )
    drift = F.when(F.count("*") > 1, F.max_by("_rate", period) - F.min_by("_rate", period)).otherwise(0.0)
    n = F.nullif(F.sum("_n"), F.lit(0))
    out = each.groupBy(key).agg(
        F.greatest(F.lit(0.0), F.coalesce((F.sum("_near") - F.sum("_before")) / n, F.lit(0.0))).alias("limit_bunching"), F.coalesce(F.sum("_mdl") / n, F.lit(0.0)).alias("mdl_bunching"), F.greatest(F.lit(0.0), drift).alias("censoring_drift"),
        clamp(F.coalesce(F.sum("_d") / F.sum("_all"), F.lit(0.0)), 0.0, 1.0).alias("peer_divergence"), clamp(F.coalesce(F.sum("_s") / F.sum("_all"), F.lit(0.0)), 0.0, 1.0).alias("protocol_shift"),
    )
    score = sum((F.col(c) * w for c, w in list(SIGNS.items())[1:]), F.col("limit_bunching") * SIGNS["limit_bunching"])
    return out.withColumn("composite_score", score).withColumn("tier", F.when(F.col("composite_score") >= 0.65, "high").when(F.col("composite_score") >= 0.35, "moderate").otherwise("low"))
