"""Which claims about a place a record may support: seven dimensions, vetoes, and a roll-up by claim scope.

records: any of granularity, sample_type, sample_date, analysis_date, lab_status, lab_id, record_fingerprint, originating_sample_key, sample_id, source_id, publisher,
admissible, path_certainty, entry_point, facility_id, location_code, address_hash, pwsid, factual_status, is_current, superseded_by, and place_pwsid
and place_address_hash of the place that they are held against. A column that isn't there counts as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import clamp, logs, mean_of_logs
from tidewell.operators.budget import rounded

# Scopes from the coarsest to the finest, and the words of a sample's type that tell its scope, in order.
SCOPES = ("nearby-environmental-station", "regional-context", "public-water-system-record", "source-well-record", "treatment-entry-record", "distribution-point-record", "tap-sampling-record", "exact-household-sample")
WORDS = (("EXACT|HOUSEHOLD|HOME", "exact-household-sample"), ("TAP|RESIDENT", "tap-sampling-record"), ("DISTRIBUT|DS|LOCATION", "distribution-point-record"), ("ENTRY|POE|PLANT", "treatment-entry-record"), ("WELL|SOURCE", "source-well-record"))
SYSTEM = "public-water-system-record"
INCOMPATIBLE_CAP, OTHER_SYSTEM_CAP, ELIGIBLE = 0.15, 0.2, 0.5
DIMENSIONS = ("spatial", "temporal", "hydraulic", "provenance", "laboratory", "regulatory", "scope_compatibility")


def rank(scope: Column) -> Column:
    """A scope's place in the order; an unknown one counts as the system's."""
    known = F.create_map(*[F.lit(x) for i, s in enumerate(SCOPES) for x in (s, i)])
    return F.coalesce(F.try_element_at(known, scope), F.lit(SCOPES.index(SYSTEM)))


def applicability(records: DataFrame, scopes: Sequence[str], as_of: Column, half_life: float = 365.0) -> DataFrame:
    """Each record for each claim scope, with evidence_scope, dimensions, score, vetoes and whether it is eligible.

    Evidence may support a claim of its own scope or a coarser one, never a finer one; that, another system and quarantine are
    vetoes. A laboratory without accreditation is one with a poor status, also where the word holds the other's.
    """
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in records.columns else F.lit(None).cast("string")
    flag = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("boolean")
    has = lambda *cs: F.coalesce(*[text(c) for c in cs]).isNotNull()
    told = F.coalesce(text("granularity"), F.lit(""))
    by_type = F.lit(SYSTEM)
    for words, scope in reversed(WORDS):
        by_type = F.when(F.upper(F.coalesce(text("sample_type"), F.lit(""))).rlike(words), scope).otherwise(by_type)
    evidence_scope = F.when(told.isin(*SCOPES), told).otherwise(by_type)
    dated = [F.to_date(text(c)) for c in ("sample_date", "analysis_date")]
    age = F.greatest(F.datediff(as_of, F.coalesce(*dated)), F.lit(0))
    status = F.upper(F.coalesce(text("lab_status"), F.lit("")))
    same = F.coalesce(text("pwsid"), F.lit("")) == F.coalesce(text("place_pwsid"), F.lit(""))
    quarantined = F.coalesce(text("factual_status") == "quarantined", F.lit(False))
    part = lambda when, value: F.when(when, value).otherwise(0.0)
    compatible = rank(F.col("evidence_scope")) >= rank(F.col("claim_scope"))
    dims = {
        "spatial": F.when(text("place_address_hash") == text("address_hash"), 1.0).when(same & has("place_pwsid"), 0.88).otherwise(0.2),
        "temporal": F.when(F.coalesce(*dated).isNull(), 0.35).otherwise(clamp(F.pow(F.lit(0.5), age / max(1.0, half_life)), 0.05, 1.0)),
        "hydraulic": F.when(flag("admissible"), clamp(F.coalesce(F.nullif(text("path_certainty").cast("double"), F.lit(0.0)), F.lit(1.0)), 0.5, 1.0)).when(~flag("admissible"), 0.05).when(has("entry_point", "facility_id", "location_code"), 0.68).otherwise(0.55),
        "provenance": 0.45 + part(has("record_fingerprint"), 0.2) + part(has("originating_sample_key", "sample_id"), 0.18) + part(has("source_id"), 0.08) + part(has("publisher"), 0.05),
        "laboratory": F.when(status.rlike("UNACCREDITED|EXPIRED|REVOKED"), 0.35).when(status.rlike("ACCREDITED|VERIFIED"), 1.0).when(has("lab_id"), 0.72).otherwise(0.55),
        "regulatory": F.when(quarantined, 0.1).when(~F.coalesce(flag("is_current"), F.lit(True)), 0.45).when(has("superseded_by"), 0.35).when(has("pwsid"), 0.9).otherwise(0.5),
        "scope_compatibility": F.when(compatible, 1.0).otherwise(0.01),
    }
    # a record's own dimensions come before it is held against each scope
    own = [k for k in DIMENSIONS if k != "scope_compatibility"]
    out = records.withColumns({"evidence_scope": evidence_scope, "_same": same, "_quarantined": quarantined, "_own": F.struct(*[dims[k].alias(k) for k in own])})
    total, count = logs(*[F.col(f"_own.{k}") for k in own])
    out = out.withColumns({"_total": total, "_count": count}).withColumn("claim_scope", F.explode(F.array(*[F.lit(s) for s in scopes])))
    same, quarantined = F.col("_same"), F.col("_quarantined")
    out = out.withColumn("dimensions", F.struct(*[F.col(f"_own.{k}").alias(k) for k in own], dims["scope_compatibility"].alias("scope_compatibility")))
    last, one = logs(dims["scope_compatibility"])
    score = mean_of_logs(F.col("_total") + last, F.col("_count") + one)
    score = F.when(compatible, score).otherwise(F.least(score, F.lit(INCOMPATIBLE_CAP)))
    score = F.when(same, score).otherwise(F.least(score, F.lit(OTHER_SYSTEM_CAP)))
    vetoes = F.array(F.when(~compatible, F.concat("evidence_scope", F.lit(" cannot support "), "claim_scope")), F.when(quarantined, F.lit("the record is quarantined")), F.when(~same, F.lit("the record is of another system")))
    out = out.withColumns({"score": rounded(score), "vetoes": F.filter(vetoes, lambda m: m.isNotNull())})
    out = out.drop("_same", "_quarantined", "_own", "_total", "_count")
    return out.withColumn("eligible", (F.col("score") >= ELIGIBLE) & (F.size("vetoes") == 0))


def by_claim_scope(judged: DataFrame, record_id: str, top: int = 12) -> DataFrame:
    """eligible, total, mean, vetoed and the `top` records of each claim scope, the highest scores first, then the lesser id.

    Records are counted by score first (four digits, so few rows). That gives the score below which none can be among the `top`,
    and only those at or above it are put in order.
    """
    by_score = judged.groupBy("claim_scope", "score").agg(F.count_if("eligible").alias("eligible"), F.count("*").alias("n"), F.count_if(F.size("vetoes") > 0).alias("vetoed"), F.sum("score").alias("sum"))
    counts = by_score.groupBy("claim_scope").agg(F.sum("eligible").alias("eligible"), F.sum("n").alias("total"), F.round(F.sum("sum") / F.sum(F.when(F.col("score").isNotNull(), F.col("n"))), 4).alias("mean"), F.sum("vetoed").alias("vetoed"))
    higher = F.sum("n").over(Window.partitionBy("claim_scope").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1))
    least = by_score.withColumn("_higher", F.coalesce(higher, F.lit(0))).filter(F.col("_higher") < top).select(F.col("claim_scope").alias("_scope"), F.col("score").alias("_score"))
    w = Window.partitionBy("claim_scope").orderBy(F.col("score").desc(), F.col(record_id))
    near = judged.select("claim_scope", "score", record_id).join(F.broadcast(least), (F.col("claim_scope") == F.col("_scope")) & F.col("score").eqNullSafe(F.col("_score")), "left_semi")  # `top` rows a scope at most
    best = near.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top)
    best = best.groupBy("claim_scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(record_id).alias("id")))), lambda x: x["id"]).alias("top"))
    return counts.join(best, "claim_scope", "left")
