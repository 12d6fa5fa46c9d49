"""How sure a report may be of a place: nine dimensions with caps, and what stress would leave of it.

places, one row each: primary_found, secondary_found (whether a geocoder answered), geocoder_m, accepted, score, stability_status, stability_score, near_boundary,
gap, overlap, households, records, analytes, groups, newest (date), effective_n, contradictions (a count), federal_synced, ccr_synced, wqp_synced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scores import clamp, confidence_label
from tidewell.operators.choice import weighted_geometric

# How often a dimension counts in the system's score, caps, and steps of the distance of two geocoders in metres.
WEIGHTS = {"geolocation": 2, "provider_identity": 4, "spatial_robustness": 2, "temporal_freshness": 3, "contaminant_coverage": 3, "originating_sample_independence": 2, "source_conflict": 2, "federal_context_availability": 1}
UNRESOLVED_CAP, GAP_CAP, NO_SAMPLE_CAP = 0.25, 0.3, 0.49
APART = ((15, 1.0), (30, 0.93), (50, 0.82), (100, 0.58))
HALF_LIFE = 365.0


def rounded(x: Column, digits: int = 4) -> Column:
    """Ties go up, also where a product falls short of one by a float's last bit."""
    return F.round(x + 1e-9, digits)


def dimensions(as_of: Column) -> dict[str, Column]:
    """The nine dimensions, each 0 to 1 in four digits."""
    n, on = lambda c: F.coalesce(F.col(c), F.lit(0)), lambda c: F.coalesce(F.col(c), F.lit(False))
    distance = F.lit(0.3)
    for metres, value in reversed(APART):
        distance = F.when(F.col("geocoder_m") <= metres, value).otherwise(distance)
    geolocation = F.when(~on("primary_found") & ~on("secondary_found"), 0.0).when(~(on("primary_found") & on("secondary_found")) | F.col("geocoder_m").isNull(), 0.82).otherwise(distance)
    told = F.coalesce(F.col("stability_status") != "not-computed", F.lit(False)) & F.col("stability_score").isNotNull()
    stable = F.when(told, F.col("stability_score")).when(on("near_boundary"), 0.65).otherwise(0.9)
    times = lambda flag, factor: F.when(on(flag), factor).otherwise(1.0)
    base = F.when(on("accepted"), clamp(F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(0.9)), 0.0, 1.0)).otherwise(0.0)
    age = F.greatest(F.datediff(as_of, "newest"), F.lit(0))
    synced = lambda flag, without: F.when(on(flag), 1.0).otherwise(without)
    values = {
        "geolocation": geolocation,
        "provider_identity": clamp(base * stable * times("gap", 0.15) * times("overlap", 0.65), 0.0, 1.0),
        "spatial_robustness": clamp(times("gap", 0.2) * times("overlap", 0.55) * times("near_boundary", 0.72) * stable, 0.0, 1.0),
        "evidence_scope": F.when(n("households") > 0, 1.0).when(on("accepted"), 0.62).otherwise(0.2),
        "temporal_freshness": F.when(F.col("newest").isNull(), 0.2).otherwise(clamp(F.pow(F.lit(0.5), age / HALF_LIFE), 0.15, 1.0)),
        "contaminant_coverage": F.when(n("records") == 0, 0.1).otherwise(0.55 * clamp(n("analytes") / 20, 0.0, 1.0) + 0.45 * clamp(n("groups") / 6, 0.0, 1.0)),
        "originating_sample_independence": F.when(n("records") == 0, 0.1).otherwise(clamp(0.35 + 0.65 * F.least(F.lit(1.0), n("effective_n") / F.greatest(F.lit(3), F.least(n("records"), F.lit(20)))), 0.0, 1.0)),
        "source_conflict": clamp(1 / (1 + 0.35 * n("contradictions")), 0.25, 1.0),
        "federal_context_availability": (synced("federal_synced", 0.55) + synced("ccr_synced", 0.6) + synced("wqp_synced", 0.6)) / 3,
    }
    return {k: rounded(v) for k, v in values.items()}


def uncertainty_budget(places: DataFrame, as_of: Column, dominant: int = 4) -> DataFrame:
    """The places with `dimensions`, system and household confidence with labels, and the dominant uncertainties, the largest first.

    The system's score is a weighted geometric mean of the dimensions above zero; an unresolved system or a gap caps it. The household's is
    a mean of that, the scope and, with samples of its own, their freshness; without any it is capped, however sure the system is.
    """
    dims = dimensions(as_of)
    out = places.withColumn("dimensions", F.struct(*[v.alias(k) for k, v in dims.items()]))
    at: Callable[[str], Column] = lambda k: F.col(f"dimensions.{k}")
    own, known = F.coalesce(F.col("households") > 0, F.lit(False)), F.coalesce("accepted", F.lit(False))
    system = F.coalesce(weighted_geometric({k: (at(k), w) for k, w in WEIGHTS.items()}), F.lit(0.0))
    system = F.when(known, system).otherwise(F.least(system, F.lit(UNRESOLVED_CAP)))
    out = out.withColumn("_system", F.when(F.coalesce("gap", F.lit(False)), F.least(system, F.lit(GAP_CAP))).otherwise(system))
    household = F.coalesce(weighted_geometric({"s": (F.col("_system"), 1), "e": (at("evidence_scope"), 1), "t": (F.when(own, at("temporal_freshness")).otherwise(0.4), 1)}), F.lit(0.0))
    out = out.withColumn("_household", F.when(own, household).otherwise(F.least(household, F.lit(NO_SAMPLE_CAP))))
    every = F.array(*[F.struct(rounded(at(k) - 1).alias("_less"), F.lit(i).alias("_at"), F.lit(k).alias("dimension"), rounded(1 - at(k)).alias("uncertainty")) for i, k in enumerate(dims)])
    largest = F.transform(F.slice(F.array_sort(every), 1, dominant), lambda x: F.struct(x["dimension"].alias("dimension"), x["uncertainty"].alias("uncertainty")))
    return out.withColumns({
        "system_confidence": rounded(F.col("_system")), "system_label": confidence_label(F.col("_system")), "household_confidence": rounded(F.col("_household")), "household_label": confidence_label(F.col("_household")), "dominant": largest,
    }).drop("_system", "_household")


def verdict_envelope(places: DataFrame, base: str = "system_confidence") -> DataFrame:
    """The places with worst, best, width, the scenarios that apply with their penalties, and whether the verdict stands under all of them.

    places: base, set_size (plausible systems), single_origin, max_delta (of leaving an origin out), coverage_fraction, household_blocked, path_complete, undecided
    (claims). Six scenarios; that of the household alone counts for no system. Missing coverage, path or sizes count as none.
    """
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    scenarios = [
        ("alternate-provider-remains-plausible", n("set_size") > 1, F.lit(0.25), False), ("remove-most-influential-origin", on("single_origin"), F.least(F.lit(0.3), 0.08 + n("max_delta")), False),
        ("missing-contaminant-groups", n("coverage_fraction") < 0.75, F.lit(0.15), False), ("household-scope-unobserved", on("household_blocked"), F.lit(0.35), True),
        ("causal-system-path-incomplete", ~on("path_complete"), F.lit(0.2), False), ("negotiation-undecided-claims", n("undecided") > 0, F.least(F.lit(0.2), 0.04 * n("undecided")), False),
    ]
    listed = F.filter(F.array(*[F.when(when, F.struct(F.lit(name).alias("scenario"), penalty.alias("penalty"), F.lit(own).alias("household_only"))) for name, when, penalty, own in scenarios]), lambda s: s.isNotNull())
    lost = sum((F.when(when, penalty).otherwise(0.0) for _, when, penalty, own in scenarios if not own), F.lit(0.0))
    out = places.withColumns({"scenarios": listed, "_worst": F.greatest(F.lit(0.0), n(base) - lost), "_best": F.least(F.lit(1.0), n(base) + 0.05)})
    stands = (confidence_label(n(base)) == confidence_label(F.col("_worst"))) & (F.col("_best") - F.col("_worst") <= 0.2 + 1e-9)
    return out.withColumns({"worst": rounded(F.col("_worst")), "best": rounded(F.col("_best")), "width": rounded(F.col("_best") - F.col("_worst")), "stable_under_stress": stands}).drop("_worst", "_best")
