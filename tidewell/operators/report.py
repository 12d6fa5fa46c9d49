"""The report on each place: its contradictions, claims, their negotiation and what they come to, one row a place.

places: place_id and what other operators found for it: located, polygons (how many it lies in), accepted, pwsid, score (of the system's match),
equal_candidates, stability_status, stability_score, households (samples of its own), synced, active (violations), ccr_year (null:
no annual report), stations (near by), records, origins (of these), single_origin, unaccredited, geocoder_m (how far two geocoders are
apart), near_boundary, boundary_m, gap, overlap, evidence (array of id and type). A missing number counts as none, a missing flag as false.

Everything is one expression a place, so a report costs one pass over places and one grouping by place for the negotiation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scores import clamp
from tidewell.operators.evidence import negotiate

# Kinds of evidence that a claim cites, and the agents' confidences.
CITED = {"provider": ["address-resolution", "provider-boundary", "provider-resolution"], "federal": ["federal-compliance-record", "federal-system-record"], "report": ["annual-water-quality-report"], "stations": ["nearby-environmental-monitoring"]}
CONFIDENCE = {"provider": 0.9, "no-provider": 0.99, "federal": 0.97, "report": 0.94, "stations": 0.95, "no-origins": 0.7}
STABLE, VETOED, GEOCODERS_APART = 0.75, 0.5, 50.0


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _is(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _stability_told() -> Column:
    return F.coalesce(F.col("stability_status") != "not-computed", F.lit(False)) & F.col("stability_score").isNotNull()


def contradictions(places: DataFrame) -> DataFrame:
    """The places with `contradictions`: what speaks against an unqualified report, by nine rules in order."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda c: F.col(c).cast("string")
    rules = [
        (_n("single_origin") > 0, text(number("single_origin"), " record(s) rest on one laboratory sample; copies of it confirm nothing")),
        (_n("unaccredited") > 0, text(number("unaccredited"), " record(s) have no laboratory with an active accreditation")),
        (_n("geocoder_m") > GEOCODERS_APART, text("two geocoders are ", F.format_number("geocoder_m", 1), " m apart")),
        (_is("near_boundary"), text("the place is ", F.format_number("boundary_m", 1), " m from a service boundary")),
        (_is("gap"), F.lit("the place lies in a gap between service areas")),
        (_is("overlap"), F.lit("the place lies in overlapping service areas")),
        (_n("polygons") > 1, F.lit("several service areas hold the place")),
        (_is("equal_candidates"), F.lit("two systems match equally well")),
        (_stability_told() & (F.col("stability_score") < STABLE), text("moved points find other systems: ", F.col("stability_status"))),
    ]
    found = F.filter(F.array(*[F.when(rule, message) for rule, message in rules]), lambda m: m.isNotNull())
    return places.withColumn("contradictions", found)


def investigation_claims(places: DataFrame) -> DataFrame:
    """One row for each claim about a place, by eleven templates: place_id, claim_id, topic, proposition, stance, agent, confidence, hard_veto, evidence_ids, origins.

    places: with `contradictions`. A place's own measurements are never claimed from its system's or from stations near by.
    """
    none = F.array().cast("array<string>")
    cites = lambda kind: F.transform(F.filter(F.coalesce("evidence", F.array().cast("array<struct<id string, type string>>")), lambda e: e["type"].isin(*CITED[kind])), lambda e: e["id"])

    def claim(when: Column, claim_id: str, topic: str, proposition: Column | str, stance: Column | str, agent: str, confidence: Column | float, veto: Column | bool = False, origins: Column = none, evidence: Column = none) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(when, F.struct(
            F.lit(claim_id).alias("claim"), F.lit(topic).alias("topic"), as_column(proposition).alias("proposition"), as_column(stance).alias("stance"), F.lit(agent).alias("agent"),
            clamp(as_column(confidence).cast("double"), 0.0, 1.0).alias("confidence"), as_column(veto).alias("hard_veto"), F.array_distinct(evidence).alias("evidence_ids"), F.array_distinct(origins).alias("origins"),
        ))

    serves = F.concat(F.lit("system "), F.coalesce("pwsid", F.lit("unknown")), F.lit(" serves the place"))
    score, n = F.col("stability_score"), F.size("contradictions")
    own, always = _n("households") > 0, F.lit(True)
    templates = [
        claim(_is("accepted"), "provider-support", "provider-identity", serves, "support", "Provider Identity Agent", F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(CONFIDENCE["provider"])), origins=F.array(F.lit("official-service-area")), evidence=cites("provider")),
        claim(~_is("accepted"), "provider-oppose", "provider-identity", "one system serves the place", "oppose", "Provider Identity Agent", CONFIDENCE["no-provider"], always),
        claim(_stability_told(), "boundary-stability", "provider-identity", serves, F.when(score >= STABLE, "support").otherwise("oppose"), "Boundary Robustness Agent", F.when(score >= STABLE, score).otherwise(1 - score), score < VETOED, F.array(F.lit("coordinate-perturbation-test"))),
        claim(own, "household-data", "household-measurement", "a sample of the household's own water exists", "support", "Direct Household Sample Agent", 1.0, origins=F.array(F.lit("direct-household-sample"))),
        claim(~own, "scope-veto", "household-measurement", "the report tells what the household's tap holds", "oppose", "Evidence Scope Guardian", 1.0, always),
        claim(_is("synced"), "sdwis-compliance", "current-federal-compliance", F.when(_n("active") > 0, "federal violations are active").otherwise("no federal violation is active"), "support", "SDWIS Compliance Agent", CONFIDENCE["federal"], origins=F.array(F.lit("federal-cache")), evidence=cites("federal")),
        claim(F.col("ccr_year").isNotNull(), "ccr-context", "annual-system-report", "the system has an annual report", "support", "CCR Context Agent", CONFIDENCE["report"], origins=F.array(F.concat(F.lit("annual-report-"), F.col("ccr_year").cast("string"))), evidence=cites("report")),
        claim(_n("stations") > 0, "wqp-context", "environmental-context", "stations near by give context", "support", "WQP Context Agent", CONFIDENCE["stations"], origins=F.array(F.lit("nearby-stations")), evidence=cites("stations")),
        claim(_n("stations") > 0, "wqp-tap-veto", "household-measurement", "stations near by tell what the household's tap holds", "oppose", "WQP Context Agent", 1.0, always),
        claim(_n("records") > 0, "independence", "record-independence", "samples are told from their copies", "support", "Originating-Sample Independence Agent", F.when(_n("origins") > 0, 1.0).otherwise(CONFIDENCE["no-origins"]), origins=F.array(F.concat(F.lit("origin-count-"), _n("origins").cast("string")))),
        claim(n > 0, "contradiction", "unqualified-high-confidence", "the report stands without limits", "oppose", "Contradiction Agent", 0.55 + 0.05 * n, origins=F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.concat(F.lit("contradiction-"), i.cast("string")))),
    ]
    rows = places.select("place_id", F.inline(F.filter(F.array(*templates), lambda c: c.isNotNull())))
    return rows.select("place_id", F.concat(F.col("place_id").cast("string"), F.lit("/"), "claim").alias("claim_id"), "claim", "topic", "proposition", "stance", "agent", "confidence", "hard_veto", "evidence_ids", "origins")


def standing(places: DataFrame) -> DataFrame:
    """The places, with `contradictions`, with direct_status, location_status, result_level and confidence."""
    own, known = _n("households") > 0, _is("accepted")
    return places.withColumns({
        "direct_status": F.when(own, "exact-household-data-found").otherwise("no-exact-household-sample-found"),
        "location_status": F.when(~_is("located"), "address-not-resolved").when(_n("polygons") == 0, "no-service-polygon-match").when(known, "exact-address-to-system-match").otherwise("provider-not-resolved"),
        "result_level": F.when(own, "exact-household-sample").when(known, "exact-address/system-level-water-quality").otherwise("unresolved"),
        "confidence": F.when(own & known, "very-high").when(known & (F.size("contradictions") > 0), "moderate").when(known, "high").otherwise("insufficient"),
    })


def investigations(places: DataFrame, reliability: DataFrame) -> DataFrame:
    """One row a place: its standing, contradictions, and its claims' outcomes as an array with the share of accepted ones."""
    told = standing(contradictions(places))
    claims = investigation_claims(told).withColumn("topic", F.concat(F.col("place_id").cast("string"), F.lit("/"), "topic"))
    outcome = negotiate(claims, reliability)
    place = F.substring_index("topic", "/", 1)
    each = outcome.select(place.alias("_place"), F.struct(F.substring_index("topic", "/", -1).alias("topic"), "proposition", "verdict", F.round("support", 4).alias("support"), F.round("oppose", 4).alias("oppose"), F.round("confidence", 4).alias("confidence"), "vetoed", "dissent", "origins").alias("o"))
    count = lambda verdict: F.count_if(F.col("o.verdict") == verdict)
    council = each.groupBy("_place").agg(F.array_sort(F.collect_list("o")).alias("outcomes"), count("accepted").alias("accepted_claims"), count("rejected").alias("rejected_claims"), count("undecided").alias("undecided_claims"), F.count_if("o.vetoed").alias("vetoes"), F.round(count("accepted") / F.count("*"), 4).alias("consensus_fraction"))  # a place has ten outcomes at most
    return told.select("place_id", "direct_status", "location_status", "result_level", "confidence", "contradictions").join(council, F.col("place_id").cast("string") == F.col("_place")).drop("_place")
