"""The uncertainty budget and the verdict envelope by value."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.operators import budget

DDL = """place_id int, primary_found boolean, secondary_found boolean, geocoder_m double, accepted boolean, score double, stability_status string, stability_score double, near_boundary boolean, gap boolean, overlap boolean,
 households int, records int, analytes int, groups int, newest date, effective_n double, contradictions int, federal_synced boolean, ccr_synced boolean, wqp_synced boolean"""
AS_OF = dt.date(2024, 1, 1)
SURE = dict(place_id=1, primary_found=True, secondary_found=True, geocoder_m=15.0, accepted=True, score=1.0, stability_status="stable", stability_score=1.0, near_boundary=False, gap=False, overlap=False, households=1, records=40, analytes=30, groups=7, newest=AS_OF, effective_n=25.0, contradictions=0, federal_synced=True, ccr_synced=True, wqp_synced=True)
PLACES = [
    SURE, dict.fromkeys(SURE) | {"place_id": 2}, SURE | dict(place_id=3, accepted=False), SURE | dict(place_id=4, gap=True), SURE | dict(place_id=5, households=0),
    SURE | dict(place_id=6, geocoder_m=60.0, overlap=True, near_boundary=True, stability_status="not-computed", newest=dt.date(2023, 1, 1), analytes=10, groups=3, effective_n=2.0, records=8, contradictions=2, ccr_synced=False),
    SURE | dict(place_id=7, newest=dt.date(2030, 1, 1), geocoder_m=None, stability_score=0.5, score=0.0),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([tuple(p[c] for c in SURE) for p in PLACES], DDL)
    return {r["place_id"]: r for r in budget.uncertainty_budget(df, F.lit(AS_OF)).collect()}


def test_dimensions(got):
    assert all(v == 1.0 for v in got[1]["dimensions"].asDict().values()) and got[1]["system_label"] == "very-high" and got[1]["household_confidence"] == 1.0
    d = got[6]["dimensions"]
    assert (d["geolocation"], d["spatial_robustness"], d["evidence_scope"]) == (0.58, round(0.55 * 0.72 * 0.65, 4), 1.0) and d["provider_identity"] == pytest.approx(0.65 * 0.65, abs=1e-4)
    assert d["temporal_freshness"] == 0.5 and d["contaminant_coverage"] == 0.5 and d["originating_sample_independence"] == pytest.approx(0.35 + 0.65 * 2 / 8, abs=1e-4)
    assert d["source_conflict"] == pytest.approx(1 / 1.7, abs=1e-4) and d["federal_context_availability"] == pytest.approx(2.6 / 3, abs=1e-4)
    d = got[7]["dimensions"]
    assert (d["geolocation"], d["provider_identity"], d["temporal_freshness"]) == (0.82, 0.45, 1.0)  # no distance, no score, a date ahead
    nothing = got[2]["dimensions"]
    assert (nothing["geolocation"], nothing["provider_identity"], nothing["temporal_freshness"], nothing["contaminant_coverage"]) == (0.0, 0.0, 0.2, 0.1)


def test_caps_hold_however_sure_the_rest(got):
    assert got[3]["system_confidence"] == 0.25 and got[4]["system_confidence"] <= 0.3 and got[5]["household_confidence"] == 0.49
    assert got[5]["system_label"] == "very-high" and got[5]["household_label"] == "low" and got[2]["system_label"] == "insufficient"


def test_dominant_uncertainties(got):
    assert [x["dimension"] for x in got[2]["dominant"]] == ["geolocation", "provider_identity", "contaminant_coverage", "originating_sample_independence"]
    assert [x["uncertainty"] for x in got[2]["dominant"]] == [1.0, 1.0, 0.9, 0.9] and len(got[1]["dominant"]) == 4


def test_envelope(spark):
    ddl = "place_id int, system_confidence double, set_size int, single_origin boolean, max_delta double, coverage_fraction double, household_blocked boolean, path_complete boolean, undecided int"
    rows = [(1, 0.95, 1, False, 0.0, 0.75, True, True, 0), (2, 0.95, 2, True, 0.5, 0.5, True, False, 9), (3, 0.8, 1, False, None, 1.0, False, True, 1), (4, None, None, None, None, None, None, None, None)]
    got = {r["place_id"]: r for r in budget.verdict_envelope(spark.createDataFrame(rows, ddl)).collect()}
    assert (got[1]["worst"], got[1]["best"], got[1]["stable_under_stress"]) == (0.95, 1.0, True) and [s["scenario"] for s in got[1]["scenarios"]] == ["household-scope-unobserved"]
    assert (got[2]["worst"], got[2]["stable_under_stress"], len(got[2]["scenarios"])) == (0.0, False, 6) and [s["penalty"] for s in got[2]["scenarios"]] == [0.25, 0.3, 0.15, 0.35, 0.2, 0.2]
    assert (got[3]["worst"], got[3]["width"], got[3]["stable_under_stress"]) == (0.76, 0.09, True)
    assert (got[4]["worst"], got[4]["best"]) == (0.0, 0.05) and len(got[4]["scenarios"]) == 2


def test_applicability(spark):
    from tidewell.operators import applicability

    ddl = "rid string, sample_type string, sample_date date, lab_status string, lab_id string, record_fingerprint string, pwsid string, place_pwsid string, factual_status string, address_hash string, place_address_hash string, superseded_by string, admissible boolean, path_certainty double, entry_point string"
    rows = [
        ("home", "Exact household", AS_OF, "verified", "L", "f", "1", "1", None, "h", "h", None, True, 1.0, None), ("tap", "TAP", dt.date(2023, 1, 1), "Unaccredited", "L", None, "1", "1", None, None, "h", "r2", None, None, "E"),
        ("other", "well", None, None, None, None, "2", "1", None, None, None, None, False, None, None), ("bad", "", AS_OF, None, "L", "f", "1", "1", "quarantined", None, None, None, True, 0.1, None),
    ]
    judged = applicability.applicability(spark.createDataFrame(rows, ddl), ["public-water-system-record", "exact-household-sample"], F.lit(AS_OF))
    got = {(r["rid"], r["claim_scope"]): r for r in judged.collect()}
    home, tap = got["home", "exact-household-sample"], got["tap", "public-water-system-record"]
    assert home["eligible"] and home["vetoes"] == [] and home["dimensions"].asDict() == pytest.approx({"spatial": 1.0, "temporal": 1.0, "hydraulic": 1.0, "provenance": 0.65, "laboratory": 1.0, "regulatory": 0.9, "scope_compatibility": 1.0})
    assert tap["evidence_scope"] == "tap-sampling-record" and tap["dimensions"].asDict() == pytest.approx({"spatial": 0.88, "temporal": 0.5, "hydraulic": 0.68, "provenance": 0.45, "laboratory": 0.35, "regulatory": 0.35, "scope_compatibility": 1.0})
    assert not got["tap", "exact-household-sample"]["eligible"] and got["tap", "exact-household-sample"]["score"] <= 0.15  # never a finer claim
    other = got["other", "public-water-system-record"]
    assert other["score"] <= 0.2 and other["evidence_scope"] == "source-well-record" and other["dimensions"]["temporal"] == 0.35 and other["dimensions"]["hydraulic"] == 0.05 and len(other["vetoes"]) == 1
    bad = got["bad", "public-water-system-record"]
    assert bad["vetoes"] == ["the record is quarantined"] and not bad["eligible"] and bad["dimensions"]["hydraulic"] == 0.5
    up = {r["claim_scope"]: r for r in applicability.by_claim_scope(judged, "rid", top=2).collect()}
    assert (up["public-water-system-record"]["eligible"], up["public-water-system-record"]["total"], up["exact-household-sample"]["vetoed"]) == (2, 4, 3) and up["exact-household-sample"]["top"][0] == "home"
