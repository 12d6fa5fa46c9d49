"""Contradictions, claims and outcomes of a place by value; provider sets; weighted neighbours; percentile status."""

import datetime as dt
import json

import pytest

from tidewell.operators import compliance, evidence, report, stats

PLACE = """place_id int, located boolean, polygons int, accepted boolean, pwsid string, score double, equal_candidates boolean, stability_status string, stability_score double, households int, synced boolean, active int,
 ccr_year int, stations int, records int, origins int, single_origin int, unaccredited int, geocoder_m double, near_boundary boolean, boundary_m double, gap boolean, overlap boolean, evidence array<struct<id string, type string>>"""
FULL = dict(
    place_id=1, located=True, polygons=2, accepted=True, pwsid="7", score=0.97, equal_candidates=True, stability_status="fragile", stability_score=0.6, households=0, synced=True, active=2, ccr_year=2024, stations=3, records=4, origins=0, single_origin=2, unaccredited=1,
    geocoder_m=50.5, near_boundary=True, boundary_m=12.34, gap=True, overlap=True, evidence=[("e1", "provider-boundary"), ("e2", "federal-system-record"), ("e3", "nearby-environmental-monitoring"), ("e1", "provider-boundary")],
)
NOTHING = dict.fromkeys(FULL) | {"place_id": 2}
CLEAN = FULL | dict(place_id=3, polygons=1, equal_candidates=False, stability_status="stable", stability_score=0.75, households=1, origins=3, single_origin=0, unaccredited=0, geocoder_m=50.0, near_boundary=False, gap=False, overlap=None, stations=0, active=0, evidence=None)
UNSTABLE = CLEAN | dict(place_id=4, stability_score=0.4, households=0)


@pytest.fixture(scope="module")
def told(spark):
    return report.contradictions(spark.createDataFrame([tuple(p[c] for c in FULL) for p in (FULL, NOTHING, CLEAN, UNSTABLE)], PLACE))


@pytest.fixture(scope="module")
def claims(told):
    return {(r["place_id"], r["claim"]): r for r in report.investigation_claims(told).collect()}


def test_nine_rules(told):
    got = {r["place_id"]: r["contradictions"] for r in told.collect()}
    assert len(got[1]) == 9 and got[2] == [] == got[3] and len(got[4]) == 1
    assert got[1][0].startswith("2 record(s)") and got[1][2] == "two geocoders are 50.5 m apart" and "12.3 m" in got[1][3] and got[1][8].endswith("fragile")


def test_eleven_templates(claims):
    of = lambda place: {c for p, c in claims if p == place}
    assert of(1) == {"provider-support", "boundary-stability", "scope-veto", "sdwis-compliance", "ccr-context", "wqp-context", "wqp-tap-veto", "independence", "contradiction"}
    assert of(2) == {"provider-oppose", "scope-veto"} and of(3) == {"provider-support", "boundary-stability", "household-data", "sdwis-compliance", "ccr-context", "independence"}
    value = lambda place, c: (claims[place, c]["stance"], round(claims[place, c]["confidence"], 6), claims[place, c]["hard_veto"], claims[place, c]["origins"], claims[place, c]["evidence_ids"])
    assert value(1, "provider-support") == ("support", 0.97, False, ["official-service-area"], ["e1"])
    assert value(1, "boundary-stability") == ("oppose", 0.4, False, ["coordinate-perturbation-test"], [])
    assert value(3, "boundary-stability")[:3] == ("support", 0.75, False) and value(4, "boundary-stability")[:3] == ("oppose", 0.6, True)
    assert value(1, "contradiction") == ("oppose", 1.0, False, [f"contradiction-{i}" for i in range(9)], [])
    assert value(1, "independence") == ("support", 0.7, False, ["origin-count-0"], []) and value(3, "independence")[1] == 1.0
    assert value(2, "provider-oppose")[:3] == ("oppose", 0.99, True) and value(1, "wqp-tap-veto")[2] and value(1, "ccr-context")[3] == ["annual-report-2024"]
    assert "active" in claims[1, "sdwis-compliance"]["proposition"] and claims[1, "sdwis-compliance"]["proposition"] != claims[3, "sdwis-compliance"]["proposition"]


def test_household_claims_need_household_samples(spark, told):
    """Neither a system's data nor stations near by are ever accepted as the household's own."""
    got = {r["place_id"]: r for r in report.investigations(told, spark.createDataFrame([], "agent string, weight double")).collect()}
    assert set(got) == {1, 2, 3, 4}
    own = lambda p: [o["verdict"] for o in got[p]["outcomes"] if o["topic"] == "household-measurement"]
    assert own(1) == ["rejected", "rejected"] and own(2) == ["rejected"] == own(4) and own(3) == ["accepted"]
    assert [o["verdict"] for o in got[4]["outcomes"] if o["topic"] == "provider-identity"] == ["rejected"]  # a veto by unstable places
    assert (got[1]["confidence"], got[2]["confidence"], got[3]["confidence"]) == ("moderate", "insufficient", "very-high")
    assert (got[2]["location_status"], got[3]["location_status"], got[2]["result_level"]) == ("address-not-resolved", "exact-address-to-system-match", "unresolved")
    assert got[3]["accepted_claims"] == 5 and got[3]["consensus_fraction"] == 1.0 and got[2]["consensus_fraction"] == 0.0 and got[1]["vetoes"] == 2


def test_provider_sets(spark):
    rows = [("a", "x", 0.9, "z"), ("a", "y", 0.86, "z"), ("a", "z", 0.2, "z"), ("a", "w", 0.7, "z"), ("a", "x", 0.5, "z"), ("b", "x", 0.3, "q"), ("c", "x", 1.7, None), ("c", "y", 0.975, None), ("c", "v", 0.9, None)]
    df = spark.createDataFrame(rows, "k string, p string, s double, ok string")
    got = {r["k"]: r for r in evidence.provider_set(df, "k", "p", "s", accepted="ok").collect()}
    assert [m["candidate"] for m in got["a"]["members"]] == ["x", "y", "z"] and got["a"]["top_margin"] == pytest.approx(0.04) and not got["a"]["singleton"]
    assert got["b"]["set_size"] == 0 and got["b"]["members"] == [] and got["b"]["status"] == "uncalibrated-conservative"
    assert [m["candidate"] for m in got["c"]["members"]] == ["x", "y"]  # the surer the best, the narrower: 0.03
    got = {r["k"]: r for r in evidence.provider_set(df, "k", "p", "s", calibration=[0.05, 0.12, 0.3], alpha=0.5).collect()}
    assert [m["candidate"] for m in got["a"]["members"]] == ["x"] and got["a"]["singleton"] and got["a"]["status"] == "calibrated"


def test_neighbours_of_one_aquifer_and_depth_weigh_more(spark):
    rows = [("a", 1.0, 1.0, True, 0.0), ("a", 4.0, 1.0, False, None), ("a", 7.0, 1.0, None, -100.0)]
    df = spark.createDataFrame(rows, "k string, x double, miles double, same boolean, apart double")
    got = stats.inverse_distance(df, "k", "x", "miles", same="same", apart="apart").first()
    assert got["estimate"] == pytest.approx((2 * 1 + 1 * 4 + 0.5 * 7) / 3.5) and got["spread"] == pytest.approx(((2 * 1 + 16 + 0.5 * 49) / 3.5 - got["estimate"] ** 2) ** 0.5)


def test_few_samples_show_an_exceedance_without_a_claim(spark):
    rows = [("a", "LEAD", "TAP", 50.0, dt.date(2024, 1, 1))] * 3 + [("b", "LEAD", "TAP", None, dt.date(2024, 1, 1))]
    got = {r["pwsid"]: (r["status"], r["claim_allowed"]) for r in compliance.percentile_90(spark.createDataFrame(rows, "pwsid string, analyte string, sample_type string, value double, sample_date date")).collect()}
    assert got == {"a": ("action-level-exceedance", False), "b": ("insufficient-data", False)}


def test_walk_of_nested_documents(spark):
    from tidewell.operators import nested

    deep = "x"
    for _ in range(12):
        deep = {"k": [deep, 1]}
    rows = [
        (1, json.dumps({"url": "https://h/FeatureServer", "a": [{"URL": "https://h/mapserver/1"}, ["https://h/MapServer", {"url": 5}], None], "b": {"url": "https://h/other"}})),
        (2, json.dumps(deep)), (3, "{broken"), (4, None), (5, "[]"), (6, '"https://h/MapServer"'), (7, json.dumps({"url": ["https://h/MapServer"]})),
    ]
    df = spark.createDataFrame(rows, "i int, j string")
    got = sorted((r["i"], r["path"], r["url"]) for r in nested.service_urls(df, "i", "j").collect())
    assert got == [(1, "a.0.URL", "https://h/mapserver/1"), (1, "url", "https://h/FeatureServer"), (7, "url.0", "https://h/MapServer")]
    assert [(r["path"], r["key"]) for r in nested.walk(df.filter("i = 2"), "i", "j").collect()] == [(".".join(["k.0"] * 12), "k")]
    assert nested.walk(df.filter("i > 9"), "i", "j").count() == 0


def test_links_against_pairwise_correlation(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(stats, "SERIES_BLOCK", 5)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 40))
    series = {f"s{i:02d}": {int(d): float(base[i % 4][d] + 0.4 * rng.normal() + 1e4) for d in rng.choice(40, rng.integers(4, 38), replace=False)} for i in range(23)}
    series["flat"] = dict.fromkeys(range(40), 3.0)
    start = dt.date(2024, 1, 1)
    rows = [(p, start + dt.timedelta(days=d), v) for p, s in series.items() for d, v in s.items()] + [("s00", None, 1.0), (None, start, 1.0)]
    want = {}
    for a in series:
        for b in series:
            days = sorted(set(series[a]) & set(series[b]))
            x, y = ([series[p][d] for d in days] for p in (a, b))
            if a < b and len(days) >= 6 and np.std(x) > 0 and np.std(y) > 0 and (r := float(np.corrcoef(x, y)[0, 1])) >= 0.75:
                want[a, b] = (len(days), pytest.approx(r))
    got = {(r["a"], r["b"]): (r["days"], r["correlation"]) for r in stats.inferred_links(spark.createDataFrame(rows, "p string, d date, v double"), "p", "d", "v").collect()}
    assert got == want and len(want) > 10
