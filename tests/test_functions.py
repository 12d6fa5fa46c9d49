"""Small cases with known answers, nulls among them."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import measure as M
from tidewell.functions import scores as S
from tidewell.functions import text as X
from tidewell.operators import choice, compliance, evidence, graph, registry, spatial, stats, versions
from tidewell.sources import readers


def value(spark, column, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {t}" for n, t in TYPES(columns).items())) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def TYPES(columns):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", dt.date: "date", type(None): "string", list: "array<array<double>>"}
    return {n: kinds[type(v)] for n, v in columns.items()}


@pytest.mark.parametrize("raw, want", [("US-FL0359001", "0359001"), ("FL3590001", "3590001"), (" 3590001 ", "3590001"), ("12", "12"), ("", None), (None, None)])
def test_normalize_pwsid(spark, raw, want):
    assert value(spark, M.normalize_pwsid(F.col("a")), a=raw) == want


@pytest.mark.parametrize("result, unit, canonical, limit, censored", [("0.01", "mg/L", 10.0, None, False), ("<0.005", "mg/L", None, 5.0, True), ("ND", "ug/L", None, None, True), ("3", "µg/L", 3.0, None, False), ("2", "furlong", None, None, False), (None, "ug/L", None, None, False), ("1.5e1", "PPT", 0.015, None, False)])
def test_measurement(spark, result, unit, canonical, limit, censored):
    m = value(spark, M.measurement(F.col("r"), F.col("u")), r=result, u=unit)
    assert m["censored"] == censored
    assert m["canonical_value"] == (pytest.approx(canonical) if canonical is not None else None)
    assert m["detection_limit_ug_l"] == (pytest.approx(limit) if limit is not None else None)


@pytest.mark.parametrize("raw, want", [("2024-03-05", dt.date(2024, 3, 5)), ("3/5/2024", dt.date(2024, 3, 5)), ("05-MAR-2024", dt.date(2024, 3, 5)), ("soon", None), (None, None)])
def test_dates(spark, raw, want):
    assert value(spark, M.any_date(F.col("a")), a=raw) == want


def test_violations(spark):
    at = F.lit("2020-01-01").cast("date")
    assert value(spark, M.violation_active(F.col("s"), F.lit("2019-01-01").cast("date"), at), s="Unaddressed") is True
    assert value(spark, M.violation_active(F.col("s"), F.lit(None).cast("date"), at), s="Resolved and open") is False
    assert value(spark, M.violation_active(F.col("s"), F.lit("2021-01-01").cast("date"), at), s="") is True
    assert value(spark, M.violation_kind(F.col("s")), s="Monitoring of MCL") == "health"


def test_scores(spark):
    assert value(spark, S.geometric_mean(F.lit(0.5), F.lit(0.0), F.lit(2.0))) == pytest.approx(1.0)
    assert value(spark, S.geometric_mean(F.lit(0.0))) is None
    assert value(spark, S.freshness(F.lit(365), 365.0)) == pytest.approx(0.5)
    assert value(spark, S.confidence_label(F.lit(0.9))) == "very-high"
    assert value(spark, choice.certificate([F.lit(True)] * 6)) == "robust"


def test_names_and_addresses(spark):
    assert value(spark, X.canonical_tokens(F.col("a")), a="City of Sán José Water Dept. (north) ASSN 1234567") == ["SAN", "JOSE", "ASSOCIATION"]
    assert value(spark, X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert value(spark, X.street(F.col("a")), a="12 North Oak Street, Sanford") == "N OAK ST"
    n, road = F.lit(150), F.lit("OAK ST")
    assert value(spark, X.in_address_range(F.col("t"), n, road), t="Notice for 100-198 Oak St today") is True
    assert value(spark, X.in_address_range(F.col("t"), n, road), t="Notice for 10-98 Oak St today") is False
    assert value(spark, X.notice_status(F.col("t")), t="The notice issued Monday is lifted") == "lifted"
    assert value(spark, X.strip_html(F.col("t")), t="<p>a &amp; b<script>x<y</script><!-- c --> d</p>") == "a & b d"


def test_versions_and_as_of(spark):
    rows = spark.createDataFrame([("k", 1, "f1"), ("k", 2, "f2")], "key string, rev int, fp string")
    got = {r["fp"]: r for r in versions.number_versions(rows, ["key"], [F.col("rev")], "fp").collect()}
    assert not got["f1"]["is_current"] and got["f1"]["superseded_by"] == "f2" and got["f2"]["is_current"]
    v = spark.createDataFrame([("a", dt.date(2018, 1, 1), dt.date(2020, 12, 31), "old"), ("a", dt.date(2021, 1, 1), None, "new")], "k string, valid_from date, valid_to date, name string")
    at = spark.createDataFrame([("a", dt.date(2020, 5, 1)), ("a", dt.date(2022, 1, 1)), ("a", dt.date(2000, 1, 1)), ("b", dt.date(2020, 1, 1))], "k string, t date")
    assert [r["name"] for r in versions.as_of(at, v, ["k"], "t").orderBy("t", "k").collect()] == [None, None, "old", "new"]


def test_compliance(spark):
    rows = spark.createDataFrame([("p", "LEAD", "TAP", float(x)) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 20]], "pwsid string, analyte string, sample_type string, value double")
    assert compliance.percentile_90(rows).first()["p90"] == 9.0
    hi = spark.createDataFrame([("p", "A", 5.0, 1), ("p", "B", 5.0, 1), ("p", "A", 9.0, 0)], "pwsid string, analyte string, value double, t int")
    got = compliance.hazard_index(hi, ["pwsid"], "analyte", "value", [F.col("t").desc()], {"A": 10.0, "B": 10.0}).first()
    assert got["hazard_index"] == pytest.approx(1.0) and got["exceeds"]


CLAIMS = "claim_id long, topic string, proposition string, stance string, agent string, confidence double, origins array<string>, hard_veto boolean"


def test_votes(spark):
    rows = [
        (1, "t", "p", "support", "a", 0.9, ["o"], False), (2, "t", "p", "support", "b", 0.8, ["o"], False), (3, "t", "q", "support", "a", 0.9, ["x"], False), (4, "t", "q", "oppose", "b", 0.1, ["y"], True),
        (5, "t", "one", "support", "a", 0.1, ["o"], False), (6, "t", "two", "support", "a", 0.9, ["o"], False), (7, "t", "two", "oppose", "a", 0.7, ["y"], False), (8, "t", "none", "support", "new", 1.0, None, False), (9, "t", "known", "support", "WQP Context Agent", 1.0, [], False),
    ]
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "agent string, weight double")
    got = {r["proposition"]: r for r in evidence.negotiate(spark.createDataFrame(rows, CLAIMS), weights).collect()}
    assert got["p"]["origins"] == 1 and got["p"]["support"] == pytest.approx(0.9) and got["p"]["verdict"] == "accepted"
    assert got["q"]["verdict"] == "rejected" and got["q"]["vetoed"] and got["q"]["dissent"]
    assert got["one"]["verdict"] == "undecided"  # scores, not shares
    assert got["two"]["verdict"] == "accepted" and got["two"]["dissent"]
    assert got["none"]["support"] == pytest.approx(0.8) and got["none"]["origins"] == 0
    assert got["known"]["support"] == pytest.approx(0.99)


def test_leave_one_out(spark):
    rows = [(1, "t", "p", "support", "a", 0.9, ["o"], False), (2, "t", "p", "oppose", "a", 0.9, ["x", "y"], False), (3, "t", "q", "support", "a", 0.9, None, False)]
    got = {r["left_out"]: r for r in evidence.leave_one_origin_out(spark.createDataFrame(rows, CLAIMS), spark.createDataFrame([("a", 1.0)], "agent string, weight double")).collect()}
    assert set(got) == {"o", "x", "y", "claim 3"}
    assert got["claim 3"]["flips"] == 1 and got["claim 3"]["max_change"] == pytest.approx(1.0)
    assert got["x"]["flips"] == 1 and got["x"]["total_change"] == pytest.approx(0.5)


def test_cut_sets(spark):
    claim = lambda i, p, stance, *o: (i, "t", p, stance, "a", 1.0, list(o), False)
    cuts = lambda rows: sorted((r["status"], r["cut_size"], tuple(r["cut"] or ())) for r in evidence.cut_sets(spark.createDataFrame(rows, CLAIMS)).collect())
    assert cuts([claim(1, "p", "support", "a"), claim(2, "p", "oppose", "b")]) == [("computed", 1, ("a",)), ("computed", 1, ("b",))]
    two = [claim(1, "p", "support", "a"), claim(2, "p", "support", "b"), claim(3, "p", "oppose", "c"), claim(4, "p", "oppose", "d"), claim(5, "q", "support", "a", "z"), claim(6, "q", "oppose", "c", "z")]
    assert cuts(two) == [("computed", 2, ("a", "b")), ("computed", 2, ("c", "d"))]
    many = [claim(i, "p", stance, f"{stance}{i}") for i in range(4) for stance in ("support", "oppose")]
    assert cuts(many) == [("cutset-exceeds-search-limit", None, ())]
    assert cuts([claim(1, "p", "support", "a")]) == []


def test_corroboration(spark):
    ddl = "id int, k string, result string, origin string, source string"
    rows = [(1, "a", "100", "o1", "s1"), (2, "a", "102", "o2", "s1"), (3, "a", "104", "o3", "s1"), (4, "a", "110", "o4", "s1"), (5, "a", "100", "o1", "s1"), (6, "a", "100", "o1", "s2"), (7, "a", "ND", "o1", "s1"), (8, "a", "nd", "o2", "s1"), (9, "a", "BDL", "o3", "s1"), (10, "b", "100", "o9", "s1"), (11, "c", "0", "o1", "s1"), (12, "c", "0", "o2", "s1"), (13, "c", "-5", "o3", "s1"), (14, "c", "5", "o4", "s1"), (15, "d", None, "o1", "s1")]
    got = {r["id"]: (r["independent_origins"], r["publisher_replicas"]) for r in evidence.corroborate(spark.createDataFrame(rows, ddl), ["k"], "id", "result", "origin", "source").collect()}
    assert got == {1: (2, 1), 2: (3, 0), 3: (2, 0), 4: (1, 0), 5: (2, 1), 6: (2, 2), 7: (2, 0), 8: (2, 0), 9: (1, 0), 10: (1, 0), 11: (2, 0), 12: (2, 0), 13: (1, 0), 14: (1, 0), 15: (1, 0)}


def test_peers(spark):
    ddl = "s string, a string, g string, v double, c boolean, d date"
    day = dt.date(2024, 1, 1)
    rows = [(f"p{i}", "X", "INOR", float(i), False, day) for i in range(6)] + [("far", "X", "INOR", 1.0, False, dt.date(2020, 1, 1)), ("cens", "X", "INOR", None, True, day), ("other", "X", "WQP", 3.0, False, day)]
    got = {r["s"]: r for r in evidence.peer_percentile(spark.createDataFrame(rows, ddl), "s", "a", "g", "v", "c", "d").collect()}
    assert got["p5"]["percentile"] == 1.0 and got["p5"]["band"] == "upper-decile" and got["p5"]["peer_count"] == 5 and got["p5"]["peer_median"] == 2.0
    assert got["far"]["status"] == "insufficient-peer-coverage" and got["cens"]["status"] == "current-result-censored" and "other" not in got


def test_confirmation(spark):
    ddl = "pwsid string, analyte string, sample_date date, value double, id int"
    d = lambda n: dt.date(2024, 1, n)
    rows = [("a", "NITRATE", d(1), 20000.0, 1), ("a", "NITRATE", d(20), 5.0, 2), ("b", "NITRATE", d(1), 20000.0, 1), ("b", "NITRATE", d(20), 20000.0, 2), ("c", "NITRATE", d(20), 20000.0, 1)]
    got = compliance.confirmed_exceedance(spark.createDataFrame(rows, ddl), [F.col("sample_date").desc(), F.col("id")]).collect()
    assert {r["pwsid"]: r["status"] for r in got} == {"a": "below-mcl", "b": "confirmed-exceedance", "c": "confirmation-required"}


def test_fallback_without_a_default(spark):
    rows, reg = spark.createDataFrame([(1, "x"), (2, None)], "id int, src string"), spark.createDataFrame([("x", "X"), ("x", "Y")], "src string, name string")
    assert sorted((r["id"], r["name"]) for r in registry.with_fallback(rows, reg, "src", "none").collect()) == [(1, "X"), (2, None)]
    assert sorted((r["id"], r["name"]) for r in registry.with_fallback(rows, reg, "src", "x").collect()) == [(1, "X"), (2, "X")]


@pytest.mark.parametrize("lat, lon", [(60.0, 10.0), (28.5, -81.5), (-70.0, 179.99), (0.0, -179.99), (89.95, 0.0), (45.0, 0.0)])
def test_nearest_at_any_latitude(spark, lat, lon):
    import random

    rng = random.Random(3)
    wrap = lambda x: (x + 180) % 360 - 180
    spread = 0.15 / max(0.02, math.cos(math.radians(lat)))
    centres = [(i, wrap(lon + rng.uniform(-spread, spread)), max(-90.0, min(90.0, lat + rng.uniform(-0.1, 0.1)))) for i in range(12)]
    sites = [(i, wrap(lon + rng.uniform(-spread, spread)), max(-90.0, min(90.0, lat + rng.uniform(-0.1, 0.1)))) for i in range(120)]

    def miles(a, b):
        (x, y), (u, w) = [(math.radians(p[1]), math.radians(p[2])) for p in (a, b)]
        h = math.sin((w - y) / 2) ** 2 + math.cos(y) * math.cos(w) * math.sin((u - x) / 2) ** 2
        return 2 * spatial.MILES * math.asin(min(1, math.sqrt(h)))

    got = spatial.nearest(spark.createDataFrame(centres, "c int, lon double, lat double"), spark.createDataFrame(sites, "s int, lon double, lat double"), 5.0, 1000, "c", "s").collect()
    assert {(r["c"], r["s"]) for r in got} == {(c[0], s[0]) for c in centres for s in sites if miles(c, s) <= 5.0} and len(got) == len({(r["c"], r["s"]) for r in got})


def test_space(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    assert value(spark, spatial.in_ring(F.col("r"), F.lit(0.5), F.lit(0.5)), r=square) is True
    assert value(spark, spatial.in_ring(F.col("r"), F.lit(1.5), F.lit(0.5)), r=square) is False
    assert value(spark, spatial.to_ring(F.col("r"), F.lit(0.5), F.lit(0.25)), r=square) == pytest.approx(0.25 * 110540.0)
    assert value(spark, spatial.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(69.09, abs=0.02)


def test_graph_and_series(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("x", "y", 1.0), ("c", "a", 0.5)], "src string, dst string, certainty double")
    got = {r["node"]: r for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"]["certainty"] == pytest.approx(0.72) and got["c"]["hops"] == 2
    series = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0] * 4 + [10.0] * 4)], "k string, t int, v double")
    assert [r["position"] for r in stats.change_points(series, "k", "t", "v").collect()] == [4]
    q = stats.benjamini_hochberg(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "id int, p double"), "id", "p")
    assert {r["id"]: round(r["q"], 6) for r in q.collect()} == {1: 0.03, 2: 0.04, 3: 0.04}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("PWS ID;PopServed\n1;2\n3;4\n")
    got = readers.read_delimited(spark, str(tmp_path / "a.txt"))
    assert got.columns == ["pws_id", "pop_served"] and got.count() == 2
    assert value(spark, readers.coalesced(got, "nothing")) is None
    rows, there = readers.read_json(spark, str(tmp_path / "none.json"), got.schema)
    assert rows.count() == 0 and not there
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"NAME":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}}]}')
    shapes = readers.read_geojson(spark, str(tmp_path / "g.json")).orderBy("feature_id").collect()
    assert shapes[0]["properties"]["NAME"] == "x" and shapes[0]["polygons"] == shapes[1]["polygons"]
    assert readers.table_kind("SDWA_VIOLATIONS.csv", []) == "violations"
    parts = spark.createDataFrame([(True,), (False,)], "ok boolean")
    assert readers.manifest_status(parts).first()["status"] == "partial"


def test_paths_are_the_first_found_and_dated(spark):
    day = lambda y: dt.date(y, 1, 1)
    ddl = "src string, dst string, certainty double, valid_from date, valid_to date"
    edges = [("a", "b", 0.2, None, None), ("a", "c", 0.9, day(2000), None), ("b", "d", 1.0, None, day(2021)), ("c", "d", 1.0, None, None), ("d", "e", None, day(2020), day(2021))]
    start = spark.createDataFrame([("a",)], "node string")
    at = lambda y: {r["node"]: r for r in graph.reachable(spark.createDataFrame(edges, ddl), start, F.lit(day(y))).collect()}
    got = at(2020)
    assert got["d"]["certainty"] == pytest.approx(0.2) and not got["d"]["admissible"] and got["e"]["hops"] == 3  # the first path, not the most certain
    assert at(2021)["d"]["certainty"] == pytest.approx(0.9) and "e" not in at(2021)
    chain = spark.createDataFrame([(i, i + 1, 0.99) for i in range(12)], "src int, dst int, certainty double")
    far = {r["node"]: r["hops"] for r in graph.reachable(chain, spark.createDataFrame([(0,)], "node int")).collect()}
    assert far == {i: i for i in range(13)}


def test_freshness_edges(spark):
    fresh = lambda age, life: value(spark, S.freshness(F.lit(age).cast("double"), F.lit(life).cast("double")))
    assert fresh(-1.0, 365.0) == 0 and fresh(None, 365.0) == 0 and fresh(100.0, math.inf) == 1 and fresh(1.0, 0.0) is None and fresh(1.0, None) is None


def test_manifest_hash_is_of_the_set(spark):
    rows = [("g", f"{i:064x}") for i in range(20)] + [("h", "ab" * 32)]
    digest = lambda x: {r["g"]: r["digest"] for r in registry.manifest_hash(spark.createDataFrame(x, "g string, fp string"), "g", "fp").collect()}
    assert digest(rows) == digest(list(reversed(rows))) and digest(rows[:-2] + rows[-1:])["g"] != digest(rows)["g"]


def test_stability(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p int, lon double, lat double")
    around = spatial.perturbed(points)
    assert around.count() == 25
    to = around.withColumn("m", spatial.haversine(F.lit(0.0), F.lit(0.0), F.col("lon"), F.col("lat"), spatial.METRES)).filter("radius = 30").agg(F.min("m"), F.max("m")).first()
    assert to[0] == pytest.approx(30, abs=0.01) and to[1] == pytest.approx(30, abs=0.01)
    status = lambda c: spatial.stability(around.withColumn("answer", c), "p").first()
    assert status(F.lit(7))["status"] == "stable"
    half = status(F.when(F.col("lon") >= -1e-12, 7))
    assert half["status"] == "fragile" and half["stable_fraction"] == pytest.approx(15 / 24) and half["score"] == pytest.approx(15 / 24 * (1 - 0.5 * 9 / 24))
    assert status(F.lit(None).cast("int"))["status"] == "unstable"


def test_ridge_residuals(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(size=30) * 0.1
    rows = spark.createDataFrame([("k", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(30)], "k string, t int, y double, a double, b double")
    got = [r["residual"] for r in stats.ridge_residuals(rows, "k", "t", "y", ["a", "b"]).orderBy("position").collect()]
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert got == pytest.approx((y - y.mean() - z @ beta).tolist(), abs=1e-5)


def test_order_statistics_fit(spark):
    rows = spark.createDataFrame([("k", math.exp(1 + 0.5 * z)) for z in (-1.2, -0.5, 0.0, 0.5, 1.2)], "k string, v double")
    got = stats.order_statistics_fit(rows, ["k"], "v").first()
    assert got["detects"] == 5 and got["intercept"] == pytest.approx(1.0, abs=1e-6) and got["slope"] == pytest.approx(0.5, rel=0.1)


def test_cut_sets_over_all(spark):
    """Against every set of up to three origins, over all topics at once."""
    import itertools
    import random

    def brute(rows):
        groups = {}
        for _, topic, p, stance, _, _, origins, _ in rows:
            groups.setdefault((topic, p), []).append((stance == "oppose", set(origins)))
        groups = [g for g in groups.values() if len({a for a, _ in g}) == 2]
        every = sorted({o for g in groups for _, os in g for o in os})
        for k in range(1, 4) if groups else ():
            cuts = [c for c in itertools.combinations(every, k) if all(len({a for a, os in g if not os & set(c)}) < 2 for g in groups)]
            if cuts:
                return [("computed", len(groups), k, c) for c in cuts[:20]]
        return [("cutset-exceeds-search-limit", len(groups), None, ())] if groups else []

    rng, seen = random.Random(4), set()
    for size in (4, 8, 8, 14, 14, 14):
        rows = [(i, rng.choice("tu"), rng.choice("pq"), rng.choice(["oppose", "support"]), "a", 1.0, rng.sample("abcdefg", rng.choice([1, 1, 2])), False) for i in range(size)]
        got = [(r["status"], r["groups"], r["cut_size"], tuple(r["cut"] or ())) for r in evidence.cut_sets_over_all(spark.createDataFrame(rows, CLAIMS)).collect()]
        assert got == brute(rows)
        seen.add(got[0][2] if got else 0)
    assert len(seen) > 2
    assert evidence.cut_sets_over_all(spark.createDataFrame([], CLAIMS)).count() == 0


def test_ranks():
    from tidewell.operators.ranks import Ranks, rises

    rng = np.random.default_rng(1)
    for n, high in ((1, 1), (7, 3), (200, 20), (300, 10**6)):
        values = rng.integers(0, high, n).astype(float)
        ranks = Ranks(values)
        lo = rng.integers(0, n + 1, 60)
        hi = np.maximum(lo, rng.integers(0, n + 1, 60))
        x = rng.integers(-1, high + 1, 60).astype(float)
        assert ranks.below(lo, hi, x).tolist() == [int((values[a:b] < y).sum()) for a, b, y in zip(lo, hi, x)]
        assert ranks.below(lo, hi, x, equal=True).tolist() == [int((values[a:b] <= y).sum()) for a, b, y in zip(lo, hi, x)]
        full = hi > lo
        two = (np.full(full.sum(), 0), np.full(full.sum(), min(3, n)))
        parts = [np.sort(np.concatenate([values[a:b], values[: min(3, n)]])) for a, b in zip(lo[full], hi[full])]
        k = np.array([rng.integers(0, len(p)) for p in parts])
        assert ranks.kth([(lo[full], hi[full]), two], k).tolist() == [p[i] for p, i in zip(parts, k)]
        assert rises(values) == sum(int(np.sign(values[j] - values[i])) for i in range(n) for j in range(i + 1, n))


def test_peers_against_brute_force(spark):
    import random

    rng = random.Random(2)
    day = lambda: rng.choice([None, None, dt.date(2010, 1, 1)] + [dt.date(2010, 1, 1) + dt.timedelta(days=rng.randrange(3000)) for _ in range(9)])
    rows = [(f"p{i}", rng.choice("XY"), "INOR", None if (c := rng.random() < 0.1) else float(rng.randrange(12)), c, day()) for i in range(240)]
    got = {(r["s"], r["a"]): r for r in evidence.peer_percentile(spark.createDataFrame(rows, "s string, a string, g string, v double, c boolean, d date"), "s", "a", "g", "v", "c", "d").collect()}
    assert len(got) == len(rows)
    for s, a, _, v, c, d in rows:
        peers = sorted(w for t, b, _, w, censored, e in rows if b == a and t != s and not censored and (d is None or e is None or abs((d - e).days) <= 366))
        r = got[s, a]
        if c:
            assert r["status"] == "current-result-censored"
            continue
        assert r["peer_count"] == len(peers)
        if len(peers) < 5:
            assert r["status"] == "insufficient-peer-coverage" and r["percentile"] is None
            continue
        assert r["percentile"] == pytest.approx((sum(p < v for p in peers) + 0.5 * sum(p == v for p in peers)) / len(peers))
        assert (r["peer_median"], r["peer_min"], r["peer_max"]) == (float(np.median(peers)), peers[0], peers[-1])


def test_long_series(spark):
    """Variances beyond an integer, ties, and a hundred thousand values."""
    rows = spark.range(1023).selectExpr("'a' AS k", "id", "double(id) AS v").unionAll(spark.range(1024).selectExpr("'b'", "id", "double(-id)")).unionAll(spark.range(100_000).selectExpr("'c'", "id", "double(id % 1000)")).unionAll(spark.range(50).selectExpr("'d'", "id", "1.0D"))
    got = {r["k"]: r for r in stats.mann_kendall(rows, ["k"], F.col("id"), "v").collect()}
    n = 1024
    assert got["a"]["s_stat"] == 1023 * 1022 / 2 and got["b"]["s_stat"] == -n * (n - 1) / 2 and got["b"]["variance"] == n * (n - 1) * (2 * n + 5) / 18
    assert got["c"]["s_stat"] == 100 * 1000 * 999 / 2 and got["c"]["direction"] == "increasing"  # a saw: between two teeth rises and falls are even
    assert got["d"]["s_stat"] == 0 and got["d"]["direction"] == "no-monotonic-direction"


def test_seasonal_trend(spark):
    rows = [("a", m, y, float(y)) for m in (1, 2) for y in range(4)] + [("b", 1, y, 1.0) for y in range(3)] + [("c", 1, 1, 1.0)]
    got = {r["k"]: (r["s_stat"], r["pairs"], r["direction"]) for r in stats.seasonal_kendall(spark.createDataFrame(rows, "k string, m int, y int, v double"), ["k"], "m", F.col("y"), "v").collect()}
    assert got == {"a": (12.0, 12, "increasing"), "b": (0.0, 3, "insufficient")}


def test_scans_have_no_single_partition(spark):
    """Ranks, q-values and fronts against a plain pass, with ties and a single value, and no window without a partition."""
    import random

    rng = random.Random(3)
    for rows in ([(i, rng.choice([0.001, 0.5, 1.0, rng.random()])) for i in range(300)], [(1, 0.2)], [(i, 0.5) for i in range(40)]):
        out = stats.benjamini_hochberg(spark.createDataFrame(rows, "id int, p double"), "id", "p")
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        ordered = sorted(rows, key=lambda r: (r[1], r[0]))
        least, want = 1.0, {}
        for k in range(len(ordered), 0, -1):
            least = min(least, ordered[k - 1][1] * len(rows) / k)
            want[ordered[k - 1][0]] = (k, least)
        assert {r["id"]: (r["rank"], pytest.approx(r["q"])) for r in out.collect()} == want
    rows = [(i, float(rng.randrange(25)), float(rng.randrange(25))) for i in range(150)]
    out = evidence.pareto_front(spark.createDataFrame(rows, "id int, u double, c double"), "u", "c", "id")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in out.collect()} == {i for i, u, c in rows if not any(x >= u and y <= c and (x > u or y < c) for _, x, y in rows)}
