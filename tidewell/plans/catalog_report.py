"""Queries over whole reports: contradictions, claims, their negotiation; provider sets and weighted neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import applicability, budget, evidence, nested, report, spatial, stats
from tidewell.plans.catalog import MILES, query, r

TOLD = "stability_status <> 'not-computed'"
RULES = f"""list_filter([CASE WHEN single_origin > 0 THEN concat(single_origin, ' record(s) rest on one laboratory sample; copies of it confirm nothing') END,
    CASE WHEN unaccredited > 0 THEN concat(unaccredited, ' record(s) have no laboratory with an active accreditation') END, CASE WHEN geocoder_m > 50 THEN concat('two geocoders are ', printf('%.1f', geocoder_m), ' m apart') END,
    CASE WHEN near_boundary THEN concat('the place is ', printf('%.1f', boundary_m), ' m from a service boundary') END, CASE WHEN gap THEN 'the place lies in a gap between service areas' END, CASE WHEN overlap THEN 'the place lies in overlapping service areas' END,
    CASE WHEN polygons > 1 THEN 'several service areas hold the place' END, CASE WHEN equal_candidates THEN 'two systems match equally well' END, CASE WHEN {TOLD} AND stability_score < 0.75 THEN concat('moved points find other systems: ', stability_status) END], lambda m: m IS NOT NULL)"""
TEMPLATES = [
    ("accepted", "provider-support", "provider-identity", "serves", "'support'", "Provider Identity Agent", "score", "false", "['official-service-area']"),
    ("NOT accepted", "provider-oppose", "provider-identity", "'one'", "'oppose'", "Provider Identity Agent", "0.99", "true", "[]"),
    (TOLD, "boundary-stability", "provider-identity", "serves", "CASE WHEN stability_score >= 0.75 THEN 'support' ELSE 'oppose' END", "Boundary Robustness Agent", "CASE WHEN stability_score >= 0.75 THEN stability_score ELSE 1 - stability_score END", "stability_score < 0.5", "['coordinate-perturbation-test']"),
    ("households > 0", "household-data", "household-measurement", "'own'", "'support'", "Direct Household Sample Agent", "1.0", "false", "['direct-household-sample']"),
    ("households = 0", "scope-veto", "household-measurement", "'tap'", "'oppose'", "Evidence Scope Guardian", "1.0", "true", "[]"),
    ("synced", "sdwis-compliance", "current-federal-compliance", "CAST(active > 0 AS STRING)", "'support'", "SDWIS Compliance Agent", "0.97", "false", "['federal-cache']"),
    ("ccr_year IS NOT NULL", "ccr-context", "annual-system-report", "''", "'support'", "CCR Context Agent", "0.94", "false", "[concat('annual-report-', ccr_year)]"),
    ("stations > 0", "wqp-context", "environmental-context", "''", "'support'", "WQP Context Agent", "0.95", "false", "['nearby-stations']"),
    ("stations > 0", "wqp-tap-veto", "household-measurement", "'near'", "'oppose'", "WQP Context Agent", "1.0", "true", "[]"),
    ("records > 0", "independence", "record-independence", "''", "'support'", "Originating-Sample Independence Agent", "CASE WHEN origins > 0 THEN 1.0 ELSE 0.7 END", "false", "[concat('origin-count-', origins)]"),
    ("len(told) > 0", "contradiction", "unqualified-high-confidence", "''", "'oppose'", "Contradiction Agent", "least(1.0, 0.55 + 0.05 * len(told))", "false", "list_transform(range(len(told)), lambda i: concat('contradiction-', i))"),
]
CLAIMS = f"p AS (SELECT *, {RULES} AS told, concat('system ', coalesce(pwsid, 'unknown')) AS serves FROM tb_places), cl AS (" + " UNION ALL ".join(
    f"SELECT place_id, '{claim}' AS claim, '{topic}' AS topic, {what} AS proposition, {stance} AS stance, '{agent}' AS agent, CAST({confidence} AS DOUBLE) AS confidence, {veto} AS hard_veto, CAST({origins} AS STRING[]) AS origins FROM p WHERE {when}"
    for when, claim, topic, what, stance, agent, confidence, veto, origins in TEMPLATES
) + ")"
AGENTS = "CASE agent " + " ".join(f"WHEN '{a}' THEN {w}" for a, w in evidence.RELIABILITY.items()) + " END"


def _places(v):
    cited = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type")) for i, kind in (("polygon", "provider-boundary"), ("record", "federal-system-record"), ("station", "nearby-environmental-monitoring"))])
    return v("tb_places").withColumn("evidence", cited)


@query("rp04_rules", f"SELECT place_id, len(told) AS n, array_to_string(told, ' | ') AS contradictions FROM (SELECT place_id, {RULES} AS told FROM tb_places)")
def _(v):
    return report.contradictions(_places(v)).select("place_id", F.size("contradictions").alias("n"), F.array_join("contradictions", " | ").alias("contradictions"))


@query("rp03_investigation_claims", f"WITH {CLAIMS} SELECT place_id, claim, topic, stance, agent, round(confidence, 6) AS confidence, hard_veto, array_to_string(origins, ' ') AS origins, CASE WHEN claim IN ('provider-support', 'sdwis-compliance', 'wqp-context') THEN 1 ELSE 0 END AS cited FROM cl")
def _(v):
    claims = report.investigation_claims(report.contradictions(_places(v)))
    return claims.select("place_id", "claim", "topic", "stance", "agent", r("confidence", 6), "hard_veto", F.array_join("origins", " ").alias("origins"), F.size("evidence_ids").alias("cited"))


@query(
    "rp01_investigation",
    f"""WITH {CLAIMS}, w AS (SELECT place_id, topic, proposition, stance, o, max(confidence * {AGENTS} / greatest(1, len(origins))) AS w FROM (SELECT *, unnest(CASE WHEN len(origins) > 0 THEN origins ELSE [claim] END) AS o FROM cl) GROUP BY ALL),
    s AS (SELECT place_id, topic, proposition, sum(CASE WHEN stance = 'support' THEN w ELSE 0 END) AS support, sum(CASE WHEN stance = 'oppose' THEN w ELSE 0 END) AS oppose FROM w GROUP BY ALL),
    t AS (SELECT place_id, topic, proposition, bool_or(hard_veto AND stance = 'oppose') AS vetoed FROM cl GROUP BY ALL),
    o AS (SELECT *, CASE WHEN vetoed THEN 'rejected' WHEN support >= 0.62 AND support - oppose >= 0.12 THEN 'accepted' WHEN oppose >= 0.62 AND oppose - support >= 0.12 THEN 'rejected' ELSE 'undecided' END AS verdict FROM s JOIN t USING (place_id, topic, proposition)),
    c AS (SELECT place_id, count(*) FILTER (verdict = 'accepted') AS accepted_claims, count(*) FILTER (verdict = 'rejected') AS rejected_claims, count(*) FILTER (verdict = 'undecided') AS undecided_claims, count(*) FILTER (vetoed) AS vetoes, round(count(*) FILTER (verdict = 'accepted') / count(*), 4) AS consensus_fraction,
      array_to_string(list(concat(topic, '=', verdict) ORDER BY topic, verdict), ' ') AS outcomes FROM o GROUP BY 1)
    SELECT place_id, CASE WHEN households > 0 THEN 'exact-household-data-found' ELSE 'no-exact-household-sample-found' END AS direct_status,
      CASE WHEN NOT located THEN 'address-not-resolved' WHEN polygons = 0 THEN 'no-service-polygon-match' WHEN accepted THEN 'exact-address-to-system-match' ELSE 'provider-not-resolved' END AS location_status,
      CASE WHEN households > 0 THEN 'exact-household-sample' WHEN accepted THEN 'exact-address/system-level-water-quality' ELSE 'unresolved' END AS result_level,
      CASE WHEN households > 0 AND accepted THEN 'very-high' WHEN accepted AND len(told) > 0 THEN 'moderate' WHEN accepted THEN 'high' ELSE 'insufficient' END AS confidence, len(told) AS contradictions,
      accepted_claims, rejected_claims, undecided_claims, vetoes, consensus_fraction, outcomes FROM p JOIN c USING (place_id)""",
)
def _(v):
    nobody = v("tb_places").sparkSession.createDataFrame([], "agent string, weight double")
    out = report.investigations(_places(v), nobody)
    told = F.array_join(F.array_sort(F.transform("outcomes", lambda o: F.concat(o["topic"], F.lit("="), o["verdict"]))), " ")
    return out.withColumns({"contradictions": F.size("contradictions"), "outcomes": told})


@query(
    "sa11_provider_set",
    """WITH c AS (SELECT user_id, concat('P', CAST(event_id % 23 AS STRING)) AS p, max(least(1.0, value / 150)) AS score FROM events GROUP BY 1, 2), t AS (SELECT user_id, max(score) AS top, count(*) AS candidates FROM c GROUP BY 1),
    n AS (SELECT user_id, CASE WHEN count(*) > 1 THEN max(score) - max(score) FILTER (k = 2) ELSE max(score) END AS margin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, p) AS k FROM c) GROUP BY 1),
    s AS (SELECT c.* FROM c JOIN t USING (user_id) WHERE (top - score <= greatest(0.03, least(0.12, (1 - top) * 0.5 + 0.03)) AND score >= 0.5) OR p = concat('P', CAST(user_id % 23 AS STRING)))
    SELECT user_id, 'uncalibrated-conservative' AS status, count(s.p) AS set_size, count(s.p) = 1 AS singleton, round(any_value(margin), 4) AS top_margin, array_to_string(list(s.p ORDER BY s.score DESC, s.p), ' ') AS members FROM t JOIN n USING (user_id) LEFT JOIN s USING (user_id) GROUP BY 1""",
)
def _(v):
    found = v("events").select("user_id", F.concat(F.lit("P"), F.col("event_id") % 23).alias("p"), F.least(F.lit(1.0), F.col("value") / 150).alias("score"), F.concat(F.lit("P"), F.col("user_id") % 23).alias("accepted"))
    out = evidence.provider_set(found, "user_id", "p", "score", accepted="accepted")
    return out.select("user_id", "status", "set_size", "singleton", r("top_margin"), F.array_join(F.transform("members", lambda m: m["candidate"]), " ").alias("members"))


@query(
    "sa10_covariates",
    f"""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY miles, station_id) AS k FROM (SELECT p.address_id, s.station_id, {MILES} AS miles FROM tb_points p, tb_stations s) WHERE miles <= 5) WHERE k <= 4),
    m AS (SELECT station_id, avg(value) AS x FROM tb_results GROUP BY 1),
    w AS (SELECT address_id, x, 1 / pow(miles + 1e-3, 2) * CASE WHEN address_id % 3 = n.station_id % 3 THEN 2 ELSE 1 END / CASE WHEN address_id % 4 = 0 OR n.station_id % 5 = 0 THEN 1 ELSE 1 + abs(address_id * 11 % 300 - n.station_id * 7 % 400) / 100.0 END AS w FROM n JOIN m ON n.station_id = m.station_id)
    SELECT address_id, count(*) AS points, round(sum(w * x) / sum(w), 4) AS estimate, round(sqrt(greatest(0, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2))), 3) AS spread FROM w GROUP BY 1 HAVING count(*) >= 3""",
)
def _(v):
    near = spatial.nearest(v("tb_points"), v("tb_stations"), 5.0, 4, "address_id", "station_id")
    pairs = near.join(v("tb_results").groupBy("station_id").agg(F.avg("value").alias("x")), "station_id")
    pairs = pairs.withColumns({"same_aquifer": F.col("address_id") % 3 == F.col("station_id") % 3, "depth_apart": F.when((F.col("address_id") % 4 != 0) & (F.col("station_id") % 5 != 0), F.abs(F.col("address_id") * 11 % 300 - F.col("station_id") * 7 % 400).cast("double"))})
    return stats.inverse_distance(pairs, "address_id", "x", "miles", same="same_aquifer", apart="depth_apart").select("address_id", "points", r("estimate"), r("spread", 3))


@query(
    "fn40_service_urls",
    """SELECT item_id, replace(replace(replace(replace(fullkey, '$.', ''), '[', '.'), ']', ''), '"', '') AS path, json_extract_string(atom, '$') AS url FROM (SELECT i.item_id, t.fullkey, t.atom, t.key, t.type FROM (SELECT * FROM tb_layers WHERE json_valid(body)) i, json_tree(i.body::JSON) t) x
    WHERE type = 'VARCHAR' AND lower(key) = 'url' AND regexp_matches(json_extract_string(atom, '$'), '(?i)(FeatureServer|MapServer)')""",
)
def _(v):
    return nested.service_urls(v("tb_layers"), "item_id", "body")


LABEL = "CASE WHEN {x} >= 0.9 THEN 'very-high' WHEN {x} >= 0.75 THEN 'high' WHEN {x} >= 0.55 THEN 'moderate' WHEN {x} >= 0.35 THEN 'low' ELSE 'insufficient' END"
AS_OF = "1999-06-30"
DIMENSIONS = {
    "geolocation": "CASE WHEN NOT primary_found AND NOT secondary_found THEN 0 WHEN NOT (primary_found AND secondary_found) OR geocoder_m IS NULL THEN 0.82 WHEN geocoder_m <= 15 THEN 1 WHEN geocoder_m <= 30 THEN 0.93 WHEN geocoder_m <= 50 THEN 0.82 WHEN geocoder_m <= 100 THEN 0.58 ELSE 0.3 END",
    "provider_identity": "CASE WHEN accepted THEN score ELSE 0 END * stab * CASE WHEN gap THEN 0.15 ELSE 1 END * CASE WHEN overlap THEN 0.65 ELSE 1 END",
    "spatial_robustness": "CASE WHEN gap THEN 0.2 ELSE 1 END * CASE WHEN overlap THEN 0.55 ELSE 1 END * CASE WHEN near_boundary THEN 0.72 ELSE 1 END * stab",
    "evidence_scope": "CASE WHEN households > 0 THEN 1 WHEN accepted THEN 0.62 ELSE 0.2 END",
    "temporal_freshness": f"CASE WHEN newest IS NULL THEN 0.2 ELSE greatest(0.15, least(1.0, pow(0.5, greatest(0, datediff('day', newest, DATE '{AS_OF}')) / 365.0))) END",
    "contaminant_coverage": "CASE WHEN records = 0 THEN 0.1 ELSE 0.55 * least(1.0, analytes / 20.0) + 0.45 * least(1.0, groups / 6.0) END",
    "originating_sample_independence": "CASE WHEN records = 0 THEN 0.1 ELSE least(1.0, 0.35 + 0.65 * least(1.0, effective_n::DOUBLE / greatest(3, least(records, 20)))) END",
    "source_conflict": "greatest(0.25, 1 / (1 + 0.35 * contradictions))",
    "federal_context_availability": "(CASE WHEN federal_synced THEN 1 ELSE 0.55 END + CASE WHEN ccr_synced THEN 1 ELSE 0.6 END + CASE WHEN wqp_synced THEN 1 ELSE 0.6 END) / 3",
}
POSITIVE = lambda f: " + ".join(f.format(k=k, w=w) for k, w in budget.WEIGHTS.items())
BUDGET = f"""d AS (SELECT *, {", ".join(f"round(({v})::DOUBLE + 1e-9, 4) AS {k}" for k, v in DIMENSIONS.items())} FROM (SELECT *, CASE WHEN stability_status <> 'not-computed' THEN stability_score WHEN near_boundary THEN 0.65 ELSE 0.9 END AS stab FROM tb_budget_places)),
    s AS (SELECT *, exp(({POSITIVE("CASE WHEN {k} > 0 THEN {w} * ln({k}) ELSE 0 END")}) / ({POSITIVE("CASE WHEN {k} > 0 THEN {w} ELSE 0 END")})) AS raw FROM d),
    c AS (SELECT *, CASE WHEN gap THEN least(CASE WHEN accepted THEN raw ELSE least(raw, 0.25) END, 0.3) WHEN accepted THEN raw ELSE least(raw, 0.25) END AS sys FROM s),
    h AS (SELECT *, CASE WHEN households > 0 THEN pow(sys * evidence_scope * temporal_freshness, 1 / 3.0) ELSE least(pow(sys * evidence_scope * 0.4, 1 / 3.0), 0.49) END AS hh FROM c)"""


def _budget(v):
    return budget.uncertainty_budget(v("tb_budget_places"), F.lit(AS_OF).cast("date"))


@query(
    "sa14_budget",
    f"""WITH {BUDGET}, u AS (SELECT place_id, string_agg(concat(dim, '=', printf('%.4f', less)), ' ' ORDER BY k) AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY less DESC, pos) AS k FROM (
      {" UNION ALL ".join(f"SELECT place_id, '{k}' AS dim, {i} AS pos, round(1 - {k} + 1e-9, 4) AS less FROM d" for i, k in enumerate(DIMENSIONS))})) WHERE k <= 4 GROUP BY 1)
    SELECT place_id, {", ".join(DIMENSIONS)}, round(sys + 1e-9, 4) AS system_confidence, {LABEL.format(x="sys")} AS system_label, round(hh + 1e-9, 4) AS household_confidence, {LABEL.format(x="hh")} AS household_label, dominant FROM h JOIN u USING (place_id)""",
)
def _(v):
    dominant = F.array_join(F.transform("dominant", lambda x: F.concat(x["dimension"], F.lit("="), F.format_string("%.4f", x["uncertainty"]))), " ")
    return _budget(v).select("place_id", "dimensions.*", "system_confidence", "system_label", "household_confidence", "household_label", dominant.alias("dominant"))


@query(
    "sa16_envelope",
    f"""WITH {BUDGET}, b AS (SELECT *, round(sys + 1e-9, 4) AS base FROM h), p AS (SELECT *, CASE WHEN set_size > 1 THEN 0.25 ELSE 0 END AS p1, CASE WHEN single_origin THEN least(0.3, 0.08 + max_delta) ELSE 0 END AS p2, CASE WHEN coverage_fraction < 0.75 THEN 0.15 ELSE 0 END AS p3,
      CASE WHEN NOT path_complete THEN 0.2 ELSE 0 END AS p5, CASE WHEN undecided > 0 THEN least(0.2, 0.04 * undecided) ELSE 0 END AS p6 FROM b), w AS (SELECT *, greatest(0, base - p1 - p2 - p3 - p5 - p6)::DOUBLE AS lo, least(1, base + 0.05)::DOUBLE AS hi FROM p)
    SELECT place_id, round(lo + 1e-9, 4) AS worst, round(hi + 1e-9, 4) AS best, round(hi - lo + 1e-9, 4) AS width, {LABEL.format(x="base")} = {LABEL.format(x="lo")} AND hi - lo <= 0.2 + 1e-9 AS stable_under_stress,
      CAST(set_size > 1 AS INT) + CAST(single_origin AS INT) + CAST(coverage_fraction < 0.75 AS INT) + CAST(household_blocked AS INT) + CAST(NOT path_complete AS INT) + CAST(undecided > 0 AS INT) AS scenarios FROM w""",
)
def _(v):
    return budget.verdict_envelope(_budget(v)).select("place_id", "worst", "best", "width", "stable_under_stress", F.size("scenarios").alias("scenarios"))


LATTICE_SCOPES = ["public-water-system-record", "exact-household-sample", "distribution-point-record"]
LATTICE = f"""r AS (SELECT *, CASE sample_type WHEN 'TAP' THEN 6 WHEN 'DISTRIBUTION' THEN 5 ELSE 4 END AS rank, pwsid = concat('35900', lpad(CAST(revision * 7 AS STRING), 2, '0')) AS same FROM tb_samples),
    x AS (SELECT *, CASE claim_scope WHEN 'exact-household-sample' THEN 7 WHEN 'distribution-point-record' THEN 5 ELSE 2 END <= rank AS fits FROM r, (SELECT unnest({LATTICE_SCOPES}) AS claim_scope)),
    d AS (SELECT *, (ln(CASE WHEN location_code = 'L7' THEN 1 WHEN same THEN 0.88 ELSE 0.2 END) + ln(greatest(0.05, least(1.0, pow(0.5, greatest(0, datediff('day', sample_date, DATE '1999-06-30')) / 365.0))))
      + ln(CASE WHEN lab_id = 'LAB3' THEN 0.05 WHEN lab_id = 'LAB4' THEN 0.9 ELSE 0.68 END) + ln(0.45 + CASE WHEN sample_id IS NOT NULL THEN 0.18 ELSE 0 END + 0.08 + 0.05) + ln(CASE lab_id WHEN 'LAB0' THEN 1 WHEN 'LAB1' THEN 0.35 WHEN 'LAB2' THEN 0.35 ELSE 0.72 END)
      + ln(CASE WHEN result = 'ND' THEN 0.1 ELSE 0.9 END) + ln(CASE WHEN fits THEN 1 ELSE 0.01 END)) / 7 AS l FROM x),
    s AS (SELECT *, round(least(exp(l), CASE WHEN fits THEN 1 ELSE 0.15 END, CASE WHEN same THEN 1 ELSE 0.2 END)::DOUBLE + 1e-9, 4) AS score, NOT fits OR result = 'ND' OR NOT same AS vetoed FROM d)"""


def _judged(v):
    lab, known = F.col("lab_id"), F.lit(None).cast("boolean")
    rows = v("tb_samples").withColumns({
        "place_pwsid": F.concat(F.lit("35900"), F.lpad((F.col("revision") * 7).cast("string"), 2, "0")), "address_hash": F.col("location_code"), "place_address_hash": F.lit("L7"), "lab_status": F.when(lab == "LAB0", "verified").when(lab == "LAB1", "expired").when(lab == "LAB2", "unaccredited"),
        "admissible": F.when(lab == "LAB3", False).when(lab == "LAB4", True).otherwise(known), "path_certainty": F.lit(0.9), "factual_status": F.when(F.col("result") == "ND", "quarantined"),
    })
    return applicability.applicability(rows, LATTICE_SCOPES, F.lit("1999-06-30").cast("date"))


@query("sa15_lattice", f"WITH {LATTICE} SELECT claim_scope, sample_type, count(*) AS n, round(avg(score), 6) AS mean, count(*) FILTER (score >= 0.5 AND NOT vetoed) AS eligible, count(*) FILTER (vetoed) AS vetoed FROM s GROUP BY 1, 2")
def _(v):
    return _judged(v).groupBy("claim_scope", "sample_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if("eligible").alias("eligible"), F.count_if(F.size("vetoes") > 0).alias("vetoed"))


@query("ag25_by_claim_scope", f"""WITH {LATTICE}, k AS (SELECT *, row_number() OVER (PARTITION BY claim_scope ORDER BY score DESC, rid) AS k FROM s) SELECT claim_scope, count(*) FILTER (score >= 0.5 AND NOT vetoed) AS eligible, count(*) AS total, round(avg(score), 4) AS mean, count(*) FILTER (vetoed) AS vetoed,
    string_agg(rid, ' ' ORDER BY k) FILTER (k <= 12) AS top FROM k GROUP BY 1""")
def _(v):
    return applicability.by_claim_scope(_judged(v), "rid").withColumn("top", F.array_join("top", " "))
