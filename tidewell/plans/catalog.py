"""Named queries over the testbed, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import measure as M
from tidewell.functions import scores as S
from tidewell.operators import compliance, evidence, spatial, stats, versions
from tidewell.operators.graph import reachable
from tidewell.plans.testbed import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (views by name) under `name`, with its SQL."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda v: view(spark, sf_dir, v))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


# Shared SQL: the measurement in ug/L of every sample.
FACTOR = "CASE unit WHEN 'mg/L' THEN 1000.0 WHEN 'ug/L' THEN 1.0 ELSE 0.001 END"
MEASURED = f"(SELECT *, CASE WHEN result = 'ND' OR substr(result, 1, 1) = '<' THEN NULL ELSE CAST(result AS DOUBLE) * {FACTOR} END AS value, (result = 'ND' OR substr(result, 1, 1) = '<') AS censored FROM tb_samples)"


def measured(v: Callable[[str], DataFrame]) -> DataFrame:
    m = M.measurement(F.col("result"), F.col("unit"), F.col("mdl"))
    return v("tb_samples").withColumn("_m", m).withColumns({"value": F.col("_m.canonical_value"), "censored": F.col("_m.censored")}).drop("_m")


# ---- scalar functions -------------------------------------------------------------------------------------------


@query("fn01_normalize_pwsid", "SELECT pwsid, concat('US-FL0', pwsid) AS raw, right(pwsid, 7) AS id FROM tb_systems")
def _(v):
    return v("tb_systems").select("pwsid", F.concat(F.lit("US-FL0"), "pwsid").alias("raw")).withColumn("id", M.normalize_pwsid(F.col("raw")))


@query("fn02_first_number", "SELECT event_id, TRY_CAST(regexp_extract(props, '[-+]?[0-9]*\\.?[0-9]+') AS DOUBLE) AS n FROM events")
def _(v):
    return v("events").select("event_id", M.first_number(F.col("props")).alias("n"))


@query(
    "fn03_parse_numeric",
    "SELECT rid, CASE WHEN substr(result, 1, 1) = '<' THEN '<' END AS qualifier, TRY_CAST(replace(result, '<', '') AS DOUBLE) AS number, count(*) AS n FROM tb_samples GROUP BY ALL",
)
def _(v):
    return v("tb_samples").groupBy("rid", M.qualifier(F.col("result")).alias("qualifier"), M.anchored_number(F.col("result")).alias("number")).agg(F.count("*").alias("n"))


@query(
    "fn04_dates",
    "SELECT DISTINCT CAST(sample_date AS STRING) AS iso, CAST(sample_date AS STRING) AS us, CAST(sample_date AS STRING) AS named, CAST(NULL AS STRING) AS bad FROM tb_samples",
)
def _(v):
    d = v("tb_samples").select("sample_date").distinct()
    forms = {"iso": F.col("sample_date").cast("string"), "us": F.date_format("sample_date", "M/d/yyyy"), "named": F.upper(F.date_format("sample_date", "dd-MMM-yyyy")), "bad": F.lit("not a date")}
    return d.select(*[M.any_date(c).cast("string").alias(k) for k, c in forms.items()])


@query(
    "fn05_detection",
    """SELECT analyte, sum(CASE WHEN result = 'ND' OR result LIKE '<%' THEN 1 ELSE 0 END)::BIGINT AS non_detect,
       sum(CASE WHEN result <> 'ND' AND result NOT LIKE '<%' AND CAST(result AS DOUBLE) > 0 AND CAST(result AS DOUBLE) >= mdl THEN 1 ELSE 0 END)::BIGINT AS detected FROM tb_samples GROUP BY analyte""",
)
def _(v):
    return v("tb_samples").groupBy("analyte").agg(F.count_if(M.is_non_detect(F.col("result"))).alias("non_detect"), F.count_if(M.detected(F.col("result"), F.col("mdl"))).alias("detected"))


@query(
    "fn08_measurement",
    f"""SELECT analyte, unit, count(*) AS n, count(value) AS with_value, round(sum(value), 3) AS total,
        round(sum(CASE WHEN result = 'ND' THEN mdl * {FACTOR} WHEN result LIKE '<%' THEN CAST(substr(result, 2) AS DOUBLE) * {FACTOR} END), 3) AS limits FROM {MEASURED} GROUP BY analyte, unit""",
)
def _(v):
    m = v("tb_samples").withColumn("m", M.measurement(F.col("result"), F.col("unit"), F.col("mdl")))
    return m.groupBy("analyte", "unit").agg(F.count("*").alias("n"), F.count("m.canonical_value").alias("with_value"), F.round(F.sum("m.canonical_value"), 3).alias("total"), F.round(F.sum("m.detection_limit_ug_l"), 3).alias("limits"))


@query("fn13_granularity", "SELECT sample_type, CASE sample_type WHEN 'TAP' THEN 'tap' WHEN 'ENTRY POINT' THEN 'treatment-entry' ELSE 'system' END AS granularity, count(*) AS n FROM tb_samples GROUP BY 1, 2")
def _(v):
    return v("tb_samples").groupBy("sample_type", M.granularity(F.col("sample_type")).alias("granularity")).agg(F.count("*").alias("n"))


@query(
    "fn14_violations",
    """SELECT pwsid, sum(CASE WHEN status = 'OPEN' THEN 1 ELSE 0 END)::BIGINT AS active,
       sum(CASE WHEN status = 'OPEN' AND category IN ('MCL EXCEEDED', 'TREATMENT TECHNIQUE') THEN 1 ELSE 0 END)::BIGINT AS health,
       sum(CASE WHEN status = 'OPEN' AND category IN ('MONITORING AND REPORTING', 'PUBLIC NOTICE') THEN 1 ELSE 0 END)::BIGINT AS monitoring, count(*) AS total,
       CASE WHEN sum(CASE WHEN status = 'OPEN' AND category IN ('MCL EXCEEDED', 'TREATMENT TECHNIQUE') THEN 1 ELSE 0 END) > 0 THEN 'health'
            WHEN sum(CASE WHEN status = 'OPEN' AND category IN ('MONITORING AND REPORTING', 'PUBLIC NOTICE') THEN 1 ELSE 0 END) > 0 THEN 'monitoring'
            WHEN sum(CASE WHEN status = 'OPEN' THEN 1 ELSE 0 END) > 0 THEN 'other' ELSE 'none-active' END AS compliance_status
       FROM tb_violations GROUP BY pwsid""",
)
def _(v):
    rows = v("tb_violations").withColumns({"on": M.violation_active(F.col("status"), F.lit(None).cast("date"), F.lit("2000-01-01").cast("date")), "kind": M.violation_kind(F.col("category"))})
    kinds = {k: F.count_if(F.col("on") & (F.col("kind") == k)).alias(k) for k in ("health", "monitoring")}
    out = rows.groupBy("pwsid").agg(F.count_if("on").alias("active"), *kinds.values(), F.count("*").alias("total"))
    return out.withColumn("compliance_status", F.when(F.col("health") > 0, "health").when(F.col("monitoring") > 0, "monitoring").when(F.col("active") > 0, "other").otherwise("none-active"))


@query(
    "fn16_fingerprint",
    "SELECT DISTINCT rid, sha256(concat_ws('|', upper(pwsid), upper(analyte), CAST(sample_date AS STRING), upper(result), upper(unit), upper(location_code))) AS fingerprint FROM tb_samples",
)
def _(v):
    return v("tb_samples").select("rid", M.fingerprint(*[F.col(c) for c in ("pwsid", "analyte", "sample_date", "result", "unit", "location_code")]).alias("fingerprint")).distinct()


@query(
    "fn17_origin_key",
    """SELECT count(*) AS rows_, count(DISTINCT CASE WHEN sample_id IS NOT NULL THEN concat('EXPLICIT:', sample_id) ELSE concat('DERIVED:', sha256(concat_ws('|', pwsid, analyte, CAST(sample_date AS STRING), location_code))) END) AS origins FROM tb_samples""",
)
def _(v):
    key = M.origin_key(F.col("sample_id"), F.col("pwsid"), F.col("analyte"), F.col("sample_date"), F.col("location_code"))
    return v("tb_samples").agg(F.count("*").alias("rows_"), F.count_distinct(key).alias("origins"))


@query("fn34_quarter", "SELECT concat(CAST(year(sample_date) AS STRING), '-Q', CAST(quarter(sample_date) AS STRING)) AS q, count(*) AS n FROM tb_samples GROUP BY 1")
def _(v):
    return v("tb_samples").groupBy(M.year_quarter(F.col("sample_date")).alias("q")).agg(F.count("*").alias("n"))


@query(
    "fn36_confidence",
    "SELECT CASE WHEN confidence >= 0.9 THEN 'very-high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.55 THEN 'moderate' WHEN confidence >= 0.35 THEN 'low' ELSE 'insufficient' END AS label, count(*) AS n, round(avg(confidence), 8) AS mean FROM tb_claims GROUP BY 1",
)
def _(v):
    return v("tb_claims").groupBy(S.confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 8).alias("mean"))


@query(
    "fn37_freshness",
    "SELECT pwsid, round(max(CASE WHEN sample_date <= DATE '1997-01-01' THEN pow(0.5, datediff('day', sample_date, DATE '1997-01-01') / 365.0) ELSE 0 END), 6) AS freshness FROM tb_samples GROUP BY pwsid",
)
def _(v):
    return v("tb_samples").groupBy("pwsid").agg(F.round(F.max(S.freshness(F.datediff(F.lit("1997-01-01").cast("date"), "sample_date"), 365.0)), 6).alias("freshness"))


@query(
    "fn38_geometric_mean",
    "SELECT claim_id, round(CASE WHEN confidence > 0 THEN exp((ln(confidence) + ln(0.5)) / 2) ELSE 0.5 END, 6) AS g FROM tb_claims",
)
def _(v):
    return v("tb_claims").select("claim_id", F.round(S.geometric_mean(F.col("confidence"), F.lit(0.5), F.lit(None).cast("double")), 6).alias("g"))


@query(
    "fn44_plausibility",
    f"""SELECT analyte, sum(CASE WHEN value > 10000 THEN 1 ELSE 0 END)::BIGINT AS above_max, sum(CASE WHEN value < 0.01 THEN 1 ELSE 0 END)::BIGINT AS below_min, count(*) AS n FROM {MEASURED} GROUP BY analyte""",
)
def _(v):
    limits = F.struct(F.lit(0.01).alias("low"), F.lit(10000.0).alias("high"))
    rows = measured(v).withColumn("_l", limits)
    return rows.groupBy("analyte").agg(F.count_if(F.col("value") > F.col("_l.high")).alias("above_max"), F.count_if(F.col("value") < F.col("_l.low")).alias("below_min"), F.count("*").alias("n"))


CHEM = "SELECT p_partkey, 6.0 + p_size % 30 / 10.0 AS ph, 50.0 + p_partkey % 400 AS tds, 10.0 + p_partkey % 200 AS ca, 20.0 + p_size AS alk, 5.0 + p_partkey % 60 AS cl, 10.0 + p_partkey % 90 AS so4 FROM part"


@query(
    "fn45_corrosion",
    f"""SELECT p_partkey, round(ph - ((9.3 + (log10(greatest(tds, 1.0)) - 1) / 10 + (-13.12 * log10(298.0) + 34.55)) - (log10(0.4 * ca) + log10(alk))), 6) AS lsi,
        CASE WHEN cl / so4 > 0.5 THEN 'elevated' WHEN cl / so4 > 0.2 THEN 'moderate' ELSE 'low' END AS csmr_tier FROM ({CHEM})""",
)
def _(v):
    c = _chem(v)
    return c.select("p_partkey", F.round(S.langelier(F.col("ph"), F.col("tds"), F.lit(25.0), F.col("ca"), F.col("alk")), 6).alias("lsi"), S.chloride_sulfate_tier(F.col("cl"), F.col("so4")).alias("csmr_tier"))


def _chem(v):
    k = F.col("p_partkey")
    return v("part").select(k, (6.0 + F.col("p_size") % 30 / 10.0).alias("ph"), (50.0 + k % 400).alias("tds"), (10.0 + k % 200).alias("ca"), (20.0 + F.col("p_size")).alias("alk"), (5.0 + k % 60).alias("cl"), (10.0 + k % 90).alias("so4"))


@query(
    "fn46_ion_balance",
    f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN e <= 10 THEN 'pass' WHEN e <= 20 THEN 'review' ELSE 'quarantine' END AS status
        FROM (SELECT 100 * abs(ca / 20.04 - (cl / 35.45 + so4 / 48.03 + alk / 50.04)) / (ca / 20.04 + cl / 35.45 + so4 / 48.03 + alk / 50.04) AS e FROM ({CHEM}))) GROUP BY status""",
)
def _(v):
    c = _chem(v)
    e = S.ion_balance(F.col("ca") / 20.04, F.col("cl") / 35.45 + F.col("so4") / 48.03 + F.col("alk") / 50.04)
    return c.groupBy(S.balance_status(e).alias("status")).agg(F.count("*").alias("n"))


@query(
    "fn48_lead_risk",
    """SELECT c_custkey, pts AS points, CASE WHEN pts >= 70 THEN 'high' WHEN pts >= 25 THEN 'moderate' WHEN pts >= 0 THEN 'low' ELSE 'minimal' END AS tier FROM (
       SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 70 WHEN c_mktsegment = 'HOUSEHOLD' THEN -20 ELSE 0 END
         + CASE WHEN 1900 + c_custkey % 120 < 1950 THEN 25 WHEN 1900 + c_custkey % 120 < 1987 THEN 15 ELSE 0 END AS pts FROM customer)""",
)
def _(v):
    points = S.lead_risk(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment") == "HOUSEHOLD", 1900 + F.col("c_custkey") % 120)
    return v("customer").select("c_custkey", points.alias("points")).withColumn("tier", S.lead_tier(F.col("points")))


@query(
    "fn49_service_line",
    """SELECT c_custkey, round(greatest(0.0, least(1.0, ((1 - w) * p + w * 0.4) * CASE WHEN c_custkey % 3 = 0 THEN 1.25 ELSE 1.0 END * CASE WHEN c_custkey % 4 = 0 THEN 1.2 ELSE 1.0 END)), 6) AS posterior FROM (
       SELECT c_custkey, (c_custkey % 50) / (c_custkey % 50 + 20.0) AS w, CASE WHEN y < 1940 THEN 0.65 WHEN y < 1950 THEN 0.5 WHEN y < 1986 THEN 0.25 WHEN y < 1991 THEN 0.12 ELSE 0.03 END AS p
       FROM (SELECT c_custkey, 1900 + c_custkey % 120 AS y FROM customer))""",
)
def _(v):
    k = F.col("c_custkey")
    post = S.service_line_posterior(1900 + k % 120, F.lit(0.4), k % 50, F.when(k % 3 == 0, 0.6).otherwise(0.1), F.when(k % 4 == 0, -1.0).otherwise(0.0))
    return v("customer").select(k, F.round(post, 6).alias("posterior"))


# ---- versions, windows, intervals -------------------------------------------------------------------------------

KEY = "pwsid, analyte, location_code"


@query(
    "wn01_versions",
    f"""SELECT rid, CAST(row_number() OVER w AS INT) AS version, lead(rid) OVER w IS NULL AS is_current, lead(rid) OVER w AS superseded_by
        FROM (SELECT DISTINCT rid, {KEY}, revision FROM tb_samples) WINDOW w AS (PARTITION BY {KEY} ORDER BY revision, rid)""",
)
def _(v):
    rows = v("tb_samples").select("rid", "pwsid", "analyte", "location_code", "revision").distinct()
    return versions.number_versions(rows, ["pwsid", "analyte", "location_code"], [F.col("revision"), F.col("rid")], "rid").select("rid", "version", "is_current", "superseded_by")


@query(
    "wn02_latest_per_analyte",
    f"SELECT pwsid, analyte, rid, round(value, 4) AS value, CAST(sample_date AS STRING) AS sample_date FROM (SELECT *, row_number() OVER (PARTITION BY pwsid, analyte ORDER BY sample_date DESC, rid) AS k FROM {MEASURED}) WHERE k = 1",
)
def _(v):
    return versions.latest(measured(v), ["pwsid", "analyte"], [F.col("sample_date").desc(), F.col("rid")]).select("pwsid", "analyte", "rid", r("value"), F.col("sample_date").cast("string").alias("sample_date"))


@query(
    "wn04_latest_k_per_station",
    "SELECT station_id, characteristic, result_id FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts DESC, result_id) AS j FROM (SELECT *, row_number() OVER (PARTITION BY station_id, characteristic ORDER BY ts DESC, result_id) AS k FROM tb_results) WHERE k = 1) WHERE j <= 12",
)
def _(v):
    order = [F.col("ts").desc(), F.col("result_id")]
    return versions.latest(versions.latest(v("tb_results"), ["station_id", "characteristic"], order), ["station_id"], order, 12).select("station_id", "characteristic", "result_id")


@query(
    "wn10_trailing_frame",
    "SELECT result_id, round(avg(value) OVER (PARTITION BY station_id ORDER BY result_date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW), 8) AS week_mean FROM tb_results",
)
def _(v):
    w = Window.partitionBy("station_id").orderBy(F.unix_date("result_date")).rangeBetween(-7, 0)
    return v("tb_results").select("result_id", F.round(F.avg("value").over(w), 8).alias("week_mean"))


@query(
    "wn11_runner_up",
    "SELECT topic, proposition, round(top - second, 6) AS margin FROM (SELECT topic, proposition, confidence AS top, lead(confidence) OVER w AS second, row_number() OVER w AS k FROM tb_claims WINDOW w AS (PARTITION BY topic, proposition ORDER BY confidence DESC, claim_id)) WHERE k = 1",
)
def _(v):
    w = Window.partitionBy("topic", "proposition").orderBy(F.col("confidence").desc(), "claim_id")
    rows = v("tb_claims").withColumns({"second": F.lead("confidence").over(w), "k": F.row_number().over(w)})
    return rows.filter("k = 1").select("topic", "proposition", F.round(F.col("confidence") - F.col("second"), 6).alias("margin"))


@query(
    "wn13_verdict_flips",
    "SELECT violation_id, previous, status FROM (SELECT violation_id, status, lag(status) OVER (PARTITION BY pwsid ORDER BY begin_date, violation_id) AS previous FROM tb_violations) WHERE previous <> status",
)
def _(v):
    return versions.flips(v("tb_violations"), ["pwsid"], F.struct("begin_date", "violation_id"), "status").select("violation_id", "previous", "status")


@query(
    "jn09_as_of_version",
    """SELECT rid, rule_id, threshold FROM (SELECT s.rid, v.rule_id, v.threshold, row_number() OVER (PARTITION BY s.rid ORDER BY v.valid_from DESC) AS k
       FROM (SELECT DISTINCT rid, analyte, sample_date FROM tb_samples) s LEFT JOIN tb_rules v ON s.analyte = v.analyte AND v.valid_from <= s.sample_date AND (v.valid_to IS NULL OR v.valid_to >= s.sample_date)) WHERE k = 1""",
)
def _(v):
    rows = v("tb_samples").select("rid", "analyte", "sample_date").distinct()
    return versions.as_of(rows, v("tb_rules").select("analyte", "rule_id", "valid_from", "valid_to", "threshold"), ["analyte"], "sample_date").select("rid", "rule_id", "threshold")


@query(
    "jn10_bitemporal",
    """SELECT s.rid, r.rule_id FROM (SELECT DISTINCT rid, analyte, sample_date FROM tb_samples) s JOIN tb_rules r ON s.analyte = r.analyte AND r.valid_from <= s.sample_date AND (r.valid_to IS NULL OR s.sample_date < r.valid_to)
       AND r.recorded_from <= DATE '1999-06-01' AND (r.recorded_to IS NULL OR DATE '1999-06-01' < r.recorded_to)""",
)
def _(v):
    known = v("tb_rules").filter(versions.valid_at(F.lit("1999-06-01").cast("date"), F.col("recorded_from"), F.col("recorded_to")))
    rows = v("tb_samples").select("rid", "analyte", "sample_date").distinct()
    return rows.join(known, "analyte").filter(versions.valid_at(F.col("sample_date"), F.col("valid_from"), F.col("valid_to"))).select("rid", "rule_id")


# ---- joins and set operations -----------------------------------------------------------------------------------


@query("jn01_lookup", "SELECT v.violation_id, s.name, s.city FROM tb_violations v LEFT JOIN tb_systems s ON v.pwsid = s.pwsid")
def _(v):
    return v("tb_violations").join(v("tb_systems"), "pwsid", "left").select("violation_id", "name", "city")


@query("jn02_station_results", "SELECT s.station_id, s.station_name, count(*) AS n, round(avg(r.value), 8) AS mean FROM tb_stations s JOIN tb_results r ON s.station_id = r.station_id GROUP BY 1, 2")
def _(v):
    return v("tb_stations").join(v("tb_results"), "station_id").groupBy("station_id", "station_name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))


@query("jn03_semi_registry", "SELECT violation_id FROM tb_violations v WHERE EXISTS (SELECT 1 FROM tb_systems s WHERE s.pwsid = v.pwsid AND s.system_type = 'COMMUNITY')")
def _(v):
    return v("tb_violations").join(v("tb_systems").filter("system_type = 'COMMUNITY'"), "pwsid", "left_semi").select("violation_id")


@query("jn04_anti_uncovered", "SELECT pwsid, name FROM tb_systems s WHERE NOT EXISTS (SELECT 1 FROM tb_violations v WHERE s.pwsid = v.pwsid AND v.status = 'OPEN' AND v.rule_code = 'R3')")
def _(v):
    return v("tb_systems").join(v("tb_violations").filter("status = 'OPEN' and rule_code = 'R3'"), "pwsid", "left_anti").select("pwsid", "name")


RECON = """WITH a AS (SELECT pwsid, rule_code, contaminant_code, year(begin_date) AS period, max(status) AS status FROM tb_violations WHERE category <> 'OTHER' GROUP BY ALL),
b AS (SELECT pwsid, rule_code, contaminant_code, year(begin_date) AS period, max(status) AS status FROM tb_violations WHERE category <> 'PUBLIC NOTICE' GROUP BY ALL),
d AS (SELECT coalesce(a.pwsid, b.pwsid) AS pwsid, coalesce(a.rule_code, b.rule_code) AS rule_code, coalesce(a.contaminant_code, b.contaminant_code) AS contaminant_code, CAST(coalesce(a.period, b.period) AS INT) AS period,
  a.status AS our_status, b.status AS their_status, CASE WHEN b.pwsid IS NULL THEN 'ours-only' WHEN a.pwsid IS NULL THEN 'theirs-only' WHEN a.status <> b.status THEN 'status-mismatch' END AS difference
  FROM a FULL JOIN b ON a.pwsid = b.pwsid AND a.rule_code = b.rule_code AND a.contaminant_code = b.contaminant_code AND a.period = b.period)
"""


def _sides(v):
    key = ["pwsid", "rule_code", "contaminant_code", "period"]
    rows = v("tb_violations").withColumn("period", F.year("begin_date"))
    side = lambda left_out: rows.filter(F.col("category") != left_out).groupBy(*key).agg(F.max("status").alias("status"))
    return evidence.reconcile(side("OTHER"), side("PUBLIC NOTICE"), key)


@query("jn05_reconcile", RECON + "SELECT *, CASE WHEN difference = 'theirs-only' THEN 'critical' ELSE 'high' END AS severity FROM d WHERE difference IS NOT NULL")
def _(v):
    return _sides(v)


@query("jn06_reconcile_by_period", RECON + "SELECT period, difference, count(*) AS n FROM d WHERE difference IS NOT NULL GROUP BY 1, 2")
def _(v):
    return _sides(v).groupBy("period", "difference").agg(F.count("*").alias("n"))


@query(
    "ag21_taxonomy",
    RECON + "SELECT CASE WHEN difference = 'theirs-only' THEN CASE WHEN rule_code IN ('R7', 'R8') THEN 'engine-gap' ELSE 'mismatch' END WHEN difference = 'ours-only' THEN 'regulator-lag' ELSE 'status-or-timing' END AS class, count(*) AS n FROM d WHERE difference IS NOT NULL GROUP BY 1",
)
def _(v):
    kind = F.when(F.col("difference") == "theirs-only", F.when(F.col("rule_code").isin("R7", "R8"), "engine-gap").otherwise("mismatch")).when(F.col("difference") == "ours-only", "regulator-lag").otherwise("status-or-timing")
    return _sides(v).groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "jn13_corroborate",
    f"""WITH m AS (SELECT DISTINCT rid, {KEY}, publisher, source_id, result, TRY_CAST(nullif(regexp_extract(result, '[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE) AS x FROM tb_samples),
    p AS (SELECT a.rid, b.publisher <> a.publisher AS other, b.publisher AS origin, b.publisher = a.publisher AND b.source_id <> a.source_id AS replica
      FROM m a JOIN m b ON a.pwsid = b.pwsid AND a.analyte = b.analyte AND a.location_code = b.location_code AND a.rid <> b.rid
      AND CASE WHEN a.x IS NULL OR b.x IS NULL THEN upper(a.result) = upper(b.result) ELSE abs(a.x - b.x) <= 0.02 * greatest(abs(a.x), abs(b.x), 1e-12) + 1e-9 END),
    n AS (SELECT rid, count(DISTINCT CASE WHEN other THEN origin END) AS others, count(CASE WHEN replica THEN 1 END) AS replicas FROM p GROUP BY 1)
    SELECT m.rid, CAST(1 + coalesce(others, 0) AS BIGINT) AS independent_origins, coalesce(replicas, 0) AS publisher_replicas, CASE WHEN others > 0 THEN 'confirmed-independent-sample' ELSE 'single-origin-sample' END AS factual_status FROM m LEFT JOIN n ON m.rid = n.rid""",
)
def _(v):
    rows = v("tb_samples").select("rid", "pwsid", "analyte", "location_code", "publisher", "source_id", "result")
    rows = rows.repartition("pwsid", "analyte", "location_code").distinct()  # the one shuffle: all that follows is within the key
    return evidence.corroborate(rows, ["pwsid", "analyte", "location_code"], "rid", "result", "publisher", "source_id")


@query(
    "jn14_accreditation",
    """SELECT s.lab_id, CASE WHEN l.lab IS NULL THEN 'unknown-lab' WHEN s.sample_date <= l.expires THEN 'accredited' ELSE 'expired' END AS tier, count(*) AS n FROM tb_samples s
       LEFT JOIN (SELECT concat('LAB', CAST(r_regionkey AS STRING)) AS lab, CAST(concat(CAST(1994 + 2 * r_regionkey AS STRING), '-06-30') AS DATE) AS expires FROM region) l ON s.lab_id = l.lab GROUP BY 1, 2""",
)
def _(v):
    labs = v("region").select(F.concat(F.lit("LAB"), "r_regionkey").alias("lab_id"), F.concat((1994 + 2 * F.col("r_regionkey")).cast("string"), F.lit("-06-30")).cast("date").alias("expires"))
    tier = F.when(F.col("expires").isNull(), "unknown-lab").when(F.col("sample_date") <= F.col("expires"), "accredited").otherwise("expired")
    return v("tb_samples").join(labs, "lab_id", "left").groupBy("lab_id", tier.alias("tier")).agg(F.count("*").alias("n"))


@query(
    "jn23_series_correlation",
    """WITH d AS (SELECT station_id, result_date, avg(value) AS x FROM tb_results GROUP BY 1, 2)
       SELECT a.station_id AS a, b.station_id AS b, count(*) AS days, round(corr(a.x, b.x), 5) AS r FROM d a JOIN d b ON a.result_date = b.result_date AND a.station_id < b.station_id GROUP BY 1, 2 HAVING count(*) >= 6 AND corr(a.x, b.x) >= 0.3""",
)
def _(v):
    found = stats.inferred_links(v("tb_results"), "station_id", "result_date", "value", least=0.3)
    return found.select("a", "b", "days", F.round("correlation", 5).alias("r"))


LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pwsid, analyte ORDER BY sample_date DESC, rid) AS k FROM {MEASURED} WHERE NOT censored) WHERE k = 1)"


@query(
    "jn24_peer_percentile",
    f"""WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pwsid, analyte ORDER BY sample_date DESC, rid) AS k FROM {MEASURED}) WHERE k = 1),
    p AS (SELECT a.pwsid, a.analyte, count(b.value) AS n, sum(CASE WHEN b.value < a.value THEN 1.0 WHEN b.value = a.value THEN 0.5 ELSE 0 END) / nullif(count(b.value), 0) AS share, median(b.value) AS md, min(b.value) AS lo, max(b.value) AS hi
      FROM t a LEFT JOIN t b ON a.analyte = b.analyte AND a.pwsid <> b.pwsid AND NOT b.censored AND abs(datediff('day', a.sample_date, b.sample_date)) <= 366 WHERE NOT a.censored GROUP BY 1, 2)
    SELECT t.pwsid, t.analyte, CASE WHEN censored THEN 'current-result-censored' WHEN n < 5 THEN 'insufficient-peer-coverage' ELSE 'comparable' END AS status, coalesce(n, 0) AS peer_count, CASE WHEN n >= 5 THEN round(share, 4) END AS percentile,
      CASE WHEN n < 5 THEN NULL WHEN share >= 0.9 THEN 'upper-decile' WHEN share >= 0.75 THEN 'upper-quartile' WHEN share <= 0.1 THEN 'lower-decile' WHEN share <= 0.25 THEN 'lower-quartile' WHEN n >= 5 THEN 'middle-half' END AS band,
      CASE WHEN n >= 5 THEN round(md, 4) END AS peer_median, CASE WHEN n >= 5 THEN round(lo, 4) END AS peer_min, CASE WHEN n >= 5 THEN round(hi, 4) END AS peer_max FROM t LEFT JOIN p ON t.pwsid = p.pwsid AND t.analyte = p.analyte""",
)
def _(v):
    rows = versions.latest(measured(v), ["pwsid", "analyte"], [F.col("sample_date").desc(), F.col("rid")])
    out = evidence.peer_percentile(rows, "pwsid", "analyte", "contaminant_group", "value", "censored", "sample_date")
    return out.select("pwsid", "analyte", "status", "peer_count", r("percentile"), "band", r("peer_median"), r("peer_min"), r("peer_max"))


@query("st04_keep_first", "SELECT violation_id FROM (SELECT violation_id, row_number() OVER (PARTITION BY pwsid, lower(category) ORDER BY begin_date, violation_id) AS k FROM tb_violations) WHERE k = 1")
def _(v):
    return versions.keep_first(v("tb_violations"), [F.col("pwsid"), F.lower("category")], [F.col("begin_date"), F.col("violation_id")]).select("violation_id")


@query("st_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT pwsid FROM tb_systems UNION SELECT pwsid FROM tb_violations) UNION ALL SELECT 'except', count(*) FROM (SELECT pwsid FROM tb_systems EXCEPT SELECT pwsid FROM tb_violations WHERE rule_code = 'R1') UNION ALL SELECT 'intersect', count(*) FROM (SELECT pwsid FROM tb_systems INTERSECT SELECT pwsid FROM tb_violations WHERE rule_code = 'R2')")
def _(v):
    s, x = v("tb_systems").select("pwsid"), v("tb_violations")
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return count(s.union(x.select("pwsid")).distinct(), "union").union(count(s.distinct().exceptAll(x.filter("rule_code = 'R1'").select("pwsid").distinct()), "except")).union(count(s.intersect(x.filter("rule_code = 'R2'").select("pwsid")), "intersect"))


# ---- compliance and aggregates ----------------------------------------------------------------------------------


@query(
    "ag01_summary",
    "SELECT count(*) AS records, count(DISTINCT pwsid) AS systems, count(DISTINCT analyte) AS analytes, string_agg(DISTINCT contaminant_group, ',' ORDER BY contaminant_group) AS groups FROM tb_samples",
)
def _(v):
    return v("tb_samples").agg(F.count("*").alias("records"), F.count_distinct("pwsid").alias("systems"), F.count_distinct("analyte").alias("analytes"), F.array_join(F.sort_array(F.collect_set("contaminant_group")), ",").alias("groups"))


@query(
    "ag06_compliance_p90",
    f"""SELECT pwsid, analyte, round(p90, 4) AS p90, samples, CASE WHEN p90 IS NULL THEN 'insufficient-data' WHEN p90 > CASE analyte WHEN 'LEAD' THEN 10.0 ELSE 1300.0 END THEN 'action-level-exceedance' ELSE 'below-action-level' END AS status, samples >= 5 AS claim_allowed FROM (
        SELECT pwsid, analyte, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90, count(value) AS samples FROM {MEASURED} WHERE analyte IN ('LEAD', 'COPPER') AND sample_type = 'TAP' GROUP BY 1, 2)""",
)
def _(v):
    return compliance.percentile_90(measured(v)).select("pwsid", "analyte", r("p90"), "samples", "status", "claim_allowed")


@query(
    "ag07_lraa",
    f"""WITH q AS (SELECT {KEY}, concat(CAST(year(sample_date) AS STRING), '-Q', CAST(quarter(sample_date) AS STRING)) AS quarter, avg(value) AS mean FROM {MEASURED} WHERE analyte = 'TOTAL THMS' GROUP BY ALL HAVING avg(value) IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY quarter DESC) AS k FROM q)
    SELECT {KEY}, round(avg(mean), 8) AS lraa, count(*) AS quarters, CASE WHEN count(*) < 4 THEN 'incomplete-window' WHEN avg(mean) > 80 THEN 'exceeds' ELSE 'within' END AS status FROM t WHERE k <= 4 GROUP BY {KEY}""",
)
def _(v):
    return compliance.locational_average(measured(v)).select("pwsid", "analyte", "location_code", r("lraa", 8), "quarters", "status")


@query(
    "ag08_raa",
    f"""SELECT {KEY}, round(avg(value), 8) AS raa, count(*) AS samples, CASE WHEN count(*) < 4 THEN 'incomplete-window' WHEN avg(value) > 30 THEN 'exceeds' ELSE 'within' END AS status FROM (
        SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY sample_date DESC, rid) AS k FROM {MEASURED} WHERE analyte = 'URANIUM' AND NOT censored) WHERE k <= 4 GROUP BY {KEY}""",
)
def _(v):
    return compliance.running_average(measured(v).filter("not censored"), [F.col("sample_date").desc(), F.col("rid")]).select("pwsid", "analyte", "location_code", r("raa", 8), "samples", "status")


@query(
    "ag09_confirmed",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY pwsid ORDER BY sample_date DESC, rid) AS k, max(sample_date) OVER (PARTITION BY pwsid) AS last FROM {MEASURED} WHERE analyte = 'NITRATE' AND value IS NOT NULL)
    SELECT pwsid, analyte, CAST(max(last) AS STRING) AS latest, round(max(CASE WHEN k = 1 THEN value END), 4) AS value, bool_or(sample_date <> last AND datediff('day', sample_date, last) <= 30 AND value > 10000) AS confirmation_found,
      CASE WHEN max(CASE WHEN k = 1 THEN value END) <= 10000 THEN 'below-mcl' WHEN bool_or(sample_date <> last AND datediff('day', sample_date, last) <= 30 AND value > 10000) THEN 'confirmed-exceedance' ELSE 'confirmation-required' END AS status FROM s GROUP BY 1, 2""",
)
def _(v):
    out = compliance.confirmed_exceedance(measured(v), [F.col("sample_date").desc(), F.col("rid")])
    return out.select("pwsid", "analyte", F.col("latest").cast("string").alias("latest"), r("value"), "confirmation_found", "status")


@query(
    "ag10_positives",
    """SELECT pwsid, CASE WHEN revision % 2 = 0 THEN 'E. COLI' ELSE 'TOTAL COLIFORM' END AS analyte, count(CASE WHEN unit = 'mg/L' THEN 1 END) AS positive_count, count(*) AS records,
       CASE WHEN count(CASE WHEN unit = 'mg/L' THEN 1 END) > 0 THEN 'assessment-or-condition-review-required' ELSE 'no-positive-records-in-input' END AS status FROM tb_samples WHERE analyte = 'ARSENIC' GROUP BY 1, 2""",
)
def _(v):
    rows = v("tb_samples").filter("analyte = 'ARSENIC'").select("pwsid", F.when(F.col("revision") % 2 == 0, "E. COLI").otherwise("TOTAL COLIFORM").alias("analyte"), F.when(F.col("unit") == "mg/L", "Present").otherwise("absent").alias("result"))
    return compliance.positives(rows, "result")


@query("ag10_screening", f"SELECT pwsid, analyte, round(value, 4) AS value, 'screening-result-only' AS status FROM (SELECT *, row_number() OVER (PARTITION BY pwsid, analyte ORDER BY sample_date DESC, rid) AS k FROM {MEASURED} WHERE analyte = 'ARSENIC' AND value IS NOT NULL) WHERE k = 1")
def _(v):
    return compliance.screening(measured(v), [F.col("sample_date").desc(), F.col("rid")]).select("pwsid", "analyte", r("value"), "status")


@query(
    "ag11_trailing_average",
    f"""SELECT pwsid, analyte, round(avg(coalesce(value, 0)), 8) AS raa, count(*) AS samples, count(*) >= 4 AS sufficient FROM (SELECT *, max(sample_date) OVER (PARTITION BY pwsid, analyte) AS last FROM {MEASURED}) WHERE datediff('day', sample_date, last) <= 365 GROUP BY 1, 2""",
)
def _(v):
    return compliance.trailing_average(measured(v), ["pwsid", "analyte"], "value", "sample_date").select("pwsid", "analyte", r("raa", 8), "samples", "sufficient")


@query(
    "ag12_hazard_index",
    f"""SELECT pwsid, round(sum(value / CASE analyte WHEN 'LEAD' THEN 10.0 WHEN 'COPPER' THEN 1300.0 WHEN 'ARSENIC' THEN 10.0 ELSE 30.0 END), 4) AS hazard_index, count(*) AS analytes, sum(value / CASE analyte WHEN 'LEAD' THEN 10.0 WHEN 'COPPER' THEN 1300.0 WHEN 'ARSENIC' THEN 10.0 ELSE 30.0 END) >= 1 AS exceeds
        FROM {LATEST} WHERE analyte IN ('LEAD', 'COPPER', 'ARSENIC', 'URANIUM') GROUP BY pwsid""",
)
def _(v):
    levels = {"LEAD": 10.0, "COPPER": 1300.0, "ARSENIC": 10.0, "URANIUM": 30.0}
    return compliance.hazard_index(measured(v), ["pwsid"], "analyte", "value", [F.col("sample_date").desc(), F.col("rid")], levels).select("pwsid", r("hazard_index"), "analytes", "exceeds")


@query(
    "ag13_effective_n",
    "SELECT pwsid, CAST(sum(m) AS BIGINT) AS raw, count(*) AS origins, CAST(sum(m) - count(*) AS BIGINT) AS replicas, round(sqrt(count(*) / sum(m)), 6) AS independence, round(pow(sum(m), 2) / sum(m * (1 + (m - 1) * 0.5)), 4) AS correlated_n FROM (SELECT pwsid, publisher, count(*) AS m FROM tb_samples GROUP BY 1, 2) GROUP BY pwsid",
)
def _(v):
    return evidence.effective_n(v("tb_samples"), ["pwsid"], "publisher").select("pwsid", "raw", "origins", "replicas", r("independence", 6), r("correlated_n"))


CELLS = f"(SELECT contaminant_group, analyte, concat(CAST(year(sample_date) AS STRING), '-Q', CAST(quarter(sample_date) AS STRING)) AS quarter, source_id, CASE sample_type WHEN 'TAP' THEN 'tap' WHEN 'ENTRY POINT' THEN 'treatment-entry' ELSE 'system' END AS scope, value, censored FROM {MEASURED})"
AXES = ["contaminant_group", "analyte", "quarter", "source_id", "scope"]


def _cells(v):
    rows = measured(v).withColumns({"quarter": M.year_quarter(F.col("sample_date")), "scope": M.granularity(F.col("sample_type"))})
    return evidence.coverage_cells(rows, AXES, "censored", "value")


@query("ag15_coverage_tensor", f"SELECT {', '.join(AXES)}, count(*) AS records, count(CASE WHEN NOT censored AND value > 0 THEN 1 END) AS detects, count(CASE WHEN censored THEN 1 END) AS non_detects, count(value) AS numeric FROM {CELLS} GROUP BY ALL")
def _(v):
    return _cells(v)


@query(
    "ag15_expected_groups",
    f"""SELECT e.contaminant_group, c.analytes, c.cells, c.latest_quarter, c.cells IS NOT NULL AS measured, coalesce(CAST(substr(c.latest_quarter, 1, 4) AS INT) >= 2000, false) AS recent FROM (SELECT unnest(['INOR', 'DBP', 'RAD', 'VOC', 'PFAS']) AS contaminant_group) e
        LEFT JOIN (SELECT contaminant_group, count(DISTINCT analyte) AS analytes, count(*) AS cells, max(quarter) AS latest_quarter FROM (SELECT DISTINCT {', '.join(AXES)} FROM {CELLS}) GROUP BY 1) c USING (contaminant_group)""",
)
def _(v):
    cells = _cells(v)
    expected = cells.sparkSession.createDataFrame([(g,) for g in ("INOR", "DBP", "RAD", "VOC", "PFAS")], "contaminant_group string")
    return evidence.expected_coverage(cells, expected, "contaminant_group", 2001)


@query(
    "ag15_cube",
    f"SELECT contaminant_group, scope, count(*) AS records, CAST(grouping(contaminant_group) * 2 + grouping(scope) AS BIGINT) AS level FROM {CELLS} GROUP BY CUBE (contaminant_group, scope)",
)
def _(v):
    rows = measured(v).withColumn("scope", M.granularity(F.col("sample_type")))
    return rows.cube("contaminant_group", "scope").agg(F.count("*").alias("records"), F.grouping_id().cast("long").alias("level"))


@query("ag19_calibration", "SELECT CAST(least(4, floor(confidence * 5)) AS INT) AS bin, count(*) AS n, round(avg(confidence), 5) AS mean_p, round(avg(CASE WHEN stance = 'support' THEN 1.0 ELSE 0.0 END), 5) AS observed FROM tb_claims GROUP BY 1")
def _(v):
    return evidence.buckets(v("tb_claims"), F.col("confidence"), F.col("stance") == "support").select("bin", "n", r("mean_p", 5), r("observed", 5))


@query(
    "ag20_reliability",
    "SELECT agent, 2.0 + sum(CASE WHEN stance = 'support' THEN 1.0 ELSE 0.0 END) AS alpha, 3.0 + sum(CASE WHEN stance = 'support' THEN 0.0 ELSE 1.0 END) AS beta, round((2.0 + sum(CASE WHEN stance = 'support' THEN 1.0 ELSE 0.0 END)) / (5.0 + count(*)), 6) AS mean FROM tb_claims GROUP BY agent",
)
def _(v):
    rows = v("tb_claims").select("agent", (F.col("stance") == "support").alias("correct"), F.lit(1.0).alias("weight"))
    priors = rows.select("agent").distinct().withColumns({"alpha": F.lit(2.0), "beta": F.lit(3.0)})
    return evidence.beta_posterior(rows, priors)


def _claims(v):
    return v("tb_claims").withColumn("origins", F.array("origin"))


def _weights(v):
    return v("tb_claims").select("agent").distinct().withColumn("weight", 0.5 + 0.1 * F.substring("agent", 6, 1).cast("int"))


TRUST = "(0.5 + 0.1 * CAST(substr(agent, 6, 1) AS INT))"
VERDICT = "CASE WHEN vetoed THEN 'rejected' WHEN support >= 0.62 AND support - oppose >= 0.12 THEN 'accepted' WHEN oppose >= 0.62 AND oppose - support >= 0.12 THEN 'rejected' ELSE 'undecided' END"


@query(
    "ag24_negotiate",
    f"""WITH c AS (SELECT *, CASE WHEN claim_id % 13 = 0 THEN concat('claim ', CAST(claim_id AS STRING)) ELSE origin END AS o FROM tb_claims),
    w AS (SELECT topic, proposition, stance, o, max(confidence * CASE WHEN agent = 'agent4' THEN 0.8 ELSE {TRUST} END) AS w FROM c GROUP BY 1, 2, 3, 4),
    s AS (SELECT topic, proposition, sum(CASE WHEN stance = 'support' THEN w ELSE 0 END) AS support, sum(CASE WHEN stance = 'oppose' THEN w ELSE 0 END) AS oppose, count(CASE WHEN stance = 'support' AND o NOT LIKE 'claim %' THEN 1 END) AS origins FROM w GROUP BY 1, 2),
    t AS (SELECT topic, proposition, bool_or(hard_veto AND stance = 'oppose') AS vetoed, count(*) AS claims, bool_or(stance = 'oppose') AS dissent FROM c GROUP BY 1, 2)
    SELECT s.topic, s.proposition, round(support, 6) AS support, round(oppose, 6) AS oppose, origins, claims, dissent, vetoed, round(support / (support + oppose + 1e-9), 6) AS confidence, {VERDICT} AS verdict FROM s JOIN t ON s.topic = t.topic AND s.proposition = t.proposition""",
)
def _(v):
    claims = v("tb_claims").withColumn("origins", F.when(F.col("claim_id") % 13 != 0, F.array("origin")))
    return evidence.negotiate(claims, _weights(v).filter("agent <> 'agent4'")).select("topic", "proposition", r("support", 6), r("oppose", 6), "origins", "claims", "dissent", "vetoed", r("confidence", 6), "verdict")


@query(
    "gr05_leave_one_out",
    f"""WITH c AS (SELECT *, confidence * {TRUST} AS cw FROM tb_claims), o AS (SELECT DISTINCT topic, origin AS left_out FROM c),
    x AS (SELECT c.topic, proposition, NULL AS left_out, stance, origin, cw, hard_veto FROM c UNION ALL SELECT c.topic, proposition, o.left_out, stance, origin, cw, hard_veto FROM c JOIN o ON c.topic = o.topic AND c.origin <> o.left_out),
    w AS (SELECT topic, proposition, left_out, stance, origin, max(cw) AS w FROM x GROUP BY ALL),
    s AS (SELECT topic, proposition, left_out, sum(CASE WHEN stance = 'support' THEN w ELSE 0 END) AS support, sum(CASE WHEN stance = 'oppose' THEN w ELSE 0 END) AS oppose FROM w GROUP BY ALL),
    t AS (SELECT topic, proposition, left_out, bool_or(hard_veto AND stance = 'oppose') AS vetoed FROM x GROUP BY ALL),
    u AS (SELECT s.topic, s.proposition, s.left_out, support / (support + oppose + 1e-9) AS confidence, {VERDICT} AS verdict FROM s JOIN t ON s.topic = t.topic AND s.proposition = t.proposition AND s.left_out IS NOT DISTINCT FROM t.left_out),
    b AS (SELECT * FROM u WHERE left_out IS NULL)
    SELECT b.topic, o.left_out, count(CASE WHEN coalesce(u.verdict, 'absent') <> b.verdict THEN 1 END) AS flips, round(sum(abs(coalesce(u.confidence, 0) - b.confidence)), 6) AS total_change, round(max(abs(coalesce(u.confidence, 0) - b.confidence)), 6) AS max_change
    FROM b JOIN o ON b.topic = o.topic LEFT JOIN u ON u.topic = b.topic AND u.proposition = b.proposition AND u.left_out = o.left_out GROUP BY 1, 2""",
)
def _(v):
    return evidence.leave_one_origin_out(_claims(v), _weights(v)).select("topic", "left_out", "flips", r("total_change", 6), r("max_change", 6))


@query(
    "gr04_cut_sets",
    """WITH c AS (SELECT concat('T', CAST(user_id AS STRING)) AS topic, event_type AS proposition, event_id % 3 = 0 AS against, concat('O', CAST(event_id % 7 AS STRING)) AS o FROM events),
    g AS (SELECT topic, proposition FROM c GROUP BY 1, 2 HAVING bool_or(against) AND bool_or(NOT against)), k AS (SELECT DISTINCT c.* FROM c JOIN g ON c.topic = g.topic AND c.proposition = g.proposition),
    n AS (SELECT DISTINCT topic, o FROM k), ng AS (SELECT topic, count(*) AS groups FROM g GROUP BY 1),
    s AS (SELECT topic, [o] AS cut FROM n UNION ALL SELECT a.topic, [a.o, b.o] FROM n a JOIN n b ON a.topic = b.topic AND a.o < b.o UNION ALL SELECT a.topic, [a.o, b.o, d.o] FROM n a JOIN n b ON a.topic = b.topic AND a.o < b.o JOIN n d ON a.topic = d.topic AND b.o < d.o),
    left_ AS (SELECT s.topic, s.cut, k.proposition, bool_or(k.against) AND bool_or(NOT k.against) AS still FROM s JOIN k ON s.topic = k.topic AND NOT list_contains(s.cut, k.o) GROUP BY 1, 2, 3),
    ok AS (SELECT s.topic, s.cut FROM s LEFT JOIN left_ l ON s.topic = l.topic AND s.cut = l.cut GROUP BY 1, 2 HAVING NOT coalesce(bool_or(l.still), false)),
    m AS (SELECT *, len(cut) AS size, min(len(cut)) OVER (PARTITION BY topic) AS least, row_number() OVER (PARTITION BY topic, len(cut) ORDER BY cut) AS i FROM ok)
    SELECT ng.topic, CASE WHEN m.cut IS NULL THEN 'cutset-exceeds-search-limit' ELSE 'computed' END AS status, CAST(groups AS INT) AS groups, CAST(size AS INT) AS cut_size, array_to_string(cut, ' ') AS cut FROM ng LEFT JOIN m ON ng.topic = m.topic AND size = least AND i <= 20""",
)
def _(v):
    claims = v("events").select(F.col("event_id").alias("claim_id"), F.concat(F.lit("T"), "user_id").alias("topic"), F.col("event_type").alias("proposition"), F.when(F.col("event_id") % 3 == 0, "oppose").otherwise("support").alias("stance"), F.array(F.concat(F.lit("O"), F.col("event_id") % 7)).alias("origins"))
    return evidence.cut_sets(claims).withColumn("cut", F.array_join("cut", " "))


GLOBAL_CLAIMS = "SELECT concat('T', CAST(user_id AS STRING)) AS topic, event_type AS proposition, event_id % 3 = 0 AS against, CASE WHEN event_id % 3 = 0 THEN concat('O', CAST(user_id % 3 AS STRING)) ELSE concat('O', CAST(3 + event_id % 8 AS STRING)) END AS o, concat('O', CAST(event_id % 4 AS STRING)) AS o2 FROM events"


@query(
    "gr04_cuts_over_all",
    f"""WITH c AS ({GLOBAL_CLAIMS}), g AS (SELECT topic, proposition FROM c GROUP BY 1, 2 HAVING bool_or(against) AND bool_or(NOT against)),
    k AS (SELECT DISTINCT topic, proposition, against, list_distinct([o, CASE WHEN against THEN o ELSE o2 END]) AS os FROM c JOIN g USING (topic, proposition)), n AS (SELECT DISTINCT unnest(os) AS o FROM k),
    s AS (SELECT [o] AS cut FROM n UNION ALL SELECT [a.o, b.o] FROM n a JOIN n b ON a.o < b.o UNION ALL SELECT [a.o, b.o, d.o] FROM n a JOIN n b ON a.o < b.o JOIN n d ON b.o < d.o),
    open_ AS (SELECT DISTINCT cut FROM (SELECT s.cut, topic, proposition FROM s JOIN k ON NOT list_has_any(s.cut, k.os) GROUP BY ALL HAVING bool_or(against) AND bool_or(NOT against))),
    m AS (SELECT cut, len(cut) AS size, min(len(cut)) OVER () AS least, row_number() OVER (PARTITION BY len(cut) ORDER BY cut) AS i FROM s ANTI JOIN open_ USING (cut))
    SELECT CASE WHEN m.cut IS NULL THEN 'cutset-exceeds-search-limit' ELSE 'computed' END AS status, groups, CAST(size AS INT) AS cut_size, array_to_string(cut, ' ') AS cut FROM (SELECT count(*) AS groups FROM g) LEFT JOIN m ON size = least AND i <= 20 WHERE groups > 0""",
)
def _(v):
    o = F.concat(F.lit("O"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 3).otherwise(3 + F.col("event_id") % 8))
    origins = F.when(F.col("event_id") % 3 == 0, F.array(o)).otherwise(F.array(o, F.concat(F.lit("O"), F.col("event_id") % 4)))
    claims = v("events").select(F.col("event_id").alias("claim_id"), F.concat(F.lit("T"), "user_id").alias("topic"), F.col("event_type").alias("proposition"), F.when(F.col("event_id") % 3 == 0, "oppose").otherwise("support").alias("stance"), origins.alias("origins"))
    return evidence.cut_sets_over_all(claims).withColumn("cut", F.array_join("cut", " "))


@query(
    "tk06_pareto",
    "SELECT claim_id, u, c FROM (SELECT event_id AS claim_id, round(value, 1) AS u, CAST(user_id % 97 AS DOUBLE) AS c FROM events) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT round(value, 1) AS u, CAST(user_id % 97 AS DOUBLE) AS c FROM events) b WHERE b.u >= a.u AND b.c <= a.c AND (b.u > a.u OR b.c < a.c))",
)
def _(v):
    rows = v("events").select(F.col("event_id").alias("claim_id"), F.round("value", 1).alias("u"), (F.col("user_id") % 97).cast("double").alias("c"))
    return evidence.pareto_front(rows, "u", "c", "claim_id")


@query("sa11_conformal", "SELECT topic, count(*) AS set_size, arg_max(claim_id, (confidence, claim_id)) AS top FROM tb_claims WHERE 1 - confidence <= 0.4 + 1e-12 GROUP BY topic")
def _(v):
    return evidence.prediction_set(v("tb_claims"), "topic", "claim_id", "confidence", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.33, 0.36, 0.38, 0.4])


# ---- statistics -------------------------------------------------------------------------------------------------

DAILY = "(SELECT station_id, result_date, avg(value) AS x FROM tb_results GROUP BY 1, 2)"


def _daily(v):
    return v("tb_results").groupBy("station_id", "result_date").agg(F.avg("value").alias("x"))


@query(
    "sa01_mann_kendall",
    f"""WITH d AS {DAILY}, s AS (SELECT a.station_id, CAST(sum(sign(b.x - a.x)) AS DOUBLE) AS s_stat FROM d a JOIN d b ON a.station_id = b.station_id AND a.result_date < b.result_date GROUP BY 1),
    n AS (SELECT station_id, count(*) AS n FROM d GROUP BY 1), z AS (SELECT n.station_id, CAST(n AS INT) AS n, coalesce(s_stat, 0.0) AS s_stat, n * (n - 1) * (2 * n + 5) / 18.0 AS va FROM n LEFT JOIN s ON n.station_id = s.station_id)
    SELECT station_id, n, s_stat, round(CASE WHEN va = 0 THEN 0 WHEN s_stat > 0 THEN (s_stat - 1) / sqrt(va) WHEN s_stat < 0 THEN (s_stat + 1) / sqrt(va) ELSE 0 END, 5) AS z,
    CASE WHEN va > 0 AND s_stat > 1 THEN 'increasing' WHEN va > 0 AND s_stat < -1 THEN 'decreasing' ELSE 'no-monotonic-direction' END AS direction FROM z""",
)
def _(v):
    return stats.mann_kendall(_daily(v), ["station_id"], F.col("result_date"), "x").select("station_id", "n", "s_stat", r("z", 5), "direction")


@query(
    "sa03_bh_fdr",
    """WITH p AS (SELECT station_id, least(1.0, avg(value) / 60) AS p FROM tb_results GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, station_id) AS rank, count(*) OVER () AS n FROM p)
    SELECT station_id, round(p, 6) AS p, CAST(rank AS INT) AS rank, round(least(1.0, min(p * n / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM k""",
)
def _(v):
    p = v("tb_results").groupBy("station_id").agg(F.least(F.lit(1.0), F.avg("value") / 60).alias("p"))
    return stats.benjamini_hochberg(p, "station_id", "p").select("station_id", r("p", 6), "rank", r("q", 6))


@query(
    "sa05_half_life",
    f"""WITH d AS {DAILY}, l AS (SELECT *, lag(x) OVER w AS y, lag(result_date) OVER w AS pd FROM d WINDOW w AS (PARTITION BY station_id ORDER BY result_date)),
    a AS (SELECT station_id, count(*) AS pairs, corr(x, y) AS rho, avg(datediff('day', pd, result_date)) AS mean_lag FROM l WHERE y IS NOT NULL GROUP BY 1)
    SELECT station_id, pairs, round(rho, 5) AS rho, round(mean_lag, 4) AS mean_lag, round(CASE WHEN pairs >= 3 AND rho > 0 AND rho < 1 AND mean_lag > 0 THEN -ln(2) * mean_lag / ln(CASE WHEN rho > 0 THEN rho END) END, 3) AS half_life_days FROM a""",
)
def _(v):
    return stats.half_life(_daily(v), ["station_id"], "result_date", "x").select("station_id", "pairs", r("rho", 5), r("mean_lag"), r("half_life_days", 3))


@query(
    "sa06_partial_pooling",
    """WITH g AS (SELECT station_id, count(value) AS n, avg(value) AS mean, coalesce(var_samp(value), 0) AS v FROM tb_results GROUP BY 1), a AS (SELECT avg(mean) AS grand, greatest(var_samp(mean) - avg(v / n), 1e-9) AS tau2 FROM g),
    w AS (SELECT g.*, grand, tau2, greatest(v, 1e-9) / n AS se2 FROM g, a)
    SELECT station_id, n, round(mean, 4) AS mean, round(tau2 / (tau2 + se2), 5) AS weight, round(tau2 / (tau2 + se2) * mean + (1 - tau2 / (tau2 + se2)) * grand, 4) AS pooled FROM w""",
)
def _(v):
    return stats.partial_pooling(v("tb_results"), "station_id", "value").select("station_id", "n", r("mean"), r("weight", 5), r("pooled"))


@query(
    "sa08_extreme_tail",
    """SELECT characteristic, exceedances, round(shape, 5) AS shape, round(greatest(m * (1 - shape), 1e-9), 4) AS scale FROM (SELECT *, greatest(-0.49, least(0.49, 0.5 * (1 - m * m / v))) AS shape FROM (
       SELECT characteristic, count(*) AS exceedances, avg(value - 20) AS m, var_samp(value - 20) AS v FROM tb_results WHERE value > 20 GROUP BY 1)) WHERE exceedances >= 8""",
)
def _(v):
    return stats.extreme_tail(v("tb_results"), ["characteristic"], "value", 20.0).select("characteristic", "exceedances", r("shape", 5), r("scale"))


@query("sa07_change_points")
def _(v):
    return stats.change_points(_daily(v), "station_id", "result_date", "x")


@query("sa04_order_statistics")
def _(v):
    return stats.order_statistics_fit(v("tb_results"), ["characteristic"], "value").select("characteristic", "detects", r("slope"), r("intercept"))


# ---- space and graphs -------------------------------------------------------------------------------------------

MILES = "2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))))"


@query(
    "jn08_nearest_k",
    f"SELECT address_id, station_id, round(miles, 5) AS miles, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY miles, station_id) AS k FROM (SELECT p.address_id, s.station_id, {MILES} AS miles FROM tb_points p, tb_stations s) WHERE miles <= 5) WHERE k <= 3",
)
def _(v):
    return spatial.nearest(v("tb_points"), v("tb_stations"), 5.0, 3, "address_id", "station_id").select("address_id", "station_id", r("miles", 5), "rank")


def _rings(v):
    corner = lambda a, b: F.array(a, F.col(b))
    near, far = F.lit(0.0), F.col("x1") - F.col("x0")  # exact decimals
    outer = F.array(corner(near, "y0"), corner(far, "y0"), corner(far, "y1"), corner(near, "y1"))
    mx, my = (F.col("x0") + F.col("x1")).cast("double") / 2, ((F.col("y0") + F.col("y1")) / 2).cast("double")
    # rows of points lie on the hole's edge, so it is told by offsets from its middle, as in the SQL
    hole = F.array(*[F.array(F.lit(dx * 0.0203), F.lit(dy * 0.0203)) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    holes = F.when(F.col("has_hole"), F.array(at(mx, my))).otherwise(F.filter(F.array(at(mx, my)), lambda o: F.lit(False)))
    return v("tb_polygons").withColumns({"rings": F.when(F.col("has_hole"), F.array(outer, hole)).otherwise(F.array(outer)), "origin": at(F.col("x0"), F.lit(0.0)), "hole_origins": holes})


INSIDE = "p.lon > g.x0 AND p.lon < g.x1 AND p.lat > g.y0 AND p.lat < g.y1 AND NOT (g.has_hole AND abs(p.lon - (g.x0 + g.x1) / 2) < 0.0203 AND abs(p.lat - (g.y0 + g.y1) / 2) < 0.0203)"


@query("jn07_point_in_polygon", f"SELECT p.address_id, g.feature_id FROM tb_points p JOIN tb_polygons g ON {INSIDE}")
def _(v):
    return spatial.point_polygon_join(v("tb_points"), _rings(v)).select("address_id", "feature_id")


SIDES = "least((p.lon - g.x0) * 111320.0 * cos(radians(p.lat)), (g.x1 - p.lon) * 111320.0 * cos(radians(p.lat)), (p.lat - g.y0) * 110540.0, (g.y1 - p.lat) * 110540.0)"
# the square hole: distance to it along each axis, then as the crow flies
HOLE_X, HOLE_Y = "greatest(abs(p.lon - (g.x0 + g.x1) / 2) - 0.0203, 0) * 111320.0 * cos(radians(p.lat))", "greatest(abs(p.lat - (g.y0 + g.y1) / 2) - 0.0203, 0) * 110540.0"
BOUNDARY = f"least({SIDES}, CASE WHEN g.has_hole THEN sqrt(pow({HOLE_X}, 2) + pow({HOLE_Y}, 2)) ELSE 1e18 END)"


@query("sp02_boundary_distance", f"SELECT p.address_id, g.feature_id, round({BOUNDARY}, 3) AS metres FROM tb_points p JOIN tb_polygons g ON {INSIDE}")
def _(v):
    hit = spatial.point_polygon_join(v("tb_points"), _rings(v))
    return hit.select("address_id", "feature_id", F.round(spatial.to_boundary(F.col("rings"), F.col("lon"), F.col("lat"), spatial.origins_of(hit)), 3).alias("metres"))


@query(
    "sp03_ambiguity",
    f"""SELECT address_id, n AS polygons, n > 1 AS overlap, n = 0 AS gap, coalesce(m <= 75, false) AS near_boundary, round(m, 5) AS min_boundary_distance_m FROM (SELECT p.address_id, count(g.feature_id) AS n, min(CASE WHEN g.feature_id IS NOT NULL THEN {BOUNDARY} END) AS m FROM tb_points p LEFT JOIN tb_polygons g ON {INSIDE} GROUP BY 1)""",
)
def _(v):
    return spatial.ambiguity(v("tb_points"), _rings(v), "address_id").withColumn("min_boundary_distance_m", r("min_boundary_distance_m", 5))  # places are a thousandth of a degree apart: no value is halfway


@query("sp05_perturbation_stability")
def _(v):
    return spatial.polygon_stability(v("tb_points"), _rings(v), "address_id")


@query(
    "sa10_idw",
    f"""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY miles, station_id) AS k FROM (SELECT p.address_id, s.station_id, {MILES} AS miles FROM tb_points p, tb_stations s) WHERE miles <= 5) WHERE k <= 4),
    m AS (SELECT station_id, avg(value) AS x FROM tb_results GROUP BY 1)
    SELECT address_id, count(*) AS points, round(sum(x / pow(miles + 1e-3, 2)) / sum(1 / pow(miles + 1e-3, 2)), 4) AS estimate FROM n JOIN m ON n.station_id = m.station_id GROUP BY 1 HAVING count(*) >= 3""",
)
def _(v):
    near = spatial.nearest(v("tb_points"), v("tb_stations"), 5.0, 4, "address_id", "station_id")
    means = v("tb_results").groupBy("station_id").agg(F.avg("value").alias("x"))
    return stats.inverse_distance(near.join(means, "station_id"), "address_id", "x", "miles").select("address_id", "points", r("estimate"))


@query(
    "gr01_reachability",
    """WITH RECURSIVE e AS (SELECT src, dst, certainty FROM tb_edges WHERE (src + dst) % 5 <> 0),
    p AS (SELECT src AS origin, src AS node, 0 AS hops, CAST(1.0 AS DOUBLE) AS certainty, [src] AS path FROM (SELECT DISTINCT src FROM tb_edges WHERE src % 4 = 0)
    UNION ALL SELECT origin, node, hops, certainty, path FROM (SELECT p.origin, e.dst AS node, p.hops + 1 AS hops, p.certainty * e.certainty AS certainty, list_append(p.path, e.dst) AS path, row_number() OVER (PARTITION BY p.origin, e.dst ORDER BY list_append(p.path, e.dst)) AS k FROM p JOIN e ON p.node = e.src) WHERE k = 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY hops, path) AS k FROM p)
    SELECT origin, node, hops, round(certainty, 6) AS certainty, certainty >= 0.5 AS admissible FROM m WHERE k = 1""",
)
def _(v):
    day = lambda d: F.lit(d).cast("date")
    ended = (F.col("src") + F.col("dst")) % 5 == 0
    edges = v("tb_edges").withColumns({"valid_from": F.when(F.col("src") % 2 == 0, day("1990-01-01")), "valid_to": F.when(ended, day("1995-01-01"))})
    start = edges.filter("src % 4 = 0").select(F.col("src").alias("node")).distinct()
    return reachable(edges, start, day("1995-01-01")).select("origin", "node", "hops", r("certainty", 6), "admissible")
