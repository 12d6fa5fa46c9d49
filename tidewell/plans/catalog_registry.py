"""Queries over registries, rules and report-level choices; registered with the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import measure as M
from tidewell.functions import scores as S
from tidewell.functions import statistics as T
from tidewell.operators import registry, stats, versions
from tidewell.plans.catalog import MEASURED, measured, query, r

A = T.TAIL
Z = "((p_size - 25) / 10.0)"
P = f"(1.0 / (1 + {T.SCALE} * abs({Z})))"
TAIL_SQL = f"({T.ROOT} * exp(-{Z} * {Z} / 2) * ({A[0]} * {P} + ({A[1]}) * pow({P}, 2) + {A[2]} * pow({P}, 3) + ({A[3]}) * pow({P}, 4) + {A[4]} * pow({P}, 5)))"


@query("fn39_normal_cdf", f"SELECT p_partkey, round(CASE WHEN {Z} >= 0 THEN 1 - {TAIL_SQL} ELSE {TAIL_SQL} END, 7) AS p FROM part")
def _(v):
    return v("part").select("p_partkey", F.round(T.normal_cdf((F.col("p_size") - 25) / F.lit(10.0)), 7).alias("p"))


@query(
    "fn47_interval",
    """SELECT p_partkey, m BETWEEN lo AND hi AS consistent, round((hi - lo) / 3.92, 6) AS sd, round(greatest(lo, m - (hi - lo) / 3.92 / sqrt(n)), 6) AS band_low, round(least(hi, m + (hi - lo) / 3.92 / sqrt(n)), 6) AS band_high
       FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS lo, CAST(p_size + p_partkey % 7 AS DOUBLE) AS m, CAST(p_size + p_partkey % 11 AS DOUBLE) AS hi, 1 + p_partkey % 9 AS n FROM part)""",
)
def _(v):
    k = F.col("p_partkey")
    rows = v("part").select(k, F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + k % 7).cast("double").alias("m"), (F.col("p_size") + k % 11).cast("double").alias("hi"), (1 + k % 9).alias("n"))
    return rows.select("p_partkey", T.interval_estimate(F.col("lo"), F.col("m"), F.col("hi"), F.col("n")).alias("e")).select("p_partkey", "e.consistent", F.round("e.sd", 6).alias("sd"), F.round("e.band_low", 6).alias("band_low"), F.round("e.band_high", 6).alias("band_high"))


@query("fn55_field_discovery", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'PROVIDER' WHEN 1 THEN 'UTILITY_NAME' ELSE 'LABEL' END AS key, n_name AS value, round(CASE n_nationkey % 3 WHEN 2 THEN 0.5 ELSE 1.0 END, 2) AS score FROM nation")
def _(v):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, "PROVIDER").when(k % 3 == 1, "UTILITY_NAME").otherwise("LABEL")
    props = F.create_map(F.lit("OBJECTID"), (10000 + k).cast("string"), name, F.col("n_name"), F.lit("ZZ_NOTE"), F.lit("seen"), F.lit("X"), F.lit("a"))
    out = registry.discover_field(v("nation").withColumn("props", props), "n_nationkey", "props", "(?i)provider|utility|owner", "NATION")
    return out.select("n_nationkey", "key", "value", F.round("score", 2).alias("score"))


CHAIN = """(SELECT CAST(3590000 + s_suppkey AS STRING) AS successor, CAST(3590000 + (s_suppkey * 7) % 100 AS STRING) AS predecessor, CAST(3590000 + (s_suppkey * 13) % 90 AS STRING) AS alias,
  CAST(concat(CAST(1992 + s_suppkey % 8 AS STRING), '-01-01') AS DATE) AS valid_from, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(concat(CAST(1996 + s_suppkey % 8 AS STRING), '-01-01') AS DATE) END AS valid_to FROM supplier)"""


@query(
    "jn11_lineage",
    f"""SELECT DISTINCT s.pwsid, c.successor, c.predecessor, c.alias FROM tb_systems s JOIN {CHAIN} c ON s.pwsid IN (c.successor, c.predecessor, c.alias) AND c.valid_from <= DATE '1998-06-01' AND (c.valid_to IS NULL OR c.valid_to >= DATE '1998-06-01')""",
)
def _(v):
    k = F.col("s_suppkey")
    day = lambda y: F.concat(y.cast("string"), F.lit("-01-01")).cast("date")
    chain = v("supplier").select((3590000 + k).cast("string").alias("successor"), (3590000 + (k * 7) % 100).cast("string").alias("predecessor"), (3590000 + (k * 13) % 90).cast("string").alias("alias"), day(1992 + k % 8).alias("valid_from"), F.when(k % 4 != 0, day(1996 + k % 8)).alias("valid_to"))
    return registry.lineage(v("tb_systems"), chain, F.lit("1998-06-01").cast("date")).select("pwsid", "successor", "predecessor", "alias").distinct()


@query(
    "jn19_small_system",
    """WITH e AS (SELECT c_custkey, c_nationkey AS cand, 100 AS pts FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, (c_nationkey + c_custkey % 2) % 25, 45 FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT c_custkey, (c_nationkey + c_custkey % 3) % 25, 95 FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, c_nationkey, 10 FROM customer),
    t AS (SELECT c_custkey, cand, sum(pts) AS total FROM e GROUP BY 1, 2), k AS (SELECT *, lead(total) OVER w AS second, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY c_custkey ORDER BY total DESC, cand DESC))
    SELECT c_custkey, CAST(total AS BIGINT) AS total, CASE WHEN total < 70 THEN 'unresolved' WHEN total - coalesce(second, 0) < 20 THEN 'tie' ELSE 'resolved' END AS status FROM k WHERE n = 1""",
)
def _(v):
    c, k, n = v("customer"), F.col("c_custkey"), F.col("c_nationkey")
    part = lambda keep, cand, pts: c.filter(keep).select(k, cand.cast("long").alias("cand"), F.lit(pts).alias("pts"))
    rows = part(k % 5 == 0, n, 100).union(part(k % 3 == 0, (n + k % 2) % 25, 45)).union(part(k % 7 == 0, (n + k % 3) % 25, 95)).union(part(F.lit(True), n, 10))
    return registry.resolve_by_points(rows, "c_custkey", "cand", "pts")


@query(
    "jn25_source_fallback",
    "SELECT s.rid, coalesce(r.r_name, 'AFRICA') AS source_name, count(*) AS n FROM tb_samples s LEFT JOIN (SELECT concat('SRC', CAST(r_regionkey AS STRING)) AS source_id, r_name FROM region WHERE r_regionkey < 3) r ON s.source_id = r.source_id GROUP BY 1, 2",
)
def _(v):
    reg = v("region").filter("r_regionkey < 3").select(F.concat(F.lit("SRC"), "r_regionkey").alias("source_id"), F.col("r_name").alias("source_name"))
    return registry.with_fallback(v("tb_samples").select("rid", "source_id"), reg, "source_id", "SRC0").groupBy("rid", "source_name").agg(F.count("*").alias("n"))


@query(
    "jn27_registry_merge",
    """WITH a AS (SELECT pwsid, CASE WHEN population > 3000 THEN name END AS name, CAST(NULL AS STRING) AS city FROM tb_systems WHERE pwsid <> '3590007'), b AS (SELECT pwsid, concat('record ', name) AS name, city FROM tb_systems)
    SELECT coalesce(a.pwsid, b.pwsid) AS pwsid, coalesce(a.name, b.name) AS name, coalesce(a.city, b.city) AS city FROM a FULL JOIN b ON a.pwsid = b.pwsid""",
)
def _(v):
    s = v("tb_systems")
    base = s.filter("pwsid <> '3590007'").select("pwsid", F.when(F.col("population") > 3000, F.col("name")).alias("name"))
    return registry.merge([base, s.select("pwsid", F.concat(F.lit("record "), "name").alias("name"), "city")], "pwsid", ["name", "city"])


@query(
    "ag17_audit",
    """WITH c AS (SELECT analyte, count(*) AS rows_, CAST(sum(CASE WHEN sample_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_fields, CAST(sum(CASE WHEN source_id = 'SRC3' THEN 1 ELSE 0 END) AS BIGINT) AS unknown_source FROM tb_samples GROUP BY 1),
    d AS (SELECT analyte, CAST(sum(n - 1) AS BIGINT) AS duplicate_keys FROM (SELECT analyte, pwsid, location_code, sample_date, count(*) AS n FROM tb_samples GROUP BY ALL) GROUP BY 1) SELECT c.*, duplicate_keys FROM c JOIN d ON c.analyte = d.analyte""",
)
def _(v):
    known = v("region").filter("r_regionkey < 3").select(F.concat(F.lit("SRC"), "r_regionkey").alias("source_id"))
    return registry.audit(v("tb_samples"), "analyte", ["sample_id", "pwsid"], ["analyte", "pwsid", "location_code", "sample_date"], known, "source_id")


@query("ag03_federal_summary", "SELECT (SELECT count(*) FROM tb_violations) AS violations, (SELECT count(*) FROM tb_violations WHERE status = 'OPEN') AS active, (SELECT count(*) FROM (SELECT pwsid FROM tb_violations UNION SELECT pwsid FROM tb_samples UNION SELECT pwsid FROM tb_systems)) AS systems")
def _(v):
    ids = v("tb_violations").select("pwsid").union(v("tb_samples").select("pwsid")).union(v("tb_systems").select("pwsid")).agg(F.count_distinct("pwsid").alias("systems"))
    return v("tb_violations").agg(F.count("*").alias("violations"), F.count_if(F.col("status") == "OPEN").alias("active")).crossJoin(F.broadcast(ids))  # one row each


@query(
    "ag29_strategic_sampling",
    f"""SELECT pwsid, round(avg(CASE WHEN value BETWEEN 0.95 * 15000 AND 15000 THEN 1.0 ELSE 0.0 END), 6) AS limit_bunching, round(avg(CASE WHEN value BETWEEN mdl AND 1.05 * mdl THEN 1.0 ELSE 0.0 END), 6) AS mdl_bunching, round(avg(CASE WHEN censored THEN 1.0 ELSE 0.0 END), 6) AS censored_share FROM {MEASURED} GROUP BY pwsid""",
)
def _(v):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    x = F.col("value")
    return measured(v).groupBy("pwsid").agg(share(x.between(0.95 * 15000, 15000)).alias("limit_bunching"), share(x.between(F.col("mdl"), 1.05 * F.col("mdl"))).alias("mdl_bunching"), share(F.col("censored")).alias("censored_share"))


@query("ag31_manifest_hash")
def _(v):
    rows = v("tb_samples").select("pwsid", F.sha2("rid", 256).alias("fp")).distinct()
    return registry.manifest_hash(rows, "pwsid", "fp")


@query(
    "sa02_seasonal_kendall",
    """WITH d AS (SELECT pwsid, month(sample_date) AS m, year(sample_date) AS y, count(*) AS x FROM tb_samples GROUP BY ALL), s AS (SELECT a.pwsid, a.m, sum(sign(b.x - a.x)) AS s, count(*) AS pairs FROM d a JOIN d b ON a.pwsid = b.pwsid AND a.m = b.m AND a.y < b.y GROUP BY 1, 2)
    SELECT pwsid, CAST(sum(s) AS DOUBLE) AS s_stat, CAST(sum(pairs) AS BIGINT) AS pairs, CASE WHEN sum(pairs) < 6 THEN 'insufficient' WHEN sum(s) > 0 THEN 'increasing' WHEN sum(s) < 0 THEN 'decreasing' ELSE 'no-trend' END AS direction FROM s GROUP BY 1""",
)
def _(v):
    d = v("tb_samples").groupBy("pwsid", F.month("sample_date").alias("m"), F.year("sample_date").alias("y")).agg(F.count("*").alias("x"))
    return stats.seasonal_kendall(d, ["pwsid"], "m", F.col("y"), "x")


@query(
    "sa15_applicability",
    """SELECT scope, count(*) AS n, round(avg(score), 6) AS mean, count(CASE WHEN score >= 0.5 THEN 1 END) AS eligible FROM (SELECT scope, CASE WHEN scope = 'system' THEN least(0.15, g) ELSE g END AS score FROM (
       SELECT CASE sample_type WHEN 'TAP' THEN 'tap' WHEN 'ENTRY POINT' THEN 'treatment-entry' ELSE 'system' END AS scope,
         exp((ln(greatest(0.05, least(1.0, pow(0.5, greatest(datediff('day', sample_date, DATE '2002-01-01'), 0) / 365.0)))) + ln(CASE WHEN sample_id IS NOT NULL THEN 0.83 ELSE 0.65 END) + ln(CASE lab_id WHEN 'LAB0' THEN 1.0 WHEN 'LAB1' THEN 0.35 ELSE 0.72 END)) / 3) AS g FROM tb_samples)) GROUP BY 1""",
)
def _(v):
    scope = M.granularity(F.col("sample_type"))
    temporal = S.clamp(S.freshness(F.datediff(F.lit("2002-01-01").cast("date"), "sample_date"), 365.0), 0.05, 1.0)
    provenance = F.when(F.col("sample_id").isNotNull(), 0.83).otherwise(0.65)
    lab = F.when(F.col("lab_id") == "LAB0", 1.0).when(F.col("lab_id") == "LAB1", 0.35).otherwise(0.72)
    g = S.geometric_mean(temporal, provenance, lab)
    rows = v("tb_samples").select(scope.alias("scope"), F.when(scope == "system", F.least(F.lit(0.15), g)).otherwise(g).alias("score"))
    return rows.groupBy("scope").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("score") >= 0.5).alias("eligible"))


# Planner rules as flip probability, gain, severity and effort.
PLANNER = {"utility-confirmation": (0.75, 0.45, 0.9, 0.35), "household-sample": (0.65, 0.5, 1.0, 0.8), "lab-accreditation": (0.25, 0.25, 0.55, 0.25), "violation-resolution": (0.7, 0.35, 0.9, 0.25)}


@query(
    "sa19_planner",
    """WITH x AS (SELECT pwsid, count(CASE WHEN status = 'OPEN' THEN 1 END) AS open_, count(*) AS n FROM tb_violations GROUP BY 1),
    a AS (SELECT pwsid, 'violation-resolution' AS action, round(0.7 * 0.35 * 0.9 / 0.25, 6) AS priority FROM x WHERE open_ > 0 UNION ALL SELECT pwsid, 'utility-confirmation', round(0.75 * 0.45 * 0.9 / 0.35, 6) FROM x WHERE n % 2 = 0
      UNION ALL SELECT pwsid, 'household-sample', round(0.65 * 0.5 * 1.0 / 0.8, 6) FROM x UNION ALL SELECT pwsid, 'lab-accreditation', round(0.25 * 0.25 * 0.55 / 0.25, 6) FROM x WHERE n % 3 = 0)
    SELECT pwsid, action, priority FROM (SELECT *, row_number() OVER (PARTITION BY pwsid ORDER BY priority DESC, action) AS k FROM a) WHERE k <= 3""",
)
def _(v):
    x = v("tb_violations").groupBy("pwsid").agg(F.count_if(F.col("status") == "OPEN").alias("open_"), F.count("*").alias("n"))
    holds = {"violation-resolution": F.col("open_") > 0, "utility-confirmation": F.col("n") % 2 == 0, "household-sample": F.lit(True), "lab-accreditation": F.col("n") % 3 == 0}
    rules = F.array(*[F.when(holds[a], F.struct(F.lit(a).alias("action"), F.lit(round(f * g * s / max(0.1, e), 6)).alias("priority"))) for a, (f, g, s, e) in PLANNER.items()])
    each = x.select("pwsid", F.explode(F.filter(rules, lambda q: q.isNotNull())).alias("q")).select("pwsid", "q.action", "q.priority")
    return versions.latest(each, ["pwsid"], [F.col("priority").desc(), F.col("action")], 3)


@query(
    "gr03_pathway",
    """WITH e AS (SELECT pwsid, CASE WHEN bool_or(sample_type = 'ENTRY POINT') THEN 0.8 ELSE 0.35 END AS e1, CASE WHEN count(DISTINCT location_code) > 5 THEN 0.85 ELSE 0.45 END AS e2, CASE WHEN bool_or(sample_type = 'DISTRIBUTION') THEN 1.0 ELSE 0.1 END AS e3, CASE WHEN bool_or(sample_type = 'TAP' AND sample_id IS NOT NULL) THEN 1.0 ELSE 0.2 END AS e4 FROM tb_samples GROUP BY 1)
    SELECT pwsid, least(e1, e2, e3, e4) AS certainty, CASE least(e1, e2, e3, e4) WHEN e1 THEN 'source-treatment' WHEN e2 THEN 'treatment-distribution' WHEN e3 THEN 'distribution-area' ELSE 'premise-tap' END AS bottleneck, least(e1, e2, e3) >= 0.45 AS system_path FROM e""",
)
def _(v):
    has = lambda c: F.bool_or(c)
    e = v("tb_samples").groupBy("pwsid").agg(
        F.when(has(F.col("sample_type") == "ENTRY POINT"), 0.8).otherwise(0.35).alias("e1"), F.when(F.count_distinct("location_code") > 5, 0.85).otherwise(0.45).alias("e2"),
        F.when(has(F.col("sample_type") == "DISTRIBUTION"), 1.0).otherwise(0.1).alias("e3"), F.when(has((F.col("sample_type") == "TAP") & F.col("sample_id").isNotNull()), 1.0).otherwise(0.2).alias("e4"),
    )
    edges = F.array(*[F.struct(F.col(c).alias("certainty"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (c, n) in enumerate((("e1", "source-treatment"), ("e2", "treatment-distribution"), ("e3", "distribution-area"), ("e4", "premise-tap")))])
    low = F.array_min(edges)
    return e.select("pwsid", low["certainty"].alias("certainty"), low["name"].alias("bottleneck"), (F.least("e1", "e2", "e3") >= 0.45).alias("system_path"))


@query(
    "rp04_contradictions",
    """SELECT pwsid, labs = 1 AS single_lab, sources > 3 AS many_sources, nd > 0 AND det > 0 AS mixed_detection, CAST(labs = 1 AS INT) + CAST(sources > 3 AS INT) + CAST(nd > 0 AND det > 0 AS INT) AS contradictions,
       round(greatest(0.25, 1 / (1 + 0.35 * (CAST(labs = 1 AS INT) + CAST(sources > 3 AS INT) + CAST(nd > 0 AND det > 0 AS INT)))), 6) AS conflict
       FROM (SELECT pwsid, count(DISTINCT lab_id) AS labs, count(DISTINCT source_id) AS sources, count(CASE WHEN result = 'ND' THEN 1 END) AS nd, count(CASE WHEN result <> 'ND' THEN 1 END) AS det FROM tb_samples GROUP BY 1)""",
)
def _(v):
    x = v("tb_samples").groupBy("pwsid").agg(F.count_distinct("lab_id").alias("labs"), F.count_distinct("source_id").alias("sources"), F.count_if(F.col("result") == "ND").alias("nd"), F.count_if(F.col("result") != "ND").alias("det"))
    x = x.select("pwsid", (F.col("labs") == 1).alias("single_lab"), (F.col("sources") > 3).alias("many_sources"), ((F.col("nd") > 0) & (F.col("det") > 0)).alias("mixed_detection"))
    n = sum((F.col(c).cast("int") for c in ("single_lab", "many_sources", "mixed_detection")), F.lit(0))
    return x.withColumn("contradictions", n).withColumn("conflict", F.round(F.greatest(F.lit(0.25), 1 / (1 + 0.35 * F.col("contradictions"))), 6))


RULED = """(SELECT s.rid, s.value, r.threshold, CASE WHEN s.value > r.threshold THEN 'exceeds' ELSE 'within' END AS status FROM (SELECT DISTINCT rid, analyte, sample_date, value FROM {m} WHERE value IS NOT NULL) s JOIN tb_rules r ON s.analyte = r.analyte
  AND r.valid_from <= DATE '{at}' AND (r.valid_to IS NULL OR DATE '{at}' < r.valid_to))"""


@query("rp09_rule_versions", f"SELECT a.status AS before, b.status AS after, count(*) AS n FROM {RULED.format(m=MEASURED, at='1991-06-01')} a JOIN {RULED.format(m=MEASURED, at='1994-06-01')} b ON a.rid = b.rid GROUP BY 1, 2")
def _(v):
    rows = measured(v).filter("value is not null").select("rid", "analyte", "sample_date", "value").distinct()

    def under(day: str, name: str):
        rules = v("tb_rules").filter(versions.valid_at(F.lit(day).cast("date"), F.col("valid_from"), F.col("valid_to"))).select("analyte", "threshold")
        return rows.join(rules, "analyte").select("rid", F.when(F.col("value") > F.col("threshold"), "exceeds").otherwise("within").alias(name))

    return under("1991-06-01", "before").join(under("1994-06-01", "after"), "rid").groupBy("before", "after").agg(F.count("*").alias("n"))


@query(
    "wn12_unanimous_prefix",
    """WITH d AS (SELECT station_id, result_date, avg(value) > 20 AS ok FROM tb_results GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY result_date) AS n, min(CAST(ok AS INT)) OVER (PARTITION BY station_id ORDER BY result_date ROWS UNBOUNDED PRECEDING) AS so_far FROM d)
    SELECT station_id, CAST(coalesce(max(CASE WHEN so_far = 1 THEN n END), 0) AS INT) AS prefix FROM k GROUP BY 1""",
)
def _(v):
    d = v("tb_results").groupBy("station_id", "result_date").agg((F.avg("value") > 20).alias("ok"))
    w = Window.partitionBy("station_id").orderBy("result_date")
    k = d.withColumns({"n": F.row_number().over(w), "so_far": F.min(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return k.groupBy("station_id").agg(F.coalesce(F.max(F.when(F.col("so_far") == 1, F.col("n"))), F.lit(0)).alias("prefix"))


@query("jn22_rain_lookback", "SELECT a.station_id, CAST(a.result_date AS STRING) AS day, round(sum(b.rain), 6) AS rain_7 FROM (SELECT station_id, result_date, sum(value) AS rain FROM tb_results GROUP BY 1, 2) a JOIN (SELECT station_id, result_date, sum(value) AS rain FROM tb_results GROUP BY 1, 2) b ON a.station_id = b.station_id AND datediff('day', b.result_date, a.result_date) BETWEEN 1 AND 7 GROUP BY 1, 2")
def _(v):
    d = v("tb_results").groupBy("station_id", "result_date").agg(F.sum("value").alias("rain"))
    w = Window.partitionBy("station_id").orderBy(F.unix_date("result_date")).rangeBetween(-7, -1)
    return d.withColumn("rain_7", F.round(F.sum("rain").over(w), 6)).filter("rain_7 is not null").select("station_id", F.col("result_date").cast("string").alias("day"), "rain_7")


@query(
    "jn12_blend",
    f"""SELECT successor, predecessor, round(w / sum(w) OVER (PARTITION BY successor), 6) AS share FROM (SELECT successor, predecessor, CASE WHEN CAST(predecessor AS INT) % 3 = 0 THEN 1.0 ELSE 0.5 END AS w
        FROM {CHAIN} c WHERE valid_from <= DATE '1998-06-01' AND (valid_to IS NULL OR valid_to >= DATE '1998-06-01'))""",
)
def _(v):
    k = F.col("s_suppkey")
    day = lambda y: F.concat(y.cast("string"), F.lit("-01-01")).cast("date")
    pre = 3590000 + (k * 7) % 100
    rows = v("supplier").select((3590000 + k).cast("string").alias("successor"), pre.cast("string").alias("predecessor"), F.when(pre % 3 != 0, 0.5).alias("blend"), day(1992 + k % 8).alias("valid_from"), F.when(k % 4 != 0, day(1996 + k % 8)).alias("valid_to"))
    return registry.blend(rows, "successor", "blend", F.lit("1998-06-01").cast("date")).select("successor", "predecessor", F.round("share", 6).alias("share"))


@query(
    "jn26_locality",
    """WITH m AS (SELECT c_custkey, s.pwsid, count(*) OVER (PARTITION BY c_custkey) AS members FROM (SELECT c_custkey, concat('TOWN OF NATION_', CAST(c_nationkey AS STRING), ' ') AS place FROM customer WHERE c_custkey % 10 = 0) c
      JOIN tb_systems s ON contains(c.place, concat(s.city, ' ')) AND s.system_type = 'COMMUNITY') SELECT c_custkey, pwsid FROM m WHERE members = 1""".replace(" WHERE c_custkey % 10 = 0", ""),
)
def _(v):
    places = v("customer").select("c_custkey", F.concat(F.lit("TOWN OF NATION_"), "c_nationkey").alias("place"))
    return registry.only_member(places, v("tb_systems").filter("system_type = 'COMMUNITY'").select("pwsid", "city"), "c_custkey", "place", "city").select("c_custkey", "pwsid")


@query("ag28_alias_map", "SELECT label, count(DISTINCT pwsid) AS systems FROM (SELECT upper(name) AS label, pwsid FROM tb_systems UNION ALL SELECT upper(city), pwsid FROM tb_systems UNION ALL SELECT system_type, pwsid FROM tb_systems) GROUP BY 1")
def _(v):
    return v("tb_systems").unpivot("pwsid", ["name", "city", "system_type"], "kind", "label").groupBy(F.upper("label").alias("label")).agg(F.count_distinct("pwsid").alias("systems"))


@query(
    "rp03_claims",
    """WITH x AS (SELECT pwsid, count(DISTINCT lab_id) AS labs, count(CASE WHEN result = 'ND' THEN 1 END) AS nd, count(*) AS n FROM tb_samples GROUP BY 1)
    SELECT pwsid, 'boundary' AS topic, CASE WHEN n % 4 <> 0 THEN 'support' ELSE 'oppose' END AS stance, 0.9 AS confidence, false AS hard_veto FROM x
    UNION ALL SELECT pwsid, 'independence', 'support', CASE WHEN labs > 1 THEN 1.0 ELSE 0.7 END, false FROM x UNION ALL SELECT pwsid, 'contradiction', 'oppose', least(1.0, 0.55 + 0.05 * (nd % 10)), nd % 10 = 9 FROM x WHERE nd > 0""",
)
def _(v):
    x = v("tb_samples").groupBy("pwsid").agg(F.count_distinct("lab_id").alias("labs"), F.count_if(F.col("result") == "ND").alias("nd"), F.count("*").alias("n"))
    claim = lambda topic, stance, confidence, veto: F.struct(F.lit(topic).alias("topic"), stance.alias("stance"), confidence.cast("double").alias("confidence"), veto.alias("hard_veto"))
    no, tens = F.lit(False), F.col("nd") % 10
    claims = F.array(
        claim("boundary", F.when(F.col("n") % 4 != 0, "support").otherwise("oppose"), F.lit(0.9), no), claim("independence", F.lit("support"), F.when(F.col("labs") > 1, 1.0).otherwise(0.7), no),
        F.when(F.col("nd") > 0, claim("contradiction", F.lit("oppose"), F.least(F.lit(1.0), 0.55 + 0.05 * tens), tens == 9)),
    )
    return x.select("pwsid", F.inline(F.filter(claims, lambda c: c.isNotNull())))


@query(
    "rp05_status",
    """SELECT violation_id, CASE WHEN s.pwsid IS NULL THEN 'provider-not-resolved' WHEN status = 'OPEN' AND category = 'MCL EXCEEDED' THEN 'health' WHEN status = 'OPEN' THEN 'watch' ELSE 'clear' END AS level,
       CASE WHEN s.population > 5000 THEN 'very-high' WHEN s.population > 0 THEN 'moderate' ELSE 'insufficient' END AS confidence FROM tb_violations v LEFT JOIN tb_systems s ON v.pwsid = s.pwsid""",
)
def _(v):
    rows = v("tb_violations").join(v("tb_systems").select("pwsid", "population", F.lit(True).alias("known")), "pwsid", "left")
    is_open = F.col("status") == "OPEN"
    level = F.when(F.col("known").isNull(), "provider-not-resolved").when(is_open & (F.col("category") == "MCL EXCEEDED"), "health").when(is_open, "watch").otherwise("clear")
    return rows.select("violation_id", level.alias("level"), F.when(F.col("population") > 5000, "very-high").when(F.col("population") > 0, "moderate").otherwise("insufficient").alias("confidence"))


@query("sa09_ridge_residuals")
def _(v):
    from tidewell.operators.stats import ridge_residuals

    d = v("tb_results").groupBy("station_id", "result_date").agg(F.avg("value").alias("x"), F.sum("value").alias("rain"))
    w = Window.partitionBy("station_id").orderBy(F.unix_date("result_date"))
    lags = {f"lag_{n}": F.coalesce(F.sum("rain").over(w.rangeBetween(-n, -1)), F.lit(0.0)) for n in (1, 3, 7)}
    return ridge_residuals(d.withColumns(lags), "station_id", "result_date", "x", list(lags))
