"""Queries over records, PFAS results, evidence items and loose sources; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import measure as M
from tidewell.functions import pfas as P
from tidewell.functions import records as R
from tidewell.functions import statistics as T
from tidewell.operators import records as O
from tidewell.operators import certify, resolve, stats
from tidewell.plans.catalog import MEASURED, measured, query, r
from tidewell.plans.testbed import VIEWS
from tidewell.sources import readers

#: Limits of the tests' PFAS results, in ng/L, and names that stand for a compound.
LEVELS = {"PFOA": 4.0, "PFOS": 4.0, "PFHxS": 10.0, "PFNA": 10.0, "HFPO-DA": 10.0}
SYNONYMS = {"HFPO-DA": ["GEN X ACID"]}

VIEWS |= {
    "tb_pfas": """
SELECT p_partkey AS result_id, CAST(3590000 + p_partkey % 100 AS STRING) AS pwsid, CASE p_partkey % 9 WHEN 0 THEN 'pfoa' WHEN 1 THEN 'Perfluorooctane sulfonic acid' WHEN 2 THEN 'PERFLUOROHEXANESULFONIC ACID' WHEN 3 THEN 'Gen X acid (dimer)'
    WHEN 4 THEN 'N-methyl perfluorooctanesulfonamidoacetic acid' WHEN 5 THEN '6:2 Fluorotelomer sulfonic acid' WHEN 6 THEN ' PFXYZ ' WHEN 7 THEN 'Chloride' ELSE 'perfluorobutanoic  acid' END AS name,
  CASE p_partkey % 7 WHEN 0 THEN 'ND' WHEN 1 THEN '<4' WHEN 2 THEN '0' ELSE CAST(p_size AS STRING) END AS value,
  CASE p_partkey % 5 WHEN 0 THEN 'ng/L' WHEN 1 THEN 'ug/L' WHEN 2 THEN 'ppt' WHEN 3 THEN '' ELSE 'mg/l' END AS unit, CASE WHEN p_partkey % 13 = 0 THEN 'Not Detected' END AS condition FROM {part}""",
    "tb_items": """
SELECT c_custkey AS item_id, c_nationkey AS address_id, CASE c_custkey % 6 WHEN 0 THEN 'exact-address' WHEN 1 THEN 'street' WHEN 2 THEN 'neighborhood' WHEN 3 THEN 'affected-address-range' WHEN 4 THEN 'elsewhere' ELSE 'system-context' END AS scope,
  CAST(c_custkey % 17 AS DOUBLE) / 17 AS score, c_custkey % 3 <> 0 AS relevant,
  CASE c_custkey % 5 WHEN 0 THEN 'https://www.epa.gov/a' WHEN 1 THEN 'https://facebook.com/g' WHEN 2 THEN 'https://news.example/x' WHEN 3 THEN 'https://forum.example/y' ELSE '' END AS url,
  CASE c_custkey % 4 WHEN 0 THEN 'Sanford Public Works' WHEN 1 THEN 'Daily News' WHEN 2 THEN '' ELSE 'Lake HOA' END AS publisher, concat('Story on water ', CAST(c_custkey AS STRING)) AS title FROM {customer}""",
    "tb_reports": """
SELECT o_orderkey AS report_id, CAST(3590000 + o_custkey % 100 AS STRING) AS pwsid, CAST(1990 + o_orderkey % 8 AS INT) AS report_year, CAST(o_orderdate AS DATE) AS published_at, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS revised_at FROM {orders}""",
}


# ---- records ----------------------------------------------------------------------------------------------------


@query(
    "fn07_adapter",
    """SELECT pwsid, analyte, CAST(year(sample_date) AS STRING) AS source_year, source_family, result NOT LIKE '<%' AND result <> 'ND' AND CAST(replace(replace(result, '<', ''), 'ND', '0') AS DOUBLE) > 0
         AND CAST(replace(replace(result, '<', ''), 'ND', '0') AS DOUBLE) >= mdl AS detected, count(*) AS n, round(sum(mdl), 3) AS limits, min(location_code) AS first_point
       FROM (SELECT *, publisher AS source_family FROM tb_samples) GROUP BY ALL""",
)
def _(v):
    out = R.adapt(v("tb_samples").withColumn("sample_date", F.date_format("sample_date", "M/d/yyyy")))
    return out.groupBy("pwsid", "analyte", "source_year", "source_family", "detected").agg(F.count("*").alias("n"), F.round(F.sum("detection_limit"), 3).alias("limits"), F.min("sample_point").alias("first_point"))


@query(
    "fn09_concentration",
    """SELECT p_partkey, round(a / 1000, 6) AS in_mg, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(sign(a - b * 0.001) AS INT) END AS compared, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(a + b * 0.001, 6) END AS added
       FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_size AS DOUBLE) * (p_partkey % 5) * 500 AS b FROM part)""",
)
def _(v):
    k = F.col("p_partkey")
    rows = v("part").select(k, F.col("p_size").cast("double").alias("a"), (F.col("p_size").cast("double") * (k % 5) * 500).alias("b"), F.when(k % 3 == 0, "LEAD").otherwise("IRON").alias("of"))
    both = (F.col("a"), F.lit("µg/L"), F.lit("IRON"), F.col("b"), F.lit("ng/L"), F.col("of"))
    return rows.select(k, F.round(R.convert(F.col("a"), F.lit("ug/L"), "mg/L"), 6).alias("in_mg"), R.compare_concentrations(*both).alias("compared"), F.round(R.add_concentrations(*both), 6).alias("added"))


NUMBER_OF = "TRY_CAST(value AS DOUBLE)"
COMPOUND_OF = "CASE " + " ".join(f"WHEN n = '{k.upper()}' THEN '{k}'" for k in LEVELS) + " WHEN contains(n, 'GEN X ACID') OR contains(n, 'HFPO-DA') THEN 'HFPO-DA' " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{s}'" for p, s in P.COMPOUNDS) + f" WHEN regexp_matches(n, '{P.ANY_PFAS}') THEN trim(name) END"
PFAS_SQL = f"""(SELECT *, CASE compound {' '.join(f"WHEN '{k}' THEN {x}" for k, x in LEVELS.items())} END AS level FROM (SELECT *, {COMPOUND_OF} AS compound, {NUMBER_OF} * CASE upper(unit) WHEN 'UG/L' THEN 1e3 WHEN 'MG/L' THEN 1e6 ELSE 1.0 END AS ng,
  value LIKE 'ND%' OR value LIKE '<%' OR condition IS NOT NULL AS below FROM (SELECT *, upper(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS n FROM tb_pfas)))"""


@query("fn10_ng_per_litre", f"SELECT result_id, ng FROM {PFAS_SQL}")
def _(v):
    return v("tb_pfas").select("result_id", P.to_ng_l(F.col("value"), F.col("unit")).alias("ng"))


@query("fn11_pfas_name", f"SELECT name, compound, count(*) AS n FROM {PFAS_SQL} GROUP BY 1, 2")
def _(v):
    return v("tb_pfas").groupBy("name", P.canonical_pfas(F.col("name"), LEVELS, SYNONYMS).alias("compound")).agg(F.count("*").alias("n"))


@query(
    "fn12_pfas_result",
    f"""SELECT result_id, compound AS canonical_analyte, CASE WHEN NOT below THEN ng END AS value_ng_l, level AS mcl_ng_l, CASE WHEN below THEN 'not-detected' WHEN ng > 0 THEN 'detected' ELSE 'reported' END AS status,
        CASE WHEN NOT below THEN ng >= level END AS above_benchmark FROM {PFAS_SQL}""",
)
def _(v):
    return v("tb_pfas").select("result_id", P.pfas_result(*[F.col(c) for c in ("name", "value", "unit", "condition")], LEVELS, SYNONYMS).alias("p")).select("result_id", "p.*")


@query("fn18_logical_key", "SELECT upper(concat_ws('|', pwsid, analyte, CAST(sample_date AS STRING), sample_type, '', location_code)) AS key, count(*) AS n FROM tb_samples GROUP BY 1")
def _(v):
    return v("tb_samples").groupBy(R.logical_key(*[F.col(c) for c in ("pwsid", "analyte", "sample_date", "sample_type")], F.lit(None), F.col("location_code")).alias("key")).agg(F.count("*").alias("n"))


@query("fn19_address_hash", "SELECT notice_id, sha256(concat(upper(split_part(address, ',', 1)), '|SANFORD|FL')) AS h FROM tb_notices")
def _(v):
    return v("tb_notices").select("notice_id", R.hash_address(F.substring_index("address", ",", 1), F.lit(" sanford ")).alias("h"))


@query("fn22_pwsid_like", "SELECT pwsid, CASE WHEN CAST(pwsid AS INT) % 3 = 0 THEN NULL ELSE pwsid END AS id FROM tb_systems")
def _(v):
    raw = F.when(F.col("pwsid").cast("int") % 3 == 0, F.concat("pwsid", F.lit("X"))).when(F.col("pwsid").cast("int") % 3 == 1, F.concat(F.lit(" fl 00"), "pwsid")).otherwise(F.col("pwsid"))
    return v("tb_systems").select("pwsid", R.pwsid_like(raw).alias("id"))


@query(
    "fn29_neighborhoods",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('OAK PARK ', CAST(c_nationkey AS STRING)) WHEN 1 THEN concat('Oak Park ', CAST(c_nationkey AS STRING), ';Lake Homes') WHEN 2 THEN 'Lake Homes' ELSE concat('Oak-Park ', CAST(c_nationkey AS STRING)) END AS found FROM customer""",
)
def _(v):
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    props = (
        F.when(k % 4 == 0, F.create_map(F.lit("SUBDIV_NAME"), F.concat(F.lit(" OAK PARK "), n, F.lit(" Phase 2B")), F.lit("NBHD"), F.lit("UNKNOWN"), F.lit("OWNER"), F.lit("Lake Homes")))
        .when(k % 4 == 1, F.create_map(F.lit("PLATNAME"), F.concat(F.lit("Oak Park "), n), F.lit("COMMUNITY"), F.lit("Lake Homes PH 3")))
        .when(k % 4 == 2, F.create_map(F.lit("nbhd_code"), F.lit("12345"), F.lit("PROJECT_NAME"), F.lit("Lake Homes")))
        .otherwise(F.create_map(F.lit("SUBD"), F.concat(F.lit("OAK PARK "), n), F.lit("NBHD"), F.lit("abc")))
    )
    return v("customer").select(k, F.array_join(R.neighborhoods(props, F.when(k % 4 == 3, F.concat(F.lit("Oak-Park "), n))), ";").alias("found"))


ITEM = "coalesce(nullif(publisher, ''), title)"


@query(
    "fn31_live_tier",
    f"""SELECT CASE WHEN contains(url, '.gov') THEN 'official-live' WHEN regexp_matches({ITEM}, '(?i)water|utilities|public works') THEN 'utility-live'
        WHEN regexp_matches(coalesce(nullif(publisher, ''), url), '(?i)hoa|facebook|nextdoor|reddit|community|forum') THEN 'community-unverified' ELSE 'journalism-or-other' END AS tier, count(*) AS n FROM tb_items GROUP BY 1""",
)
def _(v):
    return v("tb_items").groupBy(R.live_tier(F.col("url"), F.col("publisher"), F.col("title")).alias("tier")).agg(F.count("*").alias("n"))


@query(
    "fn32_source_applies",
    """SELECT pwsid, (CAST(pwsid AS INT) % 4 <> 1 OR CAST(pwsid AS INT) % 8 = 1) AND (CAST(pwsid AS INT) % 4 <> 2 OR city IN ('CANADA', 'CHINA')) AND (CAST(pwsid AS INT) % 4 <> 3 OR contains(upper(name), '000001')) AS applies FROM tb_systems""",
)
def _(v):
    i = F.col("pwsid").cast("int")
    none = F.array().cast("array<string>")
    ids = F.when(i % 4 == 1, F.array(F.when(i % 8 == 1, F.col("pwsid")).otherwise(F.lit("0")))).otherwise(none)
    cities = F.when(i % 4 == 2, F.array(F.lit("City of Canada"), F.lit("chin"))).otherwise(none)
    names = F.when(i % 4 == 3, F.array(F.lit("000001"))).otherwise(none)
    return v("tb_systems").select("pwsid", R.source_applies(ids, cities, names, F.col("pwsid"), F.col("city"), F.col("name")).alias("applies"))


@query("fn33_source_family", "SELECT CASE pwsid WHEN '3590001' THEN 'EPA-SDWIS' WHEN '3590002' THEN 'WQP' WHEN '3590003' THEN 'CCR' WHEN '3590004' THEN 'FDEP' ELSE 'OTHER' END AS family, count(*) AS n FROM tb_systems GROUP BY 1")
def _(v):
    p = F.col("pwsid")
    source = F.when(p == "3590001", "epa-sdwis-a").when(p == "3590002", "usgs-nwis").when(p == "3590003", "ccr-2020").when(p == "3590004", "").otherwise("portal")
    return v("tb_systems").groupBy(R.source_family(source, F.lit("Florida DEP")).alias("family")).agg(F.count("*").alias("n"))


@query(
    "fn41_record_status",
    "SELECT analyte, CASE WHEN mdl = 0.5 THEN 'detected' WHEN mdl = 1.0 THEN 'not-detected' WHEN result = 'ND' OR result LIKE '<%' OR CAST(result AS DOUBLE) = 0 THEN 'not-detected' ELSE 'detected' END AS status, count(*) AS n FROM tb_samples GROUP BY 1, 2",
)
def _(v):
    return v("tb_samples").groupBy("analyte", R.record_status(F.when(F.col("mdl") == 0.5, True).when(F.col("mdl") == 1.0, False), F.col("result")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "fn42_message",
    """SELECT pwsid, CASE WHEN CAST(pwsid AS INT) % 11 = 0 THEN 'A PFAS result is at or above the EPA limit' WHEN active > 0 THEN 'Active compliance items found' WHEN total = 0 THEN 'No recent contaminant results were attached' ELSE 'No active EPA violations found' END AS title,
         CASE WHEN CAST(pwsid AS INT) % 11 = 0 OR active > 0 THEN 'attention' WHEN total = 0 THEN 'unknown' WHEN total % 2 = 1 THEN 'neutral' ELSE 'good' END AS tone
       FROM (SELECT pwsid, sum(CASE WHEN status = 'OPEN' AND category = 'MCL EXCEEDED' THEN 1 ELSE 0 END) AS active, count(*) % 3 AS total FROM tb_violations GROUP BY pwsid)""",
)
def _(v):
    sums = v("tb_violations").groupBy("pwsid").agg(F.count_if((F.col("status") == "OPEN") & (F.col("category") == "MCL EXCEEDED")).alias("active"), (F.count("*") % 3).alias("total"))
    pfas = F.when(F.col("pwsid").cast("int") % 11 == 0, 1).otherwise(0)
    return sums.select("pwsid", R.overall_message(F.col("active"), F.col("total") % 2, F.col("total"), pfas).alias("m")).select("pwsid", "m.title", "m.tone")


@query("fn50_actionability", "SELECT analyte, CASE analyte WHEN 'LEAD' THEN 'NSF/ANSI 53,NSF/ANSI 58' WHEN 'COPPER' THEN 'NSF/ANSI 53' WHEN 'ARSENIC' THEN 'NSF/ANSI 58' WHEN 'NITRATE' THEN 'NSF/ANSI 58' ELSE '' END AS standards, count(*) AS n FROM tb_samples GROUP BY 1")
def _(v):
    return v("tb_samples").groupBy("analyte", F.array_join(R.actionability(F.concat(F.lower("analyte"), F.lit(" "))), ",").alias("standards")).agg(F.count("*").alias("n"))


@query("fn51_well_pathway", "SELECT address_id, address_id % 4 = 0 AS activated, CASE WHEN address_id % 4 = 0 THEN CAST(address_id % 3 AS INT) END AS well_permits, CASE WHEN address_id % 4 = 0 THEN 'certified-private-well-test' END AS recommendation FROM tb_points")
def _(v):
    a = F.col("address_id")
    return v("tb_points").select(a, R.well_pathway(F.when(a % 4 == 0, True), (a % 3).cast("int"), F.lit(0)).alias("w")).select("address_id", "w.activated", "w.well_permits", "w.recommendation")


@query("fn53_aliases", "SELECT CAST(station_id AS STRING) AS station, characteristic AS analyte, count(*) AS n, count(value) AS with_value FROM tb_results GROUP BY 1, 2")
def _(v):
    rows = v("tb_results").select(F.lit("").alias("monitoring_location_id"), F.col("station_id").alias("MonitoringLocationIdentifier"), F.col("characteristic").alias("CharacteristicName"), F.col("value").alias("ResultMeasure/ResultMeasureValue"))
    return rows.groupBy(R.field(rows, "station_id").alias("station"), R.field(rows, "analyte").alias("analyte")).agg(F.count("*").alias("n"), F.count(R.field(rows, "result_value")).alias("with_value"))


@query(
    "fn56_mutations",
    """SELECT mutation, unit, count(*) AS n, sum(CAST(result AS BIGINT)) AS total, max(sample_date) AS latest, count(DISTINCT id) AS ids FROM (
       SELECT 'decimal-shift' AS mutation, CAST(o_orderkey AS STRING) AS id, o_orderkey % 50 * 100 AS result, 'mg/L' AS unit, CAST(o_orderdate AS DATE) AS sample_date FROM orders UNION ALL
       SELECT 'unit-flip', CAST(o_orderkey AS STRING), o_orderkey % 50, 'ug/L', CAST(o_orderdate AS DATE) FROM orders UNION ALL
       SELECT 'duplicate', concat(CAST(o_orderkey AS STRING), '-dup'), o_orderkey % 50, 'mg/L', CAST(o_orderdate AS DATE) FROM orders UNION ALL
       SELECT 'date-future', CAST(o_orderkey AS STRING), o_orderkey % 50, 'mg/L', DATE '2099-01-01' FROM orders) GROUP BY 1, 2""",
)
def _(v):
    rows = v("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).cast("string").alias("result"), F.lit("mg/L").alias("unit"), F.col("o_orderdate").cast("date").alias("sample_date"))
    out = O.mutated(rows, "id", "result", "unit", "sample_date")
    return out.groupBy("mutation", "unit").agg(F.count("*").alias("n"), F.sum(F.col("result").cast("double").cast("long")).alias("total"), F.max("sample_date").alias("latest"), F.count_distinct("id").alias("ids"))


# ---- joins and aggregates ---------------------------------------------------------------------------------------


@query(
    "jn15_verification",
    """WITH d AS (SELECT DISTINCT rid, pwsid, analyte, sample_date, CAST(TRY_CAST(replace(result, '<', '') AS DOUBLE) AS DOUBLE) AS x, result, sample_id, source_id, lab_id FROM tb_samples),
       p AS (SELECT a.rid, count(DISTINCT b.rid) AS other FROM d a LEFT JOIN d b ON a.pwsid = b.pwsid AND a.analyte = b.analyte AND year(a.sample_date) = year(b.sample_date) AND a.rid <> b.rid AND CASE WHEN a.x IS NULL OR b.x IS NULL THEN a.result = b.result ELSE abs(a.x - b.x) <= 0.02 * greatest(abs(a.x), abs(b.x), 1e-12) END GROUP BY 1)
       SELECT d.rid, CASE WHEN p.other > 0 THEN 'confirmed-independent-sample' ELSE 'single-origin-sample' END AS factual_status, 1 + p.other AS origins,
         CASE d.lab_id WHEN 'LAB0' THEN CASE WHEN d.sample_date <= DATE '1995-06-30' THEN 'accredited' ELSE 'unaccredited-or-unverified' END WHEN 'LAB1' THEN 'accredited' WHEN 'LAB2' THEN 'expired-accreditation' WHEN 'LAB3' THEN 'unaccredited-or-unverified' ELSE 'unknown-accreditation' END AS accreditation FROM d JOIN p ON d.rid = p.rid""",
)
def _(v):
    k = F.col("r_regionkey")
    labs = v("region").filter(k < 4).select(
        F.when(k != 1, F.concat(F.lit("lab"), k)).alias("lab_id"), F.when(k == 1, " lab1 ").alias("name"), F.when(k == 2, "expired").otherwise("active").alias("status"), F.when(k == 0, F.lit("1995-06-30").cast("date")).alias("expires_on"), (k != 3).alias("certified")
    )
    rows = v("tb_samples").select("rid", "pwsid", "analyte", "sample_date", "result", "source_id", "lab_id").withColumn("year", F.year("sample_date"))
    rows = rows.repartition("pwsid", "analyte", "year").distinct().withColumns({"origin": F.col("rid"), "lab_name": F.col("lab_id")})
    out = O.verify(rows, ["pwsid", "analyte", "year"], "rid", "result", "origin", "source_id", labs, "lab_id", "lab_name", "sample_date")
    return out.select("rid", "factual_status", F.col("independent_origins").cast("long").alias("origins"), "accreditation")


@query(
    "jn16_sample_match",
    "SELECT n.notice_id, count(s.rid) AS samples FROM tb_notices n LEFT JOIN (SELECT DISTINCT rid, concat(location_code, ' ', analyte) AS place FROM tb_samples) s ON concat('L', CAST(n.notice_id % 9 AS STRING), ' LEAD') = s.place GROUP BY 1",
)
def _(v):
    addresses = v("tb_notices").select("notice_id", R.hash_address(F.concat(F.lit("l"), F.col("notice_id") % 9, F.lit("  lead")), F.lit("x")).alias("h"))
    samples = v("tb_samples").select("rid", R.hash_address(F.concat("location_code", F.lit(" "), "analyte"), F.lit("X")).alias("h")).distinct()
    return O.sample_match(addresses, samples.groupBy("h").agg(F.count("*").alias("n")), "h").select("notice_id", F.coalesce("n", F.lit(0)).alias("samples"))


@query("ag02_groups", "SELECT contaminant_group, count(*) AS n, count(DISTINCT pwsid) AS systems, count(DISTINCT analyte) AS analytes FROM tb_samples GROUP BY 1")
def _(v):
    return v("tb_samples").groupBy("contaminant_group").agg(F.count("*").alias("n"), F.count_distinct("pwsid").alias("systems"), F.count_distinct("analyte").alias("analytes"))


@query("ag04_local_summary", "SELECT 'pfas' AS family, count(*) AS n FROM tb_pfas UNION ALL SELECT 'stations', count(*) FROM tb_stations UNION ALL SELECT 'wells', count(*) FROM tb_points UNION ALL SELECT 'telemetry', count(*) FROM tb_results")
def _(v):
    parts = {"pfas": v("tb_pfas"), "stations": v("tb_stations"), "wells": v("tb_points"), "telemetry": v("tb_results")}
    return readers.labelled_union({k: d.agg(F.count("*").alias("n")) for k, d in parts.items()}, "family").select("family", "n")


@query(
    "ag18_scope_counts",
    """SELECT address_id, count(*) AS items, sum(CASE WHEN relevant AND scope = 'exact-address' THEN 1 ELSE 0 END)::BIGINT AS exact_address, sum(CASE WHEN relevant AND scope = 'affected-address-range' THEN 1 ELSE 0 END)::BIGINT AS affected_address_range,
         sum(CASE WHEN relevant AND scope = 'street' THEN 1 ELSE 0 END)::BIGINT AS street, sum(CASE WHEN relevant AND scope = 'neighborhood' THEN 1 ELSE 0 END)::BIGINT AS neighborhood, sum(CASE WHEN relevant AND scope IN ('elsewhere', 'system-context') THEN 1 ELSE 0 END)::BIGINT AS system_context,
         coalesce(first(scope ORDER BY score DESC, item_id) FILTER (WHERE relevant AND scope <> 'system-context'), 'none') AS best_scope, first(item_id ORDER BY score DESC, item_id) FILTER (WHERE relevant AND scope <> 'system-context') AS best_item FROM tb_items GROUP BY 1""",
)
def _(v):
    return O.scope_counts(v("tb_items"), ["address_id"], "scope", "score", "relevant", "item_id")


@query(
    "ag22_kill_rate",
    """SELECT mutation, count(*) AS total, sum(CASE WHEN killed THEN 1 ELSE 0 END)::BIGINT AS killed, round(avg(CASE WHEN killed THEN 1.0 ELSE 0.0 END), 6) AS kill_rate FROM (
       SELECT m AS mutation, CASE m WHEN 'decimal-shift' THEN x * 100 > 3000 OR x = 0 WHEN 'unit-flip' THEN x = 0 WHEN 'duplicate' THEN TRUE ELSE TRUE END AS killed FROM (SELECT o_orderkey % 50 AS x FROM orders), (SELECT unnest(['decimal-shift', 'unit-flip', 'duplicate', 'date-future']) AS m)) GROUP BY 1""",
)
def _(v):
    rows = v("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).cast("string").alias("result"), F.lit("ug/L").alias("unit"), F.col("o_orderdate").cast("date").alias("sample_date"))
    rows = rows.withColumn("before", M.measurement(F.col("result"), F.col("unit"))["canonical_value"])
    out = O.mutated(rows, "id", "result", "unit", "sample_date").withColumn("after", M.measurement(F.col("result"), F.col("unit"))["canonical_value"])
    flagged = (F.col("sample_date") > F.lit("2030-01-01").cast("date")) | ((F.col("mutation") == "decimal-shift") & (F.col("after") > 3000))
    return O.kill_rate(out, ["mutation"], flagged, F.col("before"), F.col("after")).withColumn("kill_rate", F.round("kill_rate", 6))


@query(
    "ag26_impact",
    "SELECT event_type, count(*) AS completed, count(DISTINCT user_id) AS visitors, sum(CASE WHEN k = 1 THEN 1 + event_id % 5 END)::BIGINT AS people FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events) GROUP BY 1",
)
def _(v):
    return O.impact(v("events").withColumn("size", 1 + F.col("event_id") % 5), ["event_type"], "user_id", "size", "ts", "event_id")


@query(
    "ag33_censored_summary",
    f"SELECT analyte, count(*) AS n, count(value) AS detected_n, sum(CASE WHEN censored THEN 1 ELSE 0 END)::BIGINT AS left_censored_n, CASE WHEN count(value) >= 3 AND bool_or(censored) THEN 'ROS/Kaplan-Meier-required' ELSE 'descriptive-only' END AS method FROM {MEASURED} GROUP BY 1",
)
def _(v):
    return stats.censored_summary(measured(v), ["analyte"], "value", "censored")


# ---- windows, order, sets ---------------------------------------------------------------------------------------


@query(
    "wn03_latest_with_counts",
    f"""SELECT analyte, pwsid, rid, CASE WHEN substr(result, 1, 1) = '<' THEN TRY_CAST(substr(result, 2) AS DOUBLE) ELSE TRY_CAST(result AS DOUBLE) END AS parsed_value, CASE WHEN substr(result, 1, 1) = '<' THEN '<' END AS parsed_qualifier, n AS record_count, p AS positive_count FROM (
        SELECT *, count(*) OVER w AS n, count(value) OVER w AS p, row_number() OVER (PARTITION BY pwsid, analyte ORDER BY sample_date DESC, rid DESC) AS k FROM (SELECT DISTINCT * FROM {MEASURED}) WINDOW w AS (PARTITION BY pwsid, analyte)) WHERE k = 1""",
)
def _(v):
    rows = measured(v).repartition("pwsid", "analyte").dropDuplicates().withColumn("found", F.col("value").isNotNull())
    return O.latest_with_counts(rows, ["pwsid", "analyte"], "sample_date", "result", "found", "rid").select("analyte", "pwsid", "rid", "parsed_value", "parsed_qualifier", "record_count", "positive_count")


@query(
    "wn05_latest_of_dates",
    "SELECT pwsid, report_id, report_year FROM (SELECT *, row_number() OVER (PARTITION BY pwsid ORDER BY greatest(published_at, coalesce(revised_at, published_at)) DESC, report_year DESC, report_id DESC) AS k FROM tb_reports) WHERE k = 1",
)
def _(v):
    return O.latest_row(v("tb_reports"), ["pwsid"], ["published_at", "revised_at"], "report_year", "report_id").select("pwsid", "report_id", "report_year")


@query("wn06_newest_report", "SELECT pwsid, report_id, report_year FROM (SELECT *, row_number() OVER (PARTITION BY pwsid ORDER BY report_year DESC, published_at DESC, report_id DESC) AS k FROM tb_reports) WHERE k = 1")
def _(v):
    return O.latest_row(v("tb_reports"), ["pwsid"], ["report_year"], "published_at", "report_id").select("pwsid", "report_id", "report_year")


@query(
    "st07_same_members",
    """WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 3 AS m FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 3 AS m FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 = 0),
       e AS (SELECT coalesce(a.k, b.k) AS k, a.m IS NOT NULL AS l, b.m IS NOT NULL AS r FROM a FULL JOIN b ON a.k = b.k AND a.m = b.m)
       SELECT k, bool_and(l AND r) AS equal, bool_and(l) AS superset FROM e GROUP BY k HAVING bool_or(l) AND bool_or(r)""",
)
def _(v):
    a = v("lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 3).alias("m"))
    return O.same_members(a, v("lineitem").filter("l_linenumber <= 2 and l_orderkey % 3 = 0").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 3).alias("m")), "k", "m")


# ---- statistics -------------------------------------------------------------------------------------------------


def polynomial_sql(x: str, coefficients: tuple[float, ...]) -> str:
    top = len(coefficients) - 1
    return "(" + " + ".join(f"({c}) * pow({x}, {top - i})" for i, c in enumerate(coefficients)) + ")"


def quantile_sql(p: str) -> str:
    q, far = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    middle = f"{q} * {polynomial_sql(f'({q} * {q})', T.MIDDLE_TOP)} / {polynomial_sql(f'({q} * {q})', T.MIDDLE_BOTTOM)}"
    tail = f"{polynomial_sql(far, T.TAIL_TOP)} / {polynomial_sql(far, T.TAIL_BOTTOM)}"
    return f"(CASE WHEN {p} < {T.TAIL_FROM} THEN {tail} WHEN {p} > {1 - T.TAIL_FROM} THEN -({tail}) ELSE {middle} END)"


@query(
    "sa04_imputation",
    f"""WITH d AS (SELECT analyte, rid, censored, value, CASE WHEN censored THEN coalesce(TRY_CAST(substr(result, 2) AS DOUBLE), mdl) * f END AS lim FROM (SELECT DISTINCT *, CASE unit WHEN 'mg/L' THEN 1000.0 WHEN 'ug/L' THEN 1.0 ELSE 0.001 END AS f FROM {MEASURED})),
       k AS (SELECT *, row_number() OVER (PARTITION BY analyte, censored ORDER BY coalesce(lim, value), rid) AS i, count(*) OVER (PARTITION BY analyte, censored) AS m FROM d WHERE CASE WHEN censored THEN lim IS NOT NULL ELSE value > 0 END),
       z AS (SELECT analyte, ln(value) AS y, {quantile_sql('((i - 0.375) / (m + 0.25))')} AS z FROM k WHERE NOT censored),
       l AS (SELECT analyte, count(*) AS n, regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM z GROUP BY 1)
       SELECT analyte, censored, count(*) AS n, round(sum(v), 3) AS total, round(min(v), 6) AS least, round(max(v), 6) AS most FROM (SELECT k.analyte, k.censored, CASE WHEN NOT censored THEN value ELSE least(lim, exp(a + b * {quantile_sql('((i - 0.5) / (m + n))')})) END AS v FROM k JOIN l ON k.analyte = l.analyte) GROUP BY 1, 2""",
)
def _(v):
    rows = v("tb_samples").dropDuplicates().withColumn("m", M.measurement(F.col("result"), F.col("unit"), F.col("mdl"))).select("analyte", "rid", "m.censored", F.col("m.canonical_value").alias("value"), F.col("m.detection_limit_ug_l").alias("lim"))
    out = stats.impute_censored(rows, ["analyte"], "rid", "value", "lim", "censored")
    return out.groupBy("analyte", "censored").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query(
    "sa12_inferred_links",
    """WITH d AS (SELECT station_id, result_date, avg(value) AS x FROM tb_results GROUP BY 1, 2)
       SELECT a.station_id AS a, b.station_id AS b, count(*) AS days, round(corr(a.x, b.x), 5) AS correlation, round(least(1, (corr(a.x, b.x) - 0.75) / 0.25 * 0.5 + 0.5), 5) AS certainty FROM d a JOIN d b ON a.result_date = b.result_date AND a.station_id < b.station_id GROUP BY 1, 2 HAVING count(*) >= 6 AND corr(a.x, b.x) >= 0.75""",
)
def _(v):
    return stats.inferred_links(v("tb_results"), "station_id", "result_date", "value").select("a", "b", "days", r("correlation", 5), r("certainty", 5))


@query("sa13_quantile", "SELECT characteristic, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM tb_results GROUP BY 1")
def _(v):
    return v("tb_results").groupBy("characteristic").agg(F.round(F.percentile("value", 0.05), 6).alias("p05"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


# ---- reports ----------------------------------------------------------------------------------------------------


@query(
    "rp06_review",
    """SELECT address_id, CAST(c AS INT) AS challenges, CASE WHEN c > 0 THEN 'challenged' ELSE 'passed' END AS status, CASE WHEN address_id % 50 = 0 THEN 'high' ELSE 'normal' END AS severity, address_id % 50 = 0 OR c > 3 AS human_review_required
       FROM (SELECT address_id, CASE WHEN address_id % 3 = 0 THEN 0 ELSE 1 END + address_id % 4 + CASE WHEN address_id % 5 > 0 THEN 1 ELSE 0 END AS c FROM tb_points)""",
)
def _(v):
    a = F.col("address_id")
    return v("tb_points").select(a, R.review(F.when(a % 3 == 0, "exact-household-sample").otherwise("system"), a % 4, a % 5, a % 50 == 0).alias("w")).select("address_id", "w.*")


@query(
    "rp07_quarantine",
    f"""SELECT role, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(concat(url, ' ', {ITEM}), '(?i)nextdoor|facebook|reddit|forum|hoa|community|social') THEN 'lead-only' WHEN contains(url, '.gov') THEN 'official-context' ELSE 'context-only' END AS role FROM tb_items) GROUP BY 1""",
)
def _(v):
    return v("tb_items").groupBy(R.evidence_role(F.col("url"), F.col("publisher"), F.col("title")).alias("role")).agg(F.count("*").alias("n"))


@query("rp10_replay", "SELECT identical, count(*) AS n FROM (SELECT s_suppkey % 4 <> 0 AS identical FROM supplier) GROUP BY 1")
def _(v):
    after = v("tb_systems").withColumn("population", F.when((F.col("pwsid").cast("int") - 3590000) % 4 == 0, F.col("population") + 1).otherwise(F.col("population")))
    return O.replay(v("tb_systems"), after, "pwsid", "name", "population", "city").groupBy("identical").agg(F.count("*").alias("n"))


# ---- sources ----------------------------------------------------------------------------------------------------


@query(
    "src05_chemistry_rows",
    "SELECT source_id, count(*) AS n, count(DISTINCT fp) AS fingerprints FROM (SELECT 'export' AS source_id, sha256(concat_ws('|', pwsid, '', analyte, CAST(sample_date AS STRING), location_code, lab_id, '', result, unit)) AS fp FROM tb_samples WHERE pwsid LIKE '35900%') GROUP BY 1",
)
def _(v):
    export = v("tb_samples").select(F.col("pwsid").alias("PWSID"), F.col("analyte").alias("CONTAMCODE"), F.col("sample_date").alias("SAMPLEDATE"), F.col("location_code").alias("LOCATIONCODE"), F.col("lab_id").alias("LAB"), F.col("result").alias("RESULTS"), F.col("unit").alias("UOM"))
    return readers.chemistry_rows(export, "35900", "export", "agency").groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("record_fingerprint").alias("fingerprints"))


@query("src06_metal", "SELECT metal, count(*) AS n FROM (SELECT CASE analyte WHEN 'LEAD' THEN 'COPPER' WHEN 'COPPER' THEN 'COPPER' WHEN 'ARSENIC' THEN 'ARSENIC' END AS metal FROM tb_samples) WHERE metal IS NOT NULL GROUP BY 1")
def _(v):
    named = F.when(F.col("analyte") == "LEAD", "lead and copper rule").otherwise(F.concat(F.lower("analyte"), F.lit(", total")))
    return v("tb_samples").withColumn("metal", readers.metal_of(named)).filter("metal is not null").groupBy("metal").agg(F.count("*").alias("n"))


@query("src11_county", "SELECT pwsid FROM tb_systems WHERE CAST(pwsid AS INT) % 6 IN (0, 2, 3)")
def _(v):
    i = F.col("pwsid").cast("int") % 6
    county = F.when(i.isin(0, 1, 2), "Seminole County").otherwise("ORANGE")
    rows = v("tb_systems").withColumns({"county_served": county, "county_fips": F.when(i == 3, "12117"), "state": F.when(i.isin(0, 3, 4), "fl").when(i == 1, "GA"), "id": F.col("pwsid"), "pwsid": F.when(i == 2, F.concat(F.lit("FL"), "pwsid")).otherwise(F.col("pwsid"))})
    return rows.filter(readers.in_county(rows)).select(F.col("id").alias("pwsid"))


@query(
    "src18_occurrence",
    "SELECT pwsid, detection_condition, count(*) AS n FROM (SELECT pwsid, CASE WHEN value LIKE '<%' THEN 'non-detect' END AS detection_condition FROM tb_pfas WHERE pwsid IN (SELECT pwsid FROM tb_systems WHERE population > 0)) GROUP BY 1, 2",
)
def _(v):
    table = v("tb_pfas").select(F.concat(F.lit("FL"), "pwsid").alias("pws_id"), F.col("name").alias("contaminant"), F.regexp_replace("value", "<", "").alias("analytical_result_value"), F.when(F.col("value").startswith("<"), " < ").otherwise("=").alias("analytical_result_sign"))
    return readers.occurrence_rows(table, v("tb_systems").filter("population > 0")).groupBy("pwsid", "detection_condition").agg(F.count("*").alias("n"))


@query("src19_cache_reuse", "SELECT count(*) AS n FROM tb_pfas WHERE lower(trim(name)) IN ('pfoa', 'pfxyz')")
def _(v):
    return readers.of_characteristics(v("tb_pfas"), ["PFOA ", "PFxyz"], "name").agg(F.count("*").alias("n"))


@query("src20_well_samples", "SELECT CAST(address_id AS STRING) AS well_id, CAST(CASE WHEN address_id % 2 = 0 THEN address_id % 7 ELSE address_id % 5 END AS STRING) AS result_value, 'ug/L' AS result_unit FROM tb_points")
def _(v):
    a = F.col("address_id")
    table = v("tb_points").select(F.lit("").alias("well_id"), a.alias("id"), F.when(a % 2 == 0, a % 7).alias("concentration"), (a % 5).alias("dioxane_ug_l"), "lat", "lon")
    return readers.well_samples(table, "1,4-Dioxane", "county-study").select("well_id", "result_value", "result_unit")


@query(
    "src25_pdf_links",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'https://county.example/docs/well-study-1.pdf' ELSE 'https://other.example/b-c.PDF' END AS url, CASE WHEN n_nationkey % 2 = 0 THEN 'well study 1' ELSE 'b c' END AS title FROM nation
       UNION ALL SELECT n_nationkey, 'https://county.example/a/map.pdf', 'map' FROM nation WHERE n_nationkey % 2 = 1""",
)
def _(v):
    html = F.when(F.col("n_nationkey") % 2 == 0, "<a href=\"/docs/well-study-1.pdf\">1</a><a href='a/map.pdf'>m</a><a href='/docs/well-study-1.pdf'>again</a>").otherwise("<a href='https://other.example/b-c.PDF'>x</a><a href='a/map.pdf'>m</a><a href='/page.html'>n</a>")
    return readers.pdf_links(v("nation").withColumn("html", html), "n_nationkey", F.col("html"), "(?i)well", "https://county.example").select("n_nationkey", "url", "title")


@query(
    "src26_report_rows",
    "SELECT p_partkey, 'Lead (total)' AS contaminant, concat('<', CAST(p_size AS STRING)) AS reported_value, 'ppb' AS unit FROM part UNION ALL SELECT p_partkey, 'Nitrate', concat(CAST(p_size AS STRING), '.5'), 'mg/L' FROM part WHERE p_partkey % 2 = 0",
)
def _(v):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("Definitions: MCLG goal 5 ppb\nLead (total)   < "), size, F.lit(" ppb range\nNo unit here 12\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" Nitrate "), size, F.lit(".5 mg/L"))).otherwise(""))
    return readers.report_rows(v("part").withColumn("text", text), "p_partkey", F.col("text")).select("p_partkey", "contaminant", "reported_value", "unit")


@query(
    "src27_report_index",
    """SELECT kind, count(*) AS n FROM (SELECT 'configured' AS kind FROM region UNION ALL SELECT 'configured' FROM region UNION ALL SELECT 'discovered' FROM tb_reports UNION ALL
       SELECT 'finder' FROM tb_systems WHERE system_type = 'COMMUNITY' AND pwsid NOT IN (SELECT pwsid FROM tb_reports) AND CAST(pwsid AS INT) NOT BETWEEN 3590020 AND 3590029) GROUP BY 1""",
)
def _(v):
    k = F.col("r_regionkey")
    configured = v("region").select(F.array((3590020 + 2 * k).cast("string"), (3590021 + 2 * k).cast("string")).alias("pwsids"), F.lit("u").alias("url"), F.lit(2020).alias("report_year"))
    links = v("tb_reports").select("pwsid", F.lit("v").alias("url"), "report_year")
    return readers.report_index(configured, links, v("tb_systems"), "https://finder.example").groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "src24_search_results",
    """SELECT n_nationkey, concat(n_name, ' & water') AS title, concat('https://news.example/', lower(n_name), '?a=1') AS url, 'news.example' AS publisher, CASE WHEN n_nationkey % 2 = 0 THEN 'A bold note' ELSE '' END AS excerpt FROM nation
       UNION ALL SELECT n_nationkey, 'second', 'https://www.epa.gov/x', 'www.epa.gov', 'other' FROM nation""",
)
def _(v):
    slug = F.regexp_replace(F.lower("n_name"), " ", "%20")
    first = F.concat(F.lit('<a rel="n" class="result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fnews.example%2F'), slug, F.lit('%3Fa%3D1&amp;rut=9">'), F.col("n_name"), F.lit(" &amp; <b>water</b></a>"))
    note = F.when(F.col("n_nationkey") % 2 == 0, '<a class="result__snippet" href="z">A <b>bold</b>  note</a>').otherwise("")
    html = F.concat(F.lit("<html>"), first, note, F.lit('<a class="x result__a" href="https://www.epa.gov/x">second</a><div class="result__snippet">other</div>'))
    return readers.search_results(v("nation"), "n_nationkey", html).select("n_nationkey", "title", "url", "publisher", "excerpt")


@query(
    "jn18_provider_candidates",
    """WITH l AS (SELECT label_id, upper(replace(label, 'Supplier#', 'S ')) AS t, label_pwsid FROM tb_labels), s AS (SELECT pwsid, upper(replace(name, 'Supplier#', 'S ')) AS n FROM tb_systems),
       c AS (SELECT label_id, pwsid, 1.0 AS score FROM l JOIN s ON label_pwsid = pwsid UNION ALL SELECT label_id, pwsid, 0.94 FROM l JOIN s ON t <> '' AND ((contains(n, t) AND length(t) > 4) OR (contains(t, n) AND length(n) > 4))
         UNION ALL SELECT label_id, pwsid, 0.96 FROM l JOIN s ON t <> '' AND pwsid IN ('3590001', '3590002') AND (contains(t, 'MOBILE') OR contains('MOBILE', t)))
       SELECT label_id, pwsid, CAST(max(score) AS DOUBLE) AS score FROM c GROUP BY 1, 2""",
)
def _(v):
    short = lambda c: F.replace(F.col(c), F.lit("Supplier#"), F.lit("S "))
    aliases = v("region").filter("r_regionkey = 0").select(F.lit("mobile").alias("name"), F.array(F.lit("3590001"), F.lit("3590002"), F.lit("1")).alias("pwsids"))
    systems = v("tb_systems").withColumn("name", short("name"))
    return resolve.provider_candidates(v("tb_labels").withColumn("label", short("label")), systems, aliases).join(systems.select("pwsid"), "pwsid", "left_semi").select("label_id", "pwsid", "score")


@query("jn20_fingerprint_lookup", "SELECT s.analyte, c.passed, count(*) AS n FROM tb_samples s LEFT JOIN (SELECT DISTINCT rid, location_code = 'L1' AS passed FROM tb_samples WHERE location_code IN ('L1', 'L2')) c ON s.rid = c.rid GROUP BY 1, 2")
def _(v):
    checks = v("tb_samples").filter("location_code in ('L1', 'L2')").select("rid", (F.col("location_code") == "L1").alias("passed")).dropDuplicates(["rid"])
    return v("tb_samples").join(checks, "rid", "left").groupBy("analyte", "passed").agg(F.count("*").alias("n"))


@query(
    "jn21_claim_scopes",
    "SELECT scope, count(*) AS n, sum(CASE WHEN scope = 'exact-household-sample' AND sample_type <> 'TAP' THEN 0 ELSE 1 END)::BIGINT AS eligible FROM tb_samples, (SELECT unnest(['public-water-system-record', 'exact-household-sample']) AS scope) GROUP BY 1",
)
def _(v):
    # A short fixed list, so each record carries it: no cross join.
    rows = v("tb_samples").withColumn("scope", F.explode(F.array(F.lit("public-water-system-record"), F.lit("exact-household-sample"))))
    return rows.groupBy("scope").agg(F.count("*").alias("n"), F.count_if((F.col("scope") == "public-water-system-record") | (F.col("sample_type") == "TAP")).alias("eligible"))


@query(
    "ag30_profile",
    """WITH x AS (SELECT analyte, value, CAST(substr(ltrim(replace(CAST(CAST(value * 1000 AS BIGINT) AS STRING), '.', ''), '0'), 1, 1) AS INT) AS d, CAST(round(value * 1000) AS BIGINT) % 10 AS t FROM """
    + MEASURED
    + """ WHERE value > 0), c AS (SELECT analyte, d, count(*) AS c FROM x GROUP BY 1, 2), n AS (SELECT analyte, count(*) AS n FROM x GROUP BY 1), t AS (SELECT analyte, max(c) AS m FROM (SELECT analyte, t, count(*) AS c FROM x GROUP BY 1, 2) GROUP BY 1)
       SELECT n.analyte, n.n, round(sum(pow(coalesce(c.c, 0) - n.n * log10(1 + 1.0 / g.d), 2) / (n.n * log10(1 + 1.0 / g.d))), 4) AS chi_square, round(any_value(t.m) / n.n, 6) AS terminal_share,
         n.n >= 30 AND (sum(pow(coalesce(c.c, 0) - n.n * log10(1 + 1.0 / g.d), 2) / (n.n * log10(1 + 1.0 / g.d))) > 20.09 OR any_value(t.m) / n.n > 0.25) AS flag
       FROM n CROSS JOIN (SELECT unnest(range(1, 10)) AS d) g LEFT JOIN c ON c.analyte = n.analyte AND c.d = g.d JOIN t ON t.analyte = n.analyte GROUP BY n.analyte, n.n""",
)
def _(v):
    return stats.digit_profile(measured(v), ["analyte"], "value").select("analyte", "n", r("chi_square"), r("terminal_share", 6), "flag")


@query("tk01_systems_by_name", "SELECT pwsid, name FROM tb_systems")
def _(v):
    return v("tb_systems").select("pwsid", "name").orderBy("name", "pwsid")


@query(
    "rp02_group_report",
    f"""SELECT pwsid, analyte, count(*) AS records, count(value) AS detected_n, sum(CASE WHEN censored THEN 1 ELSE 0 END)::BIGINT AS left_censored_n, max(sample_date) AS latest_date, CASE WHEN analyte IN ('LEAD', 'COPPER', 'ARSENIC', 'NITRATE') THEN TRUE ELSE FALSE END AS actionable, TRUE AS validated
        FROM {MEASURED} GROUP BY 1, 2""",
)
def _(v):
    rows = measured(v).withColumn("_bad", F.col("sample_date").isNull() | (F.coalesce("unit", F.lit("")) == "") | (F.coalesce("pwsid", F.lit("")) == ""))
    out = stats.censored_summary(rows, ["pwsid", "analyte"], "value", "censored").drop("method").withColumnRenamed("n", "records")
    extra = rows.groupBy("pwsid", "analyte").agg(F.max("sample_date").alias("latest_date"), (~F.bool_or("_bad")).alias("validated"))
    return out.join(extra, ["pwsid", "analyte"]).withColumn("actionable", F.size(R.actionability(F.col("analyte"))) > 0)


@query(
    "rp08_system_context",
    """SELECT s.pwsid, coalesce(x.n, 0) AS violations, r.report_id AS newest_report, coalesce(p.n, 0) AS pfas_results FROM tb_systems s LEFT JOIN (SELECT pwsid, count(*) AS n FROM tb_violations GROUP BY 1) x ON s.pwsid = x.pwsid
       LEFT JOIN (SELECT pwsid, report_id FROM (SELECT *, row_number() OVER (PARTITION BY pwsid ORDER BY report_year DESC, published_at DESC, report_id DESC) AS k FROM tb_reports) WHERE k = 1) r ON s.pwsid = r.pwsid LEFT JOIN (SELECT pwsid, count(*) AS n FROM tb_pfas GROUP BY 1) p ON s.pwsid = p.pwsid""",
)
def _(v):
    count = lambda t, name: v(t).groupBy("pwsid").agg(F.count("*").alias(name))
    newest = O.latest_row(v("tb_reports"), ["pwsid"], ["report_year"], "published_at", "report_id").select("pwsid", F.col("report_id").alias("newest_report"))
    out = v("tb_systems").join(count("tb_violations", "violations"), "pwsid", "left").join(newest, "pwsid", "left").join(count("tb_pfas", "pfas_results"), "pwsid", "left")
    return out.select("pwsid", F.coalesce("violations", F.lit(0)).alias("violations"), "newest_report", F.coalesce("pfas_results", F.lit(0)).alias("pfas_results"))


# ---- judgements by rule -----------------------------------------------------------------------------------------

STATES = """(SELECT action_id, action_id % 3 <> 0 AS accepted, gain AS stability, action_id % 5 AS household_samples, action_id % 4 AS unverified_labs, action_id % 2 = 0 AS has_ccr, action_id % 6 AS active_violations, flip AS freshness, severity AS coverage, action_id % 7 AS contradictions FROM tb_candidates)"""


def states(v):
    i = F.col("action_id")
    return v("tb_candidates").select(
        i, (i % 3 != 0).alias("accepted"), F.col("gain").alias("stability"), (i % 5).alias("household_samples"), (i % 4).alias("unverified_labs"), (i % 2 == 0).alias("has_ccr"), (i % 6).alias("active_violations"),
        F.col("flip").alias("freshness"), F.col("severity").alias("coverage"), (i % 7).alias("contradictions"),
    )


@query(
    "sa19_next_evidence",
    "WITH a AS (" + " UNION ALL ".join(
        f"SELECT action_id, '{name}' AS action, {round(f * g * s / max(0.1, e), 4)}::DOUBLE AS priority, {i} AS i FROM {STATES} WHERE {test}"
        for i, ((name, (f, g, s, e)), test) in enumerate(zip(certify.ACTIONS.items(), ("NOT accepted OR stability < 0.75", "household_samples = 0", "unverified_labs > 0", "NOT has_ccr", "active_violations > 0", "freshness < 0.55", "coverage < 0.55", "contradictions > 0"), strict=True))
    ) + ") SELECT action_id, action, priority, CAST(row_number() OVER (PARTITION BY action_id ORDER BY priority DESC, i) AS INT) AS rank FROM a",
)
def _(v):
    return certify.next_evidence(states(v), "action_id")


@query(
    "sa20_robustness",
    f"""SELECT action_id, CAST(p AS INT) AS passed, CASE WHEN p = 6 THEN 'robust' WHEN p = 5 THEN 'conditionally-robust' WHEN p >= 3 THEN 'limited' ELSE 'fragile' END AS level, CASE WHEN household_samples > 0 THEN 'household-and-system' ELSE 'system-level-only' END AS scope FROM (
        SELECT *, accepted::INT + (stability >= 0.75)::INT + (household_samples > 0 OR has_ccr)::INT + (active_violations <> 1)::INT + (coverage >= 0.55)::INT + (contradictions <= 3)::INT AS p FROM {STATES})""",
)
def _(v):
    c = F.col
    return states(v).select("action_id", certify.robustness(c("accepted"), c("stability"), c("household_samples"), ~c("has_ccr"), c("active_violations") == 1, c("coverage"), c("contradictions")).alias("x")).select("action_id", "x.*")


@query(
    "ag29_composite",
    f"""WITH e AS (SELECT pwsid, year(sample_date) AS y, avg(CASE WHEN censored THEN 1.0 ELSE 0.0 END) AS rate, count(value) AS n, sum(CASE WHEN value BETWEEN 15000 * 0.95 AND 15000 THEN 1 ELSE 0 END) AS near_, sum(CASE WHEN value < 15000 * 0.95 AND value >= 15000 * 0.9 THEN 1 ELSE 0 END) AS before_,
         sum(CASE WHEN value BETWEEN mdl AND 1.05 * mdl THEN 1 ELSE 0 END) AS m, sum(CASE WHEN location_code = 'L1' THEN 1 ELSE 0 END) AS d, sum(CASE WHEN sample_type = 'TAP' THEN 0.5 ELSE 0 END) AS s, count(*) AS k FROM {MEASURED} GROUP BY 1, 2),
       c AS (SELECT pwsid, greatest(0, (sum(near_) - sum(before_)) / sum(n)) AS a, sum(m) / sum(n) AS b, CASE WHEN count(*) > 1 THEN greatest(0, arg_max(rate, y) - arg_min(rate, y)) ELSE 0 END AS g, sum(d) / sum(k) AS p, sum(s) / sum(k) AS q FROM e GROUP BY 1)
       SELECT pwsid, round(a, 6) AS limit_bunching, round(g, 6) AS censoring_drift, round(0.25 * a + 0.15 * b + 0.2 * g + 0.25 * p + 0.15 * q, 6) AS composite_score, CASE WHEN 0.25 * a + 0.15 * b + 0.2 * g + 0.25 * p + 0.15 * q >= 0.65 THEN 'high' WHEN 0.25 * a + 0.15 * b + 0.2 * g + 0.25 * p + 0.15 * q >= 0.35 THEN 'moderate' ELSE 'low' END AS tier FROM c""",
)
def _(v):
    rows = measured(v).withColumn("y", F.year("sample_date"))
    x = F.col("value")
    out = certify.strategic_sampling(rows, "pwsid", "value", F.lit(15000.0), x.between(F.col("mdl"), 1.05 * F.col("mdl")), "censored", "y", F.when(F.col("location_code") == "L1", 1.0).otherwise(0.0), F.when(F.col("sample_type") == "TAP", 0.5).otherwise(0.0))
    return out.select("pwsid", r("limit_bunching", 6), r("censoring_drift", 6), r("composite_score", 6), "tier")
