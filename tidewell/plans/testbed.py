"""Evidence-shaped views over the star-schema tables. The text is SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "tb_samples": """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING), CAST(CAST(round(l_discount * 100) AS INT) AS STRING)) AS rid,
  CAST(3590000 + l_suppkey AS STRING) AS pwsid,
  CASE l_partkey % 6 WHEN 0 THEN 'LEAD' WHEN 1 THEN 'COPPER' WHEN 2 THEN 'TOTAL THMS' WHEN 3 THEN 'NITRATE' WHEN 4 THEN 'URANIUM' ELSE 'ARSENIC' END AS analyte,
  CASE l_partkey % 6 WHEN 2 THEN 'DBP' WHEN 4 THEN 'RAD' ELSE 'INOR' END AS contaminant_group,
  CAST(l_shipdate AS DATE) AS sample_date,
  CASE l_returnflag WHEN 'A' THEN 'mg/L' WHEN 'N' THEN 'ug/L' ELSE 'ng/L' END AS unit,
  CASE WHEN l_discount = 0 THEN 'ND' WHEN l_linenumber = 1 THEN concat('<', CAST(CAST(l_quantity AS INT) AS STRING)) ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS result,
  concat('L', CAST(l_linenumber AS STRING)) AS location_code,
  CASE l_orderkey % 3 WHEN 0 THEN 'TAP' WHEN 1 THEN 'ENTRY POINT' ELSE 'DISTRIBUTION' END AS sample_type,
  concat('SRC', CAST(l_partkey % 4 AS STRING)) AS source_id, concat('PUB', CAST(l_orderkey % 5 AS STRING)) AS publisher,
  concat('LAB', CAST(l_suppkey % 7 AS STRING)) AS lab_id,
  CASE WHEN l_orderkey % 4 = 0 THEN concat('S', CAST(l_orderkey AS STRING)) END AS sample_id,
  0.5 * l_linenumber AS mdl, CAST(round(l_tax * 100) AS INT) AS revision
FROM {lineitem}""",
    "tb_systems": """
SELECT CAST(3590000 + s_suppkey AS STRING) AS pwsid, s_name AS name, n_name AS city, CAST(s_acctbal AS INT) AS population,
  CASE s_suppkey % 3 WHEN 0 THEN 'COMMUNITY' WHEN 1 THEN 'NTNC' ELSE 'TNC' END AS system_type
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "tb_points": """
SELECT c_custkey AS address_id, -81.5 + 0.001 * (c_custkey % 1000) AS lon, 28.5 + 0.0007 * (c_custkey % 997) AS lat FROM {customer}""",
    "tb_polygons": """
SELECT n_nationkey AS feature_id, n_name AS name, CAST(3590000 + n_nationkey AS STRING) AS pwsid,
  -81.5053 + 0.2 * (n_nationkey % 5) AS x0, 28.495 + 0.14 * floor(n_nationkey / 5) AS y0,
  -81.4947 + 0.2 * (n_nationkey % 5) + 0.2 AS x1, 28.505 + 0.14 * floor(n_nationkey / 5) + 0.14 AS y1, n_nationkey % 4 = 0 AS has_hole FROM {nation}""",
    "tb_stations": """
SELECT s_suppkey AS station_id, -81.5 + 0.009 * (s_suppkey % 100) AS lon, 28.5 + 0.007 * ((s_suppkey * 37) % 100) AS lat, s_name AS station_name FROM {supplier}""",
    "tb_results": """
SELECT event_id AS result_id, user_id % 100 AS station_id, event_type AS characteristic, value, CAST(ts AS DATE) AS result_date, ts FROM {events}""",
    "tb_violations": """
SELECT o_orderkey AS violation_id, CAST(3590000 + o_custkey % 100 AS STRING) AS pwsid, CAST(o_orderdate AS DATE) AS begin_date,
  CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'OPEN' ELSE 'ARCHIVED' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'MCL EXCEEDED' WHEN '2' THEN 'MONITORING AND REPORTING' WHEN '3' THEN 'TREATMENT TECHNIQUE' WHEN '4' THEN 'PUBLIC NOTICE' ELSE 'OTHER' END AS category,
  concat('R', CAST(o_orderkey % 9 AS STRING)) AS rule_code, concat('C', CAST(o_custkey % 6 AS STRING)) AS contaminant_code FROM {orders}""",
    "tb_claims": """
SELECT event_id AS claim_id, event_type AS topic, concat('P', CAST(user_id % 7 AS STRING)) AS proposition, CASE WHEN event_id % 3 = 0 THEN 'oppose' ELSE 'support' END AS stance,
  concat('agent', CAST(event_id % 5 AS STRING)) AS agent, least(1.0, value / 100) AS confidence, concat('O', CAST(event_id % 11 AS STRING)) AS origin, event_id % 997 = 0 AS hard_veto FROM {events}""",
    "tb_subject_claims": """
SELECT event_id AS claim_id, event_type AS topic, concat('U', CAST(user_id AS STRING)) AS proposition, CASE WHEN event_id % 3 = 0 THEN 'oppose' ELSE 'support' END AS stance, concat('O', CAST(event_id % 11 AS STRING)) AS origin FROM {events}""",
    "tb_edges": """
SELECT DISTINCT a AS src, b AS dst, 0.5 + 0.01 * ((a * 7 + b * 3) % 50) AS certainty FROM (SELECT l_partkey % 40 AS a, l_suppkey % 40 AS b FROM {lineitem}) t WHERE a < b""",
    "tb_rules": """
SELECT r_regionkey AS rule_id, CASE WHEN r_regionkey < 3 THEN 'LEAD' ELSE 'NITRATE' END AS analyte, CAST(concat(CAST(1990 + 3 * r_regionkey AS STRING), '-01-01') AS DATE) AS valid_from,
  CASE WHEN r_regionkey < 4 THEN CAST(concat(CAST(1993 + 3 * r_regionkey AS STRING), '-01-01') AS DATE) END AS valid_to, CAST(10 * (r_regionkey + 1) AS DOUBLE) AS threshold,
  CAST('1995-01-01' AS DATE) AS recorded_from, CASE WHEN r_regionkey = 1 THEN CAST('2000-01-01' AS DATE) END AS recorded_to FROM {region}""",
}


#: Where other engines mean something else by the same words: they round a fraction to a whole number, Spark cuts it off;
#: their floor stays a double, so what is counted with it is one, Spark's is a whole number and what is counted a decimal.
SPARK = {"CAST(s_acctbal AS INT)": "CAST(rint(s_acctbal) AS INT)", "floor(n_nationkey / 5)": "CAST(floor(n_nationkey / 5) AS DOUBLE)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a table by its own name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    for theirs, ours in SPARK.items():
        text = text.replace(theirs, ours)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def with_views(body: str) -> str:
    """The SQL text with the views it names put before it."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = ", ".join(f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v]).strip()})" for v in names)
    if not names:
        return body
    own = re.match(r"\s*WITH (RECURSIVE )?", body)
    if not own:
        return f"WITH {ctes} {body}"
    return f"WITH {own[1] or ''}{ctes}, {body[own.end():]}"


VIEWS |= {
    "tb_labels": """
SELECT s_suppkey AS label_id, CASE s_suppkey % 6 WHEN 0 THEN concat('City of ', s_name, ' Water System') WHEN 1 THEN s_name WHEN 2 THEN concat(upper(s_name), ' (north) utilities, inc.')
    WHEN 3 THEN concat('Unknown district ', CAST(s_suppkey AS STRING)) WHEN 4 THEN '' ELSE concat(s_name, ' mobile home') END AS label,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(3590000 + s_suppkey AS STRING) END AS label_pwsid FROM {supplier}""",
    "tb_layers": """
SELECT page_id AS item_id, translate(CASE WHEN page_id % 29 = 0 THEN '<broken' ELSE concat('<"item":<"layers":[<"url":"', md5(url), '/FeatureServer">,<"inner":<"URL":"', md5(url), '/MapServer/', CAST(page_id % 5 AS STRING), '">>],"url":',
    CASE WHEN page_id % 3 = 0 THEN concat('"', md5(url), '/MapServer"') ELSE '7' END, '>,"other":[[<"url":"', md5(url), '">],[<"deep":[<"deeper":<"url":"', md5(url), '/featureserver/9">,"n":null>]>]],"title":"x/MapServer">') END, '<>', concat(chr(123), chr(125))) AS body FROM {pages}""",
    "tb_places": """
SELECT c_custkey AS place_id, c_custkey % 19 <> 0 AS located, CAST(c_custkey % 4 AS INT) AS polygons, c_custkey % 5 <> 0 AS accepted, CASE WHEN c_custkey % 5 <> 0 THEN CAST(3590000 + c_nationkey AS STRING) END AS pwsid,
  CAST(0.9 + 0.01 * (c_custkey % 8) AS DOUBLE) AS score, c_custkey % 23 = 0 AS equal_candidates, CASE WHEN c_custkey % 13 = 0 THEN 'not-computed' WHEN c_custkey % 100 < 75 THEN 'fragile' ELSE 'stable' END AS stability_status,
  CAST(0.01 * (c_custkey % 100) AS DOUBLE) AS stability_score, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS households, c_custkey % 3 <> 0 AS synced, coalesce(active, 0) AS active, CASE WHEN c_custkey % 4 <> 1 THEN 2000 + c_custkey % 25 END AS ccr_year,
  c_custkey % 6 AS stations, coalesce(records, 0) AS records, coalesce(origins, 0) AS origins, coalesce(single_origin, 0) AS single_origin, coalesce(unaccredited, 0) AS unaccredited, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS geocoder_m,
  c_custkey % 9 = 0 AS near_boundary, CAST(c_custkey % 75 AS DOUBLE) AS boundary_m, c_custkey % 17 = 0 AS gap, c_custkey % 21 = 0 AS overlap
FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS records, count(DISTINCT o_orderpriority) AS origins, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS unaccredited, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS active,
  sum(CASE WHEN o_totalprice < 40000 THEN 1 ELSE 0 END) AS single_origin FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey""",
    "tb_budget_places": """
SELECT c_custkey AS place_id, c_custkey % 19 <> 0 AS primary_found, c_custkey % 4 <> 2 AS secondary_found, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 130 AS DOUBLE) END AS geocoder_m, c_custkey % 5 <> 0 AS accepted, CAST(0.9 + 0.01 * (c_custkey % 8) AS DOUBLE) AS score,
  CASE WHEN c_custkey % 3 = 0 THEN 'not-computed' ELSE 'computed' END AS stability_status, CAST(0.4 + 0.01 * (c_custkey % 60) AS DOUBLE) AS stability_score, c_custkey % 9 = 0 AS near_boundary, c_custkey % 17 = 0 AS gap, c_custkey % 21 = 0 AS overlap,
  CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS households, coalesce(records, 0) AS records, coalesce(analytes, 0) AS analytes, coalesce(groups, 0) AS groups, newest, coalesce(effective_n, 0) AS effective_n, c_custkey % 6 AS contradictions,
  c_custkey % 2 = 0 AS federal_synced, c_custkey % 3 = 0 AS ccr_synced, c_custkey % 4 = 0 AS wqp_synced, 1 + c_custkey % 3 AS set_size, c_custkey % 10 < 3 AS single_origin, CAST(0.01 * (c_custkey % 40) AS DOUBLE) AS max_delta, coalesce(groups, 0) / 6.0 AS coverage_fraction,
  c_custkey % 11 <> 0 AS household_blocked, c_custkey % 13 <> 0 AS path_complete, c_custkey % 8 AS undecided
FROM {customer} LEFT JOIN (SELECT l_suppkey, count(*) AS records, count(DISTINCT l_partkey % 23) AS analytes, count(DISTINCT l_returnflag) AS groups, CAST(max(l_shipdate) AS DATE) AS newest, count(DISTINCT l_linenumber) AS effective_n FROM {lineitem} WHERE l_suppkey % 2 = 0 GROUP BY l_suppkey) l
  ON c_custkey % 200 = l_suppkey""",
    "tb_xw_systems": """
SELECT CAST(3590000 + s_suppkey AS STRING) AS pwsid, n_name AS city, concat(n_name, CASE s_suppkey % 4 WHEN 0 THEN ' Pine Cove' WHEN 1 THEN ' Bear Lake' WHEN 2 THEN ' Manor' ELSE '' END, CASE WHEN s_suppkey % 3 = 0 THEN concat(' Unit', CAST(s_suppkey AS STRING)) ELSE ' Water System' END) AS name
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "tb_xw_alternatives": """
SELECT CAST(3590000 + s_suppkey AS STRING) AS pwsid, concat('Quadrant', CAST(s_suppkey AS STRING), ' ', n_name) AS name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 1""",
    "tb_xw_members": """
SELECT concat(n_name, ' Authority') AS name, CAST(3590000 + CASE WHEN n_nationkey % 2 = 0 THEN s_suppkey ELSE n_nationkey END AS STRING) AS pwsid FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey UNION
SELECT concat(r_name, ' Coastal') AS name, CAST(3590000 + s_suppkey AS STRING) AS pwsid FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE s_suppkey % 9 = 0 UNION
SELECT concat(r_name, ' Coastal Authority') AS name, CAST(3590000 + s_suppkey AS STRING) AS pwsid FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE s_suppkey % 9 < 2""",
    "tb_xw_labels": """
SELECT c_custkey AS label_id, n_name AS city,
  CASE c_custkey % 11 WHEN 0 THEN concat(n_name, ' Authority (north)') WHEN 1 THEN concat('City of ', n_name, ' Pine Cove') WHEN 2 THEN concat(r_name, ' Coastal') WHEN 3 THEN concat('Unit', CAST(c_custkey % 200 AS STRING)) WHEN 4 THEN concat('Quadrant', CAST(c_custkey % 90 AS STRING), ' ', n_name)
    WHEN 5 THEN '  ' WHEN 6 THEN n_name WHEN 7 THEN concat('Unknown ', CAST(c_custkey AS STRING)) WHEN 8 THEN concat(n_name, ' Bear Lake mobile home') WHEN 9 THEN concat(r_name, ' Coastal Authority of ', n_name) END AS label,
  CASE WHEN c_custkey % 17 = 0 THEN CAST(3590000 + c_custkey % 150 AS STRING) END AS label_pwsid FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "tb_notices": """
SELECT c_custkey AS notice_id, concat(CAST(c_custkey % 300 AS STRING), ' ', CASE c_nationkey % 3 WHEN 0 THEN 'North Oak Street' WHEN 1 THEN 'Pine Avenue' ELSE 'Lake Road' END, ', Sanford, FL') AS address,
  concat(CASE c_custkey % 4 WHEN 0 THEN 'Boil water notice issued for ' WHEN 1 THEN 'The advisory is lifted for ' WHEN 2 THEN 'Hydrant work near ' ELSE 'A sample was taken at ' END,
    CAST((c_custkey * 7) % 250 AS STRING), '-', CAST((c_custkey * 7) % 250 + 90 AS STRING), ' ', CASE c_custkey % 3 WHEN 0 THEN 'N OAK ST' WHEN 1 THEN 'PINE AVE' ELSE 'LAKE RD' END, ' in ', CAST(2000 + c_custkey % 30 AS STRING)) AS notice_text FROM {customer}""",
    "tb_candidates": """
SELECT p_partkey AS action_id, p_brand AS report, CAST(p_partkey % 17 AS DOUBLE) / 20 AS gain, CAST(p_partkey % 13 AS DOUBLE) / 16 AS flip, CAST(p_partkey % 11 AS DOUBLE) / 11 AS severity, CAST(p_partkey % 7 AS DOUBLE) / 10 AS privacy, CAST(p_size AS DOUBLE) / 50 + CAST(0.05 AS DOUBLE) AS effort FROM {part}""",
}
