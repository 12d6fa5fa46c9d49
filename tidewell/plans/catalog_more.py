"""Queries over names, notices, pages, choices and streams; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import scores as S
from tidewell.functions import text as X
from tidewell.operators import choice, resolve
from tidewell.plans.catalog import QUERIES, SQL, query, r
from tidewell.plans.testbed import with_views
from tidewell.streaming import events as E
from tidewell.streaming import keyed as K

TOKENS = """list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(upper({c}), '\\([^)]*\\)', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda t: CASE WHEN regexp_full_match(t, '[0-9]{{5,}}') THEN '' ELSE t END),
 lambda t: t <> '' AND t NOT IN ('CITY', 'OF', 'WATER', 'SYSTEM', 'UTILITIES', 'INC', 'DISTRICT'))"""


@query("fn20_canonical_name", f"SELECT label_id, array_to_string({TOKENS.format(c='label')}, ' ') AS canonical FROM tb_labels")
def _(v):
    return v("tb_labels").select("label_id", F.array_join(X.canonical_tokens(F.col("label")), " ").alias("canonical"))


@query(
    "fn21_jaccard",
    f"""SELECT l.label_id, s.pwsid, round(len(list_intersect(l.t, s.t)) * 1.0 / len(list_distinct(list_concat(l.t, s.t))), 6) AS j
        FROM (SELECT label_id, label_pwsid, {TOKENS.format(c='label')} AS t FROM tb_labels) l JOIN (SELECT pwsid, {TOKENS.format(c='name')} AS t FROM tb_systems) s ON l.label_pwsid = s.pwsid WHERE len(list_concat(l.t, s.t)) > 0""",
)
def _(v):
    both = v("tb_labels").join(v("tb_systems"), F.col("label_pwsid") == F.col("pwsid"))
    return both.select("label_id", "pwsid", F.round(X.jaccard(X.canonical_tokens(F.col("label")), X.canonical_tokens(F.col("name"))), 6).alias("j"))


ADDRESS = "trim(regexp_replace(upper(split_part(address, ',', 1)), '[^A-Z0-9]+', ' ', 'g'))"
SHORT = f"replace(replace(replace(replace({ADDRESS}, 'NORTH', 'N'), 'STREET', 'ST'), 'AVENUE', 'AVE'), 'ROAD', 'RD')"


@query("fn23_address", f"SELECT notice_id, CAST(regexp_extract({SHORT}, '^(\\d+) ', 1) AS INT) AS house, regexp_extract({SHORT}, '^\\d+ (.+)$', 1) AS street FROM tb_notices")
def _(v):
    return v("tb_notices").select("notice_id", X.house_number(F.col("address")).alias("house"), X.street(F.col("address")).alias("street"))


RANGES = f"""(SELECT notice_id, notice_text, CAST(regexp_extract({SHORT}, '^(\\d+) ', 1) AS INT) AS house, regexp_extract({SHORT}, '^\\d+ (.+)$', 1) AS street, CAST(regexp_extract(notice_text, '(\\d+)-(\\d+) ', 1) AS INT) AS lo,
  CAST(regexp_extract(notice_text, '(\\d+)-(\\d+) ', 2) AS INT) AS hi, regexp_extract(notice_text, '\\d+-\\d+ ([A-Z ]+) in', 1) AS road,
  CASE WHEN notice_text LIKE '%lifted%' THEN 'lifted' WHEN notice_text LIKE '%issued%' THEN 'active' ELSE 'not-stated' END AS status FROM tb_notices)"""


@query("fn25_range_match", f"SELECT notice_id, house BETWEEN lo AND hi AND street = road AS in_range, status FROM {RANGES}")
def _(v):
    n = v("tb_notices")
    return n.select("notice_id", X.in_address_range(F.col("notice_text"), X.house_number(F.col("address")), X.street(F.col("address"))).alias("in_range"), X.notice_status(F.col("notice_text")).alias("status"))


@query(
    "fn28_address_evidence",
    f"""SELECT scope, status, count(*) AS n, round(sum(score), 2) AS total FROM (SELECT status, CASE WHEN house BETWEEN lo AND hi AND street = road THEN 'range' WHEN street = road THEN 'street' ELSE 'system' END AS scope,
        least(CASE WHEN house BETWEEN lo AND hi AND street = road THEN 0.96 WHEN street = road THEN 0.78 ELSE 0.2 END, CASE WHEN notice_text LIKE '%water%' OR notice_text LIKE '%Hydrant%' THEN 1.0 ELSE 0.55 END) AS score FROM {RANGES}) GROUP BY 1, 2""",
)
def _(v):
    n = v("tb_notices").withColumns({"house": X.house_number(F.col("address")), "street": X.street(F.col("address")), "status": X.notice_status(F.col("notice_text"))})
    hit, near = X.in_address_range(F.col("notice_text"), F.col("house"), F.col("street")), F.contains(F.col("notice_text"), F.concat(F.lit(" "), F.col("street"), F.lit(" ")))
    scope = F.when(hit, "range").when(near, "street").otherwise("system")
    score = F.least(F.when(hit, 0.96).when(near, 0.78).otherwise(0.2), F.when(F.col("notice_text").rlike("(?i)water|hydrant"), 1.0).otherwise(0.55))
    return n.groupBy(scope.alias("scope"), "status").agg(F.count("*").alias("n"), F.round(F.sum(score), 2).alias("total"))


@query("fn54_latest_year", "SELECT notice_id, CAST(regexp_extract(notice_text, ' in (\\d+)$', 1) AS INT) AS year FROM tb_notices")
def _(v):
    return v("tb_notices").select("notice_id", X.years(F.col("notice_text")).alias("year"))


@query("fn27_excerpt", "SELECT notice_id, substr(notice_text, greatest(1, instr(lower(notice_text), 'for') - 10), 30) AS part FROM tb_notices WHERE instr(lower(notice_text), 'for') > 0")
def _(v):
    return v("tb_notices").select("notice_id", X.excerpt(F.col("notice_text"), F.lit("for"), 10, 30).alias("part")).filter("part is not null")


@query(
    "fn30_html_strip",
    """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
       '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM pages""",
)
def _(v):
    return v("pages").select("page_id", F.md5(X.strip_html(F.col("html"))).alias("digest"))


@query("src23_links", """SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS INT) AS links, regexp_extract(html, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS first_href FROM pages""")
def _(v):
    found = X.links(F.col("html"))
    return v("pages").select("page_id", F.size(found).alias("links"), F.coalesce(F.get(found, F.lit(0))["href"], F.lit("")).alias("first_href"))


XW_LADDER = f"""known AS (SELECT DISTINCT pwsid FROM tb_xw_systems),
lab AS (SELECT *, {TOKENS.format(c="coalesce(label, '')")} AS lt FROM tb_xw_labels),
al AS (SELECT name, list(pwsid ORDER BY pwsid) AS ids FROM tb_xw_members WHERE pwsid IN (SELECT pwsid FROM known) GROUP BY name),
nm AS (SELECT DISTINCT kind, ids, {TOKENS.format(c='name')} AS rt FROM (SELECT 'system' AS kind, [pwsid] AS ids, name FROM tb_xw_systems UNION ALL SELECT 'alternative', [pwsid], name FROM tb_xw_alternatives UNION ALL SELECT 'alias', ids, name FROM al)),
pr AS (SELECT label_id, kind, ids, lt, rt, lt = rt AS same, len(list_intersect(lt, rt)) AS shared FROM lab, nm WHERE len(lt) > 0 AND len(rt) > 0),
sc AS (SELECT *, CASE WHEN same THEN CASE kind WHEN 'alternative' THEN 0.995 WHEN 'system' THEN 0.99 ELSE 0.985 END
    WHEN ((len(rt) >= 2 OR kind = 'alias') AND shared = len(rt)) OR ((len(lt) >= 2 OR kind = 'alias') AND shared = len(lt)) THEN CASE kind WHEN 'alternative' THEN 0.97 WHEN 'system' THEN 0.96 ELSE 0.92 END
    WHEN kind = 'system' AND shared >= 0.5 * (len(lt) + len(rt) - shared) THEN 0.8::DOUBLE + 0.1::DOUBLE * (shared::DOUBLE / (len(lt) + len(rt) - shared)) END::DOUBLE AS score FROM pr),
hits AS (SELECT label_id, CASE kind WHEN 'alias' THEN 'ALIAS:' || array_to_string(rt, ' ') || ':' || array_to_string(list_sort(ids), ',') ELSE 'SYS:' || ids[1] END AS entity, kind = 'alias' AS is_alias, list_sort(ids) AS ids, ids[1] AS pwsid, score,
    CASE kind WHEN 'alternative' THEN 1 WHEN 'alias' THEN 2 ELSE CASE WHEN same THEN 3 WHEN score > 0.91 THEN 4 ELSE 6 END END AS rung FROM sc WHERE score IS NOT NULL AND (kind <> 'alternative' OR ids[1] IN (SELECT pwsid FROM known))
    UNION ALL SELECT label_id, 'SYS:' || label_pwsid, false, [label_pwsid], label_pwsid, 1.0, 0 FROM lab WHERE label_pwsid IN (SELECT pwsid FROM known)
    UNION ALL SELECT label_id, 'SYS:' || p, false, [p], p, 0.955, 5 FROM lab JOIN (SELECT t, min(p) AS p FROM (SELECT unnest(rt) AS t, ids[1] AS p FROM nm WHERE kind = 'system') GROUP BY t HAVING min(p) = max(p)) ON len(lt) = 1 AND lt[1] = t),
ent AS (SELECT label_id, entity, bool_or(is_alias) AS is_alias, any_value(ids) AS ids, arg_min(pwsid, rung) AS pwsid, max(score) AS score, min(rung) AS rung FROM hits GROUP BY ALL),
top AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY score DESC, rung, entity) = 1),
run AS (SELECT t.label_id, max(e.score) AS runner FROM top t JOIN ent e ON t.label_id = e.label_id AND t.entity <> e.entity AND t.ids <> e.ids
    AND NOT (e.is_alias AND NOT t.is_alias AND list_has_all(e.ids, t.ids)) AND (e.is_alias OR NOT t.is_alias) GROUP BY 1),
dec AS (SELECT l.label_id, l.city, trim(coalesce(label, '')) = '' AND label_pwsid IS NULL AS blank, coalesce(t.score >= 0.9 AND coalesce(t.score - runner >= 0.02, true), false) AS ok, t.ids, t.pwsid, t.score FROM lab l LEFT JOIN top t USING (label_id) LEFT JOIN run USING (label_id)),
loc AS (SELECT label_id, min(pwsid) AS one FROM (SELECT d.label_id, s.pwsid FROM (SELECT *, unnest(ids) AS p FROM dec WHERE ok AND NOT blank AND len(ids) > 1) d JOIN tb_xw_systems s ON d.p = s.pwsid
    WHERE d.city <> '' AND s.city <> '' AND (contains(upper(d.city), upper(s.city)) OR contains(upper(s.city), upper(d.city)))) GROUP BY 1 HAVING count(DISTINCT pwsid) = 1),
fin AS (SELECT label_id, CASE WHEN blank THEN 'unassigned-no-provider-label' WHEN NOT ok THEN 'named-provider-unresolved' WHEN len(ids) > 1 AND one IS NULL THEN 'provider-only-multi-pws' ELSE 'single-pws-resolved' END AS status,
    CASE WHEN ok AND NOT blank THEN coalesce(one, pwsid) END AS pwsid, CASE WHEN one IS NOT NULL THEN one ELSE coalesce(array_to_string(ids, ','), '') END AS pwsids, round(score, 6) AS score,
    CASE WHEN blank OR NOT ok THEN 'unresolved' WHEN score >= 0.98 THEN 'very-high' WHEN score >= 0.95 OR one IS NOT NULL THEN 'high' ELSE 'moderate' END AS confidence FROM dec LEFT JOIN loc USING (label_id))"""


def _crosswalk(v):
    aliases = v("tb_xw_members").groupBy("name").agg(F.sort_array(F.collect_list("pwsid")).alias("pwsids"))
    return resolve.crosswalk(v("tb_xw_labels"), v("tb_xw_systems"), v("tb_xw_alternatives"), aliases)


@query("xw_crosswalk", f"WITH {XW_LADDER} SELECT * FROM fin")
def _(v):
    return _crosswalk(v).select("label_id", "status", "pwsid", F.array_join("pwsids", ",").alias("pwsids"), F.round("score", 6).alias("score"), "confidence")


@query(
    "ag16_crosswalk_coverage",
    f"""WITH {XW_LADDER}, c AS (SELECT count(*) AS labels, count(*) FILTER (status <> 'unassigned-no-provider-label') AS named, count(*) FILTER (status = 'unassigned-no-provider-label') AS unassigned, count(*) FILTER (status IN ('single-pws-resolved', 'provider-only-multi-pws')) AS matched,
        count(*) FILTER (status = 'named-provider-unresolved') AS unresolved, count(*) FILTER (status = 'provider-only-multi-pws') AS multi, count(*) FILTER (status = 'single-pws-resolved') AS single FROM fin),
    s AS (SELECT status, array_to_string(list_sort(list(label_id))[1:25], ',') AS ids FROM fin GROUP BY 1)
    SELECT *, round(100.0 * matched / named, 1)::DOUBLE AS named_coverage_pct, round(100.0 * single / named, 1)::DOUBLE AS single_coverage_pct, coalesce((SELECT ids FROM s WHERE status = 'named-provider-unresolved'), '') AS unresolved_sample,
      coalesce((SELECT ids FROM s WHERE status = 'provider-only-multi-pws'), '') AS multi_sample, coalesce((SELECT ids FROM s WHERE status = 'unassigned-no-provider-label'), '') AS unassigned_sample FROM c""",
)
def _(v):
    out = resolve.coverage(_crosswalk(v))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in out.columns if c.endswith("_sample")})


# ---- choices and scores -----------------------------------------------------------------------------------------

UTILITY = "0.35 * gain + 0.3 * flip + 0.25 * severity + 0.1 * (1 - privacy)"
COST = "0.45 * effort + 0.25 * 0.2 + 0.3 * privacy"


def _bids(v):
    c = v("tb_candidates")
    return c.withColumns({"utility": S.bid_utility(F.col("gain"), F.col("flip"), F.col("severity"), F.col("privacy")), "cost": S.bid_cost(F.col("effort"), F.lit(0.2), F.col("privacy"))})


@query("sa18_bids", f"SELECT action_id, round({UTILITY}, 6) AS utility, round({COST}, 6) AS cost, round(({UTILITY}) / ({COST}), 6) AS ratio FROM tb_candidates")
def _(v):
    return _bids(v).select("action_id", r("utility", 6), r("cost", 6), F.round(F.col("utility") / F.col("cost"), 6).alias("ratio"))


@query("sa17_value_of_information", "SELECT action_id, round(flip * severity * 0.8 * gain / greatest(effort, 0.01), 6) AS voi FROM tb_candidates")
def _(v):
    return v("tb_candidates").select("action_id", F.round(S.value_of_information(F.col("flip"), F.col("severity"), F.lit(0.8), F.col("gain"), F.col("effort")), 6).alias("voi"))


@query(
    "tk07_greedy_budget",
    f"""WITH RECURSIVE b AS (SELECT report, action_id, {COST} AS cost, gain, row_number() OVER (PARTITION BY report ORDER BY -(({UTILITY}) / ({COST})), action_id) AS k FROM tb_candidates),
    f AS (SELECT report, CAST(0 AS BIGINT) AS k, CAST(0.0 AS DOUBLE) AS spent, CAST(1.0 AS DOUBLE) AS miss, 0 AS taken FROM (SELECT DISTINCT report FROM b)
      UNION ALL SELECT f.report, b.k, CASE WHEN f.spent + b.cost <= 1.4 + 1e-9 AND f.taken < 3 THEN f.spent + b.cost ELSE f.spent END, CASE WHEN f.spent + b.cost <= 1.4 + 1e-9 AND f.taken < 3 THEN f.miss * (1 - b.gain) ELSE f.miss END,
        CASE WHEN f.spent + b.cost <= 1.4 + 1e-9 AND f.taken < 3 THEN f.taken + 1 ELSE f.taken END FROM f JOIN b ON b.report = f.report AND b.k = f.k + 1)
    SELECT report, taken, round(spent, 5) AS spent, round(1 - miss, 5) AS joint_gain FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY k DESC) AS z FROM f) WHERE z = 1""",
)
def _(v):
    out = choice.greedy_budget(_bids(v), ["report"], "action_id", F.col("utility") / F.col("cost"), "cost", "gain", 1.4, 3)
    return out.select("report", F.size("chosen").alias("taken"), r("spent", 5), r("joint_gain", 5))


@query(
    "sa14_uncertainty_budget",
    """SELECT action_id, round(exp((CASE WHEN gain > 0 THEN 2 * ln(gain) ELSE 0 END + CASE WHEN flip > 0 THEN 4 * ln(flip) ELSE 0 END + CASE WHEN severity > 0 THEN 3 * ln(severity) ELSE 0 END + ln(effort))
      / (CASE WHEN gain > 0 THEN 2 ELSE 0 END + CASE WHEN flip > 0 THEN 4 ELSE 0 END + CASE WHEN severity > 0 THEN 3 ELSE 0 END + 1)), 6) AS score FROM tb_candidates""",
)
def _(v):
    dims = {"gain": (F.col("gain"), 2), "flip": (F.col("flip"), 4), "severity": (F.col("severity"), 3), "effort": (F.col("effort"), 1)}
    return v("tb_candidates").select("action_id", F.round(choice.weighted_geometric(dims), 6).alias("score"))


@query(
    "tk04_dominant_uncertainties",
    """SELECT action_id, dim, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY value, dim) AS k FROM (
       SELECT action_id, 'gain' AS dim, gain AS value FROM tb_candidates UNION ALL SELECT action_id, 'flip', flip FROM tb_candidates UNION ALL SELECT action_id, 'severity', severity FROM tb_candidates UNION ALL SELECT action_id, 'effort', effort FROM tb_candidates)) WHERE k <= 2""",
)
def _(v):
    rows = v("tb_candidates").unpivot("action_id", ["gain", "flip", "severity", "effort"], "dim", "value")
    from tidewell.operators.versions import latest

    return latest(rows, ["action_id"], [F.col("value"), F.col("dim")], 2).select("action_id", "dim", r("value", 6))


@query(
    "sa16_verdict_envelope",
    """SELECT action_id, round(worst, 6) AS worst, round(best, 6) AS best, CASE WHEN worst >= 0.9 THEN 'very-high' WHEN worst >= 0.75 THEN 'high' WHEN worst >= 0.55 THEN 'moderate' WHEN worst >= 0.35 THEN 'low' ELSE 'insufficient' END =
       CASE WHEN best >= 0.9 THEN 'very-high' WHEN best >= 0.75 THEN 'high' WHEN best >= 0.55 THEN 'moderate' WHEN best >= 0.35 THEN 'low' ELSE 'insufficient' END AND best - worst <= 0.2 AS stable
       FROM (SELECT action_id, greatest(0.0, flip - CASE WHEN gain < 0.2 THEN 0.25 ELSE 0 END - CASE WHEN privacy > 0.4 THEN 0.08 ELSE 0 END - CASE WHEN severity > 0.8 THEN 0.15 ELSE 0 END) AS worst, least(1.0, flip + 0.05) AS best FROM tb_candidates)""",
)
def _(v):
    worst, best = choice.verdict_envelope(F.col("flip"), [(F.col("gain") < 0.2, 0.25), (F.col("privacy") > 0.4, 0.08), (F.col("severity") > 0.8, 0.15)])
    out = v("tb_candidates").select("action_id", worst.alias("worst"), best.alias("best"))
    stable = (S.confidence_label(F.col("worst")) == S.confidence_label(F.col("best"))) & (F.col("best") - F.col("worst") <= 0.2)
    return out.select("action_id", r("worst", 6), r("best", 6), stable.alias("stable"))


@query(
    "sa20_certificate",
    "SELECT certificate, count(*) AS n FROM (SELECT CASE WHEN h = 4 THEN 'robust' WHEN h >= 3 THEN 'conditionally-robust' WHEN h >= 2 THEN 'limited' ELSE 'fragile' END AS certificate FROM (SELECT CAST(gain > 0.3 AS INT) + CAST(flip < 0.5 AS INT) + CAST(privacy < 0.5 AS INT) + CAST(effort < 0.6 AS INT) AS h FROM tb_candidates)) GROUP BY 1",
)
def _(v):
    checks = [F.col("gain") > 0.3, F.col("flip") < 0.5, F.col("privacy") < 0.5, F.col("effort") < 0.6]
    return v("tb_candidates").groupBy(choice.certificate(checks).alias("certificate")).agg(F.count("*").alias("n"))


@query("ag30_digits", "SELECT event_type, CAST(substr(regexp_replace(CAST(value AS STRING), '[^1-9]', '', 'g'), 1, 1) AS INT) AS d, count(*) AS n FROM events WHERE regexp_matches(CAST(value AS STRING), '[1-9]') GROUP BY 1, 2")
def _(v):
    d = F.regexp_extract(F.col("value").cast("string"), "([1-9])", 1).try_cast("int")
    return v("events").withColumn("d", d).filter("d is not null").groupBy("event_type", "d").agg(F.count("*").alias("n"))


# ---- streams: what a stream writes, against the same over the whole table ----------------------------------------


def _stream(name: str, sql: str | None, make):
    def run(spark, sf_dir):
        from tidewell.streaming.folder import shared_folder

        return make(E.event_stream(spark, sf_dir), shared_folder(spark))

    QUERIES[name] = run
    if sql:
        SQL[name] = with_views(sql)


CLOSED = "(SELECT max(ts) - INTERVAL 2 DAYS FROM events)"
_stream(
    "stream_rate_windows",
    f"SELECT CAST(date_trunc('hour', ts) AS STRING) AS window_start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type HAVING count(*) > 3 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}",
    lambda s, folder: E.run_available(E.rate_windows(s, "event_type", 3), folder).withColumn("window_start", F.col("window_start").cast("string")),
)
_stream("stream_first_seen", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1", lambda s, folder: E.run_available(E.first_seen(s, ["user_id"]), folder).groupBy("user_id").agg(F.count("*").alias("n")))
_stream(
    "stream_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOURS <= {CLOSED}""",
    lambda s, folder: E.run_available(E.sessions(s, "user_id"), folder).select("user_id", "n", r("total")),
)


def _keyed(name: str, sql: str, make):
    def run(spark, sf_dir):
        from tidewell.streaming.folder import shared_folder

        was = spark.conf.get(K.STORE[0])
        spark.conf.set(*K.STORE)
        try:
            return make(E.event_stream(spark, sf_dir), shared_folder(spark))
        finally:
            spark.conf.set(K.STORE[0], was)

    QUERIES[name], SQL[name] = run, with_views(sql)


_keyed(
    "rp12_rate_limit",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, date_trunc('milliseconds', ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, t, k, t + INTERVAL 2 DAYS AS reset, 1 AS n FROM e WHERE k = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.t, e.k, CASE WHEN e.t >= w.reset THEN e.t + INTERVAL 2 DAYS ELSE w.reset END, CASE WHEN e.t >= w.reset THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
    SELECT event_id, user_id, n <= 3 AS allowed, CAST(greatest(0, 3 - n) AS BIGINT) AS remaining, CAST(CASE WHEN n <= 3 THEN 0 ELSE ceil((epoch_ms(reset) - epoch_ms(t)) / 1000.0) END AS BIGINT) AS retry_after_s FROM w""",
    lambda s, folder: E.run_available(K.rate_limited(s, "user_id", "event_id", 2 * 86_400, 3), folder).drop("ts"),
)
_keyed(
    "rp13_two_ttl_cache",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, date_trunc('milliseconds', ts) AS t, CASE WHEN event_type <> 'error' THEN event_type END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, t, k, v AS answer, t + CASE WHEN v IS NULL THEN INTERVAL 1 DAY ELSE INTERVAL 5 DAYS END AS expires, false AS hit FROM e WHERE k = 1 UNION ALL
      SELECT e.user_id, e.event_id, e.t, e.k, CASE WHEN e.t <= w.expires THEN w.answer ELSE e.v END, CASE WHEN e.t <= w.expires THEN w.expires ELSE e.t + CASE WHEN e.v IS NULL THEN INTERVAL 1 DAY ELSE INTERVAL 5 DAYS END END, e.t <= w.expires
      FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
    SELECT event_id, user_id, hit, answer FROM w""",
    lambda s, folder: E.run_available(K.cached(s.withColumn("answer_now", F.when(F.col("event_type") != "error", F.col("event_type"))), "user_id", "event_id", "answer_now", 5 * 86_400, 86_400), folder).drop("ts"),
)
