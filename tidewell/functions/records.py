"""Column builders over whole records: accessors of differing names, keys, status, tiers, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.measure import MICROGRAMS, any_date, detected, first_number, is_non_detect, normalize_pwsid, normalized
from tidewell.sources.readers import coalesced

# The columns that hold one thing under several names, by preference.
ALIASES = {
    "analyte": ("analyte", "contaminant", "metal", "characteristic_name", "CharacteristicName"),
    "station_id": ("monitoring_location_id", "MonitoringLocationIdentifier", "station_id", "siteid"),
    "result_date": ("activity_start_date", "ActivityStartDate", "sample_date", "date"),
    "result_value": ("result_value", "ResultMeasure/ResultMeasureValue", "ResultMeasureValue", "value"),
    "result_unit": ("result_unit", "ResultMeasure/MeasureUnitCode", "MeasureUnitCode", "unit"),
}
# Filter standards that name a contaminant.
STANDARDS = {"LEAD": ["NSF/ANSI 53", "NSF/ANSI 58"], "PFAS": ["NSF/ANSI 53", "NSF/ANSI 58"], "ARSENIC": ["NSF/ANSI 58"], "NITRATE": ["NSF/ANSI 58"], "RADIUM": ["NSF/ANSI 58"], "COPPER": ["NSF/ANSI 53"]}
# Sites that publish officially, that discuss, and words of leads that may never corroborate.
OFFICIAL = r"(?i)\.gov\b|seminolecountyfl\.gov|epa\.gov|floridadep\.gov"
UTILITY = r"(?i)(water|utilities|public works)"
COMMUNITY = r"(?i)(hoa|facebook|nextdoor|reddit|community|forum)"
LEADS = r"(?i)nextdoor|facebook|reddit|forum|hoa|community|social"


def text_or(value: Column, default: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def field(df: DataFrame, name: str) -> Column:
    """One of ALIASES from whatever columns the table has."""
    return coalesced(df, *ALIASES[name])


def logical_key(*fields: Column) -> Column:
    """Fields trimmed, in upper case, with single spaces; a missing one keeps its place."""
    return F.concat_ws("|", *[F.coalesce(normalized(F.translate(f.cast("string"), "μ", "µ")), F.lit("")) for f in fields])


def hash_address(address: Column, city: Column, state: str = "FL") -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(normalized(address), F.lit("")), F.coalesce(normalized(city), F.lit("")), F.lit(state)), 256)


def pwsid_like(value: Column) -> Column:
    """The six or seven digits of a text that is a system id and nothing else."""
    return F.nullif(F.regexp_extract(value.cast("string"), r"(?i)^\s*(?:FL)?\s*0*([0-9]{6,7})\s*$", 1), F.lit(""))


def convert(value: Column, unit: Column, to: str) -> Column:
    """A concentration in another unit; null where the unit is no mass per volume."""
    known = F.create_map(*[F.lit(x) for pair in MICROGRAMS.items() for x in pair])
    from_unit = F.try_element_at(known, F.upper(F.translate(F.regexp_replace(unit, r"\s", ""), "µμΜ", "UUU")))
    return value * from_unit / MICROGRAMS[to.upper()]


def compare_concentrations(a: Column, unit_a: Column, analyte_a: Column, b: Column, unit_b: Column, analyte_b: Column) -> Column:
    """-1, 0 or 1; null for different or missing analytes, which have no order."""
    return F.when(analyte_a == analyte_b, F.signum(convert(a, unit_a, "ug/L") - convert(b, unit_b, "ug/L")).cast("int"))


def add_concentrations(a: Column, unit_a: Column, analyte_a: Column, b: Column, unit_b: Column, analyte_b: Column) -> Column:
    """The sum in the first one's unit; null for different analytes."""
    return F.when(analyte_a == analyte_b, a + convert(b, unit_b, "ug/L") / convert(F.lit(1.0), unit_a, "ug/L"))


def record_status(flag: Column, result: Column) -> Column:
    """detected, not-detected or reported: a stated flag first, then the words of the result, then its number."""
    raw = F.trim(text_or(result))
    n = first_number(raw)
    return (
        F.when(flag, "detected").when(~flag, "not-detected").when(raw.rlike("(?i)^(<|ND|NON[- ]?DETECT)"), "not-detected")
        .when(n == 0, "not-detected").when(n > 0, "detected").otherwise("reported")
    )


def overall_message(active: Column, found: Column, total: Column, pfas: Column) -> Column:
    """Struct of tone and title; a PFAS exceedance comes before violations, missing results before detections."""
    tone = F.when((pfas > 0) | (active > 0), "attention").when(total == 0, "unknown").when(found > 0, "neutral").otherwise("good")
    title = (
        F.when(pfas > 0, "A PFAS result is at or above the EPA limit").when(active > 0, "Active compliance items found")
        .when(total == 0, "No recent contaminant results were attached").otherwise("No active EPA violations found")
    )
    return F.struct(tone.alias("tone"), title.alias("title"))


def actionability(analyte: Column) -> Column:
    """The standards whose certified claims can cover a contaminant; none for those without one."""
    known = F.create_map(*[x for k, v in STANDARDS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.try_element_at(known, normalized(analyte)), F.array().cast("array<string>"))


def well_pathway(without_system: Column, permits: Column, sites: Column) -> Column:
    """Whether the private-well path applies; its evidence is context, so only a laboratory test is recommended."""
    on = F.coalesce(without_system, F.lit(False))
    return F.struct(on.alias("activated"), F.when(on, permits).alias("well_permits"), F.when(on, sites).alias("nearby_sites"), F.when(on, F.lit("certified-private-well-test")).alias("recommendation"))


def live_tier(url: Column, publisher: Column, title: Column) -> Column:
    """official-live, utility-live, community-unverified or journalism-or-other, the first that fits."""
    who = F.coalesce(F.nullif(publisher, F.lit("")), title, F.lit(""))
    return (
        F.when(text_or(url).rlike(OFFICIAL), "official-live").when(who.rlike(UTILITY), "utility-live")
        .when(F.coalesce(F.nullif(publisher, F.lit("")), url, F.lit("")).rlike(COMMUNITY), "community-unverified").otherwise("journalism-or-other")
    )


def evidence_role(url: Column, publisher: Column, title: Column) -> Column:
    """lead-only items are quarantined; the rest are context, official or not. None may corroborate."""
    both = F.concat_ws(" ", text_or(url), F.coalesce(F.nullif(publisher, F.lit("")), title, F.lit("")))
    return F.when(both.rlike(LEADS), "lead-only").when(text_or(url).rlike(OFFICIAL), "official-context").otherwise("context-only")


def source_family(source: Column, publisher: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(F.nullif(source, F.lit("")), publisher, F.lit(""))))
    return F.when(s.rlike("SDWIS|EPA"), "EPA-SDWIS").when(s.rlike("WQP|STORET|NWIS|USGS"), "WQP").when(F.contains(s, F.lit("CCR")), "CCR").when(s.rlike("FDEP|DEP|CHEMICAL"), "FDEP").otherwise("OTHER")


def canonical_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text_or(value)), "[^A-Z0-9]+", " "))


def source_applies(pwsids: Column, cities: Column, providers: Column, pwsid: Column, city: Column, provider: Column) -> Column:
    """Each list that is not empty must admit the place: id in it, city in either's name, provider's name holding a pattern."""
    c, p = canonical_text(city), canonical_text(provider)
    some = lambda xs: F.coalesce(F.size(xs), F.lit(0)) > 0
    by_id = ~some(pwsids) | F.array_contains(pwsids, pwsid)
    by_city = ~some(cities) | F.exists(cities, lambda x: F.contains(c, canonical_text(x)) | F.contains(canonical_text(x), c))
    by_name = ~some(providers) | F.exists(providers, lambda x: F.contains(p, canonical_text(x)))
    return F.coalesce(by_id & by_city & by_name, F.lit(False))


def neighborhoods(properties: Column, stated: Column, most: int = 6) -> Column:
    """Up to six neighbourhood names of a parcel: the stated one, then fields whose name speaks of one, phases cut off, each once.

    Only a report of six is shown, in field order; empty, numeric, very short or long and placeholder values are no names.
    """
    key = r"(?i)(SUBDIV|SUBD|PLAT_NAME|PLATNAME|COMMUNITY|NEIGHBOR|NBHD|DEVELOPMENT|MOBILE.*HOME|PARK_NAME|PROJECT_NAME)"
    named = F.filter(F.map_entries(F.coalesce(properties, F.create_map().cast("map<string,string>"))), lambda e: e["key"].rlike(key) & e["value"].isNotNull())
    values = F.filter(F.transform(named, lambda e: F.trim(e["value"])), lambda s: F.length(s).between(4, 90) & ~s.rlike(r"^\d+(\.\d+)?$") & ~s.rlike("(?i)^(N/A|NA|NONE|UNKNOWN|NULL)$"))
    cut = F.transform(values, lambda s: F.trim(F.regexp_replace(s, r"(?i)\s+(PHASE|PH)\s*\d+[A-Z]?$", "")))
    every = F.concat(F.when(F.coalesce(stated, F.lit("")) != "", F.array(stated)).otherwise(F.array().cast("array<string>")), cut)
    # The first of each canonical form stays.
    once = F.aggregate(every, F.array().cast("array<string>"), lambda acc, s: F.when((canonical_text(s) == "") | F.exists(acc, lambda x: canonical_text(x) == canonical_text(s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.slice(once, 1, most)


def review(result_level: Column, contradictions: Column, single: Column, severe: Column) -> Column:
    """Struct of an adversarial review: challenges counted, status, severity, and whether a human must look."""
    n = F.when(F.coalesce(result_level, F.lit("")) != "exact-household-sample", 1).otherwise(0) + contradictions + F.when(single > 0, 1).otherwise(0)
    return F.struct(n.cast("int").alias("challenges"), F.when(n > 0, "challenged").otherwise("passed").alias("status"), F.when(severe, "high").otherwise("normal").alias("severity"), (severe | (n > 3)).alias("human_review_required"))


def adapt(df: DataFrame, default_source: str = "unknown", default_family: str = "unknown", default_level: str = "public-water-system/compliance sample") -> DataFrame:
    """The table with the columns that every record has, drawn from whatever names it came with.

    Dates become ISO days and keep their raw text; detected needs a number above zero and at the limit or above, and no
    non-detect word in result or remarks. Missing columns give nulls.
    """
    col = lambda *names: coalesced(df, *names)
    analyte = F.coalesce(col("analyte", "metal", "contaminant"), F.lit("UNKNOWN"))
    limit = F.coalesce(first_number(col("mdl")), first_number(col("rdl")), first_number(col("detection_limit")))
    remark = F.coalesce(F.upper(col("remarks")).rlike(r"\bND\b|NON-?DETECT|BELOW (THE )?(MDL|DETECTION|REPORTING)|<\s*(MDL|RL|RDL)"), F.lit(False))
    day = any_date(col("sample_date"))
    out = {
        "pwsid": normalize_pwsid(col("pwsid")), "raw_sample_date": col("sample_date"), "sample_date": day, "reported_at": any_date(col("sample_timestamp", "reported_at", "analysis_date")),
        "metal": analyte, "analyte": analyte, "contaminant": F.coalesce(col("analyte", "contaminant", "metal"), F.lit("UNKNOWN")), "contam_code": col("analyte_code", "contam_code"),
        "detected": ~is_non_detect(col("result")) & ~remark & detected(col("result"), limit), "detection_limit": limit,
        "sample_point": col("location_code", "entry_point", "sample_point"), "facility_id": col("entry_point", "location_code", "facility_id"), "location_code": col("location_code"),
        "source_id": F.coalesce(col("source_id"), F.lit(default_source)), "source_family": F.coalesce(col("source_family", "publisher"), F.lit(default_family)),
        "source_year": F.coalesce(F.year(day).cast("string"), col("source_year")), "source_file": col("source_file"), "source_level": F.coalesce(col("source_level"), F.lit(default_level)),
        "lab_id": col("lab_id"), "method_id": col("method_id"), "record_fingerprint": col("record_fingerprint"),
    }
    return df.withColumns(out)
