"""Column builders for laboratory measurements: qualifiers, censoring, units, detection, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors from a unit to micrograms per litre.
MICROGRAMS = {"UG/L": 1.0, "MCG/L": 1.0, "PPB": 1.0, "MG/L": 1000.0, "PPM": 1000.0, "NG/L": 0.001, "PPT": 0.001, "G/L": 1e6}
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
#: ND, BDL, NON-DETECT and results below a limit.
NON_DETECT = r"(?i)^\s*(<|ND\s*$|BDL\s*$|NON-?DETECT)"


def normalize_pwsid(value: Column) -> Column:
    """The system id: no country or state prefix, digits only, the last seven of them if there are more."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(F.trim(value.cast("string"))), "^US-?", ""), "^FL", ""), "[^0-9]", "")
    return F.nullif(F.when(F.length(digits) >= 7, F.right(digits, F.lit(7))).otherwise(digits), F.lit(""))


def first_number(value: Column) -> Column:
    """The first number anywhere in a text; missing stays missing."""
    return F.regexp_extract(value, f"({NUMBER})", 1).try_cast("double")


def qualifier(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(value), r"^([<>]=?|~)", 1), F.lit(""))


def anchored_number(value: Column) -> Column:
    """The number that a result states, after an optional qualifier; text around it makes it missing."""
    return F.regexp_extract(F.trim(value), rf"^(?:[<>]=?|~)?\s*({NUMBER})\s*$", 1).try_cast("double")


def normalized(value: Column) -> Column:
    """Upper case, trimmed, white space as one space."""
    return F.regexp_replace(F.upper(F.trim(value.cast("string"))), r"\s+", " ")


def normalize_unit(unit: Column) -> Column:
    """Upper case with any micro sign written U."""
    return F.upper(F.translate(F.regexp_replace(unit, r"\s", ""), "µμΜ", "UUU"))


def unit_factor(unit: Column) -> Column:
    """Factor to micrograms per litre; null for a unit that is not a mass concentration."""
    known = F.create_map(*[F.lit(x) for pair in MICROGRAMS.items() for x in pair])
    return F.try_element_at(known, normalize_unit(unit))


def is_non_detect(result: Column) -> Column:
    return F.coalesce(result.rlike(NON_DETECT), F.lit(False))


def measurement(result: Column, unit: Column, limit: Column | None = None) -> Column:
    """Struct of a parsed result: qualifier, value, value in ug/L, limit in ug/L, and whether and how it is censored.

    A non-detect has no value in ug/L, only a limit: its own number, else the laboratory's.
    """
    number, factor, below = anchored_number(result), unit_factor(unit), is_non_detect(result)
    own_limit = F.coalesce(number, limit) if limit is not None else number
    return F.struct(
        result.alias("raw_result"), unit.alias("raw_unit"), qualifier(result).alias("qualifier"), number.alias("numeric_value"),
        F.when(~below, number * factor).alias("canonical_value"), F.when(below, own_limit * factor).alias("detection_limit_ug_l"),
        below.alias("censored"), F.when(below, F.lit("left")).when(qualifier(result).startswith(">"), F.lit("right")).alias("censoring_type"), factor.alias("conversion_factor"),
    )


def detected(result: Column, limit: Column) -> Column:
    """Not a non-detect, above zero, and at or above the detection limit."""
    number = first_number(result)
    return ~is_non_detect(result) & F.coalesce((number > 0) & (number >= F.coalesce(limit, F.lit(0.0))), F.lit(False))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 over trimmed, upper-case fields; a missing field keeps its place."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.upper(F.trim(f.cast("string"))), F.lit("")) for f in fields]), 256)


def origin_key(sample_id: Column, *fields: Column) -> Column:
    """An explicit sample id, or a digest of the sampling event; who published it plays no part."""
    return F.when(F.trim(sample_id) != "", F.concat(F.lit("EXPLICIT:"), F.upper(F.trim(sample_id)))).otherwise(F.concat(F.lit("DERIVED:"), fingerprint(*fields)))


def year_quarter(date: Column) -> Column:
    return F.coalesce(F.concat(F.year(date), F.lit("-Q"), F.quarter(date)), F.lit("UNKNOWN"))


def any_date(value: Column) -> Column:
    """A date in ISO, month/day/year or day-month-name-year form."""
    v = F.trim(value)
    iso, us, named = F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(v, r"^(\d{1,2}/\d{1,2}/\d{4})", 1), F.regexp_extract(v, r"^(\d{1,2}-[A-Za-z]{3}-\d{4})$", 1)
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd"), F.try_to_date(F.nullif(us, F.lit("")), "M/d/yyyy"), F.try_to_date(F.initcap(F.lower(F.nullif(named, F.lit("")))), "d-MMM-yyyy"))


def granularity(sample_type: Column) -> Column:
    """Where a sample stands: tap, source-well, treatment-entry or system."""
    t = F.upper(sample_type)
    return F.when(t.rlike("TAP|HOME|RESIDENT|HOUSEHOLD"), "tap").when(t.rlike("WELL|SOURCE"), "source-well").when(t.rlike("PLANT|ENTRY|POE"), "treatment-entry").otherwise("system")


def violation_active(status: Column, end_date: Column, as_of: Column) -> Column:
    """Closed words win over open words; without either, a violation is active until its end date."""
    s = F.upper(status)
    return F.when(s.rlike("RESOLVED|CLOSED|ARCHIVED|RETURNED"), False).when(s.rlike("OPEN|ACTIVE|UNADDRESSED"), True).otherwise(end_date.isNull() | (end_date > as_of))


def violation_kind(text: Column) -> Column:
    """health, monitoring or other, by words; health words win."""
    t = F.upper(text)
    health = t.rlike("MCL|MRDL|TREATMENT TECHNIQUE|HEALTH")
    return F.when(health, "health").when(t.rlike("MONITOR|REPORT|NOTICE"), "monitoring").otherwise("other")
