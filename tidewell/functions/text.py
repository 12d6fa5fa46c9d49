"""Column builders for names, addresses, notices and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell no provider from another, equal tokens, street suffixes and directions.
NOISE = ["CITY", "TOWN", "OF", "THE", "A", "DEPT", "DEPARTMENT", "DIV", "DIVISION", "DBA", "UTILITIES", "UTILITY", "UTIL", "WATERWORKS", "WORKS", "PUBLIC", "WATER", "SYSTEM", "SYSTEMS", "SYS", "PWS", "SERVICE", "SERVICES", "SVC", "AREA", "DISTRICT", "DIST", "WPS", "WTP", "WWTP", "WSP", "AND", "CO", "CORP", "INC", "LLC", "LP", "LTD", "IMPROVEMENT"]
EQUAL_TOKENS = {"ASSOC": "ASSOCIATION", "ASSN": "ASSOCIATION", "GOVT": "GOVERNMENTAL", "AUTH": "AUTHORITY", "MULLETT": "MULLET"}
SUFFIXES = {"STREET": "ST", "ROAD": "RD", "DRIVE": "DR", "LANE": "LN", "AVENUE": "AVE", "BOULEVARD": "BLVD", "COURT": "CT", "PLACE": "PL", "CIRCLE": "CIR", "TRAIL": "TRL", "PARKWAY": "PKWY", "TERRACE": "TER", "HIGHWAY": "HWY", "TURNPIKE": "TPKE", "COVE": "CV"}
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
LIFTED = r"(?i)\b(LIFTED|RESCINDED|DISCONTINUED|CLEARED|NO LONGER IN EFFECT|CANCELLED|CANCELED)\b"
ACTIVE = r"(?i)\b(ISSUED|IN EFFECT|ACTIVE|PRECAUTIONARY BOIL WATER|BOIL WATER NOTICE|BOIL WATER ADVISORY)\b"
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def canonical_tokens(name: Column) -> Column:
    """Upper-case tokens without accents, bracketed parts, punctuation, long numbers and noise words; equal tokens as one."""
    plain = F.upper(F.translate(name, ACCENTED, PLAIN))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", " "), r"[^A-Z0-9]+", " ")
    tokens = F.split(F.trim(F.regexp_replace(plain, r"\b[0-9]{5,}\b", " ")), r"\s+")
    known = _map(EQUAL_TOKENS)
    tokens = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t))
    noise = F.array(*[F.lit(w) for w in NOISE])
    return F.array_distinct(F.filter(tokens, lambda t: (t != "") & ~F.array_contains(noise, t)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens of two distinct arrays; two empty ones share nothing."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def canonical_address(text: Column) -> Column:
    """Upper case, signs as spaces, suffixes and directions in their short form."""
    short = _map(SUFFIXES | DIRECTIONS)
    words = F.split(F.trim(F.regexp_replace(F.upper(F.regexp_replace(text, "['\"]", "")), "[^A-Z0-9]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def house_number(address: Column) -> Column:
    return F.regexp_extract(canonical_address(F.substring_index(address, ",", 1)), r"^(\d+) ", 1).try_cast("int")


def street(address: Column) -> Column:
    return F.regexp_extract(canonical_address(F.substring_index(address, ",", 1)), r"^\d+ (.+)$", 1)


def in_address_range(text: Column, number: Column, road: Column) -> Column:
    """Whether the text names a range of house numbers of the road that holds the number."""
    flat = F.regexp_replace(F.upper(text), r"[^A-Z0-9-]+", " ")
    low = F.regexp_extract_all(flat, F.lit(r"\b(\d+) ?- ?(\d+) [A-Z0-9 ]+?\b(?:ST|RD|DR|LN|AVE|BLVD|CT|PL)\b"), F.lit(1))
    high = F.regexp_extract_all(flat, F.lit(r"\b(\d+) ?- ?(\d+) [A-Z0-9 ]+?\b(?:ST|RD|DR|LN|AVE|BLVD|CT|PL)\b"), F.lit(2))
    name = F.regexp_extract_all(flat, F.lit(r"\b\d+ ?- ?\d+ ([A-Z0-9 ]+?\b(?:ST|RD|DR|LN|AVE|BLVD|CT|PL))\b"), F.lit(1))
    return F.exists(F.arrays_zip(low.alias("a"), high.alias("b"), name.alias("c")), lambda r: (r["c"] == road) & number.between(F.least(r["a"].cast("int"), r["b"].cast("int")), F.greatest(r["a"].cast("int"), r["b"].cast("int"))))


def notice_status(text: Column) -> Column:
    return F.when(text.rlike(LIFTED), "lifted").when(text.rlike(ACTIVE), "active").otherwise("not-stated")


def strip_html(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, white space as one space, common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def links(html: Column) -> Column:
    """Structs of href and label of every link, in order."""
    pattern = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))


def years(text: Column) -> Column:
    """The latest year from 2000 to 2199 that the text names."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b(2[01][0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int")))


def excerpt(text: Column, term: Column, before: int = 40, length: int = 120) -> Column:
    """The text around the first place of the term."""
    at = F.instr(F.lower(text), F.lower(term))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - before), F.lit(length)))
