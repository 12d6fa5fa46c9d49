"""Readers for loose inputs: missing files, sniffed delimiters, GeoJSON, and keyed two-pass scans."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, bool]:
    """The rows and whether the file was there; a missing file gives no rows and False, so that it can't pass as clean."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path), True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema), False


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()).strip("_")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header: the separator is the commonest of tab, comma, bar and semicolon in its first line."""
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    sep = max("\t,|;", key=line.count)
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.toDF(*[snake(c) for c in df.columns])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: properties as a map and polygons as rings of points; a single polygon is a list of one."""
    schema = "features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature_id", "f"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "MultiPolygon", F.from_json(text, many)).otherwise(F.array(F.from_json(text, one)))
    return rows.select("feature_id", F.col("f.properties").alias("properties"), kind.alias("geometry_type"), polygons.alias("polygons"))


def coalesced(df: DataFrame, *names: str) -> Column:
    """The first of these columns that the table has and that is not empty."""
    have = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def table_kind(name: str, headers: list[str]) -> str:
    """What a file holds, by the first rule that its name or headers meet."""
    text, have = name.lower(), set(headers)
    for kind, hint, column in (("violations", "violation", "violation_code"), ("samples", "lcr|sample", "sample_measure"), ("site_visits", "site_visit", "visit_date"), ("areas", "geographic|service_area", "area_type_code"), ("systems", "pub_water|system", "pws_name")):
        if re.search(hint, text) or column in have:
            return kind
    return "unknown"


def keyed_scan(keys: DataFrame, tables: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Second pass of a bulk scan: each table's rows whose key the first pass has found."""
    found = keys.select(key).distinct()
    return {name: t.join(found, key, "left_semi") for name, t in tables.items()}


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Rows of equal content once."""
    return rows.dropDuplicates()


def manifest_status(parts: DataFrame, ok: str = "ok") -> DataFrame:
    """synced if every part is, partial if some are, else failed."""
    return parts.agg(F.when(F.bool_and(ok), "synced").when(F.bool_or(ok), "partial").otherwise("failed").alias("status"), F.count("*").alias("parts"))


# Metals by the order in which a description is searched for them; columns and codes that name the county.
METALS = ["ANTIMONY", "ARSENIC", "BARIUM", "BERYLLIUM", "CADMIUM", "CHROMIUM", "COPPER", "LEAD", "MERCURY", "SELENIUM", "THALLIUM", "NICKEL", "ALUMINUM", "IRON", "MANGANESE", "SILVER", "ZINC"]
STATE_COLUMNS = ("state_code", "state", "state_served", "primacy_agency_code", "state_code_served")
COUNTY_COLUMNS = ("county_served", "county_name", "county", "area_name", "geographic_area_name", "geographic_area_description", "counties_served")
COUNTY_CODE_COLUMNS = ("county_code", "county_fips", "fips_county_code", "geographic_area_code")
COUNTY_CODES = ("117", "12117", "12-117", "US:12:117")
#: What a chemistry export calls its columns, and what they are called here.
CHEMISTRY = {
    "PWSID": "pwsid", "MAILINGNAME": "system_name", "SYSTEMTYPE": "system_type", "POPULATION": "population", "CONTAMGROUP": "contaminant_group", "CONTAMCODE": "analyte_code", "CONTAMDESC": "analyte",
    "SAMPLETYPE": "sample_type", "RESULTS": "result", "UOM": "unit", "MCL": "mcl", "SAMPLEDATE": "sample_date", "SAMPTIMESTAMP": "sample_timestamp", "LOCATIONCODE": "location_code", "ENTRYPOINT": "entry_point",
    "LAB": "lab_id", "METHOD": "method_id", "ANALYSISDATE": "analysis_date", "MDL": "mdl", "RDL": "rdl", "SAMPLENUMBER": "sample_id", "REMARKS": "remarks",
}
DIGEST = ("pwsid", "sample_id", "analyte_code", "sample_date", "location_code", "lab_id", "method_id", "result", "unit")


def read_family(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], key: str = "pwsid") -> tuple[dict[str, DataFrame], DataFrame]:
    """A folder's JSON tables by name, their key normalised where they have it, and which of the files were there."""
    from tidewell.functions.measure import normalize_pwsid

    tables, there = {}, []
    for name, schema in schemas.items():
        df, found = read_json(spark, f"{folder}/{name}.json", schema)
        tables[name] = df.withColumn(key, normalize_pwsid(F.col(key))) if key in df.columns else df
        there.append((name, found))
    return tables, spark.createDataFrame(there, "name string, ok boolean")


def chemistry_rows(export: DataFrame, prefix: str, source: str, publisher: str) -> DataFrame:
    """Rows of a chemistry export whose system id starts with `prefix`, in this library's column names, with a digest."""
    rows = export.select(*[(F.col(old) if old in export.columns else F.lit(None)).cast("string").alias(new) for old, new in CHEMISTRY.items()]).filter(F.startswith("pwsid", F.lit(prefix)))
    rows = rows.withColumns({"analyte": F.trim("analyte"), "contaminant_group": F.trim("contaminant_group"), "source_id": F.lit(source), "publisher": F.lit(publisher)})
    return rows.withColumn("record_fingerprint", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in DIGEST]), 256))


def metal_of(description: Column) -> Column:
    """The first metal in list order that a description contains; null without one."""
    return F.get(F.filter(F.array(*[F.lit(m) for m in METALS]), lambda m: F.contains(F.upper(description), m)), F.lit(0))


def in_county(df: DataFrame, name: str = "SEMINOLE", state: str = "FL", state_name: str = "FLORIDA") -> Column:
    """Whether a row's fields name the county, and the state by its own field or by the prefix of the system id."""
    joined = lambda names: F.upper(F.concat_ws(" ", *[F.trim(F.col(c).cast("string")) for c in names if c in df.columns]))
    states, code = joined(STATE_COLUMNS), joined(COUNTY_CODE_COLUMNS)
    in_state = F.array_contains(F.split(states, r"\s+"), state) | F.contains(states, F.lit(state_name))
    pid = F.coalesce(F.upper(coalesced(df, "pwsid", "pws_id")), F.lit(""))
    return (F.contains(joined(COUNTY_COLUMNS), F.lit(name)) | F.trim(code).isin(*COUNTY_CODES)) & (in_state | F.startswith(pid, F.lit(state)))


def occurrence_rows(table: DataFrame, systems: DataFrame) -> DataFrame:
    """Rows of a national occurrence table that belong to registered systems; a '<' sign is a non-detect."""
    from tidewell.functions.measure import normalize_pwsid

    col = lambda *names: coalesced(table, *names)
    rows = table.select(
        normalize_pwsid(col("pwsid", "pws_id", "pwsid_")).alias("pwsid"), col("pws_name").alias("pws_name"), col("contaminant").alias("characteristic_name"), col("analytical_result_value", "result").alias("result_value"),
        F.coalesce(col("units"), F.lit("ng/L")).alias("result_unit"), col("collection_date", "sample_collection_date").alias("sample_date"), F.when(col("analytical_result_sign") == "<", "non-detect").alias("detection_condition"), F.lit("public-water-system").alias("granularity"),
    )
    return rows.join(systems.select("pwsid").distinct(), "pwsid", "left_semi")


def of_characteristics(results: DataFrame, wanted: list[str], column: str = "characteristic_name") -> DataFrame:
    """Rows of an earlier download that are about one of these characteristics, by name without regard to case."""
    return results.filter(F.lower(F.trim(column)).isin(*[w.strip().lower() for w in wanted]))


def well_samples(table: DataFrame, characteristic: str, source: str) -> DataFrame:
    """Private-well samples from a table whose columns go by several names; unit ug/L unless it says otherwise."""
    col = lambda *names: coalesced(table, *names)
    return table.select(
        col("well_id", "id", "sample_id").alias("well_id"), F.lit(characteristic).alias("characteristic_name"), col("result", "concentration", "value", "dioxane_ug_l").alias("result_value"), F.coalesce(col("unit"), F.lit("ug/L")).alias("result_unit"),
        col("sample_date", "date").alias("sample_date"), col("latitude", "lat").alias("latitude"), col("longitude", "lon").alias("longitude"), F.lit("private-well-sample").alias("granularity"), F.lit(source).alias("source"),
    )


def labelled_union(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Tables under each other with the name of the table each row is from; columns that one lacks are null there."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(label, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def pdf_links(pages: DataFrame, page_id: str, html: str, preferred: str, origin: str) -> DataFrame:
    """Each page's distinct PDF links in page order: those that fit `preferred`, else, if none does, every one."""
    every = F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+\.pdf)["']"""), F.lit(1))
    fit = F.filter(every, lambda u: u.rlike(preferred))
    full = lambda u: F.when(u.rlike("(?i)^http"), u).when(F.startswith(u, F.lit("/")), F.concat(F.lit(origin), u)).otherwise(F.concat(F.lit(origin + "/"), u))
    links = F.array_distinct(F.transform(F.when(F.size(fit) > 0, fit).otherwise(every), full))
    out = pages.select(page_id, F.posexplode(links).alias("position", "url"))
    return out.withColumn("title", F.regexp_replace(F.regexp_replace(F.substring_index("url", "/", -1), "-", " "), r"(?i)\.pdf$", ""))


UNIT_LINE = r"(?i)^\s*([A-Za-z][A-Za-z0-9 ()/.,+&'-]{2,90}?)\s+([<>≤≥]?\s*\d+(?:\.\d+)?)\s*(mg/L|ug/L|µg/L|ppm|ppb|pCi/L|NTU)\b"


def report_rows(reports: DataFrame, report_id: str, text: str, most: int = 100) -> DataFrame:
    """Lines of a report that state a name, a value and a unit; a number without a unit is never guessed at.

    Only the first `most` lines of a report count, and lines about definitions don't.
    """
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    name = lambda x: F.regexp_replace(F.regexp_extract(x, UNIT_LINE, 1), r"^[ .:\-]+|[ .:\-]+$", "")
    found = F.slice(F.filter(lines, lambda x: x.rlike(UNIT_LINE) & ~F.upper(name(x)).rlike("MCLG|DEFINITION|ABBREVIATION|UNIT OF MEASURE")), 1, most)
    line = F.col("source_line")
    out = reports.select(report_id, F.posexplode(found).alias("position", "source_line"))
    return out.select(report_id, "position", name(line).alias("contaminant"), F.regexp_replace(F.regexp_extract(line, UNIT_LINE, 2), " ", "").alias("reported_value"), F.regexp_extract(line, UNIT_LINE, 3).alias("unit"), F.substring(line, 1, 500).alias("source_line"))


def report_index(configured: DataFrame, links: DataFrame, systems: DataFrame, finder: str) -> DataFrame:
    """Reports by system: configured ones by each of their ids, discovered ones, and a finder row for community systems without any."""
    own = configured.select(F.explode("pwsids").alias("pwsid"), "url", "report_year", F.lit("configured").alias("kind"))
    found = links.select("pwsid", "url", "report_year", F.lit("discovered").alias("kind"))
    known = own.unionByName(found)
    rest = systems.filter(F.upper("system_type") == "COMMUNITY").join(known.select("pwsid").distinct(), "pwsid", "left_anti")
    return known.unionByName(rest.select("pwsid", F.lit(finder).alias("url"), F.lit(None).cast(known.schema["report_year"].dataType).alias("report_year"), F.lit("finder").alias("kind")))


def largest_member(archives: DataFrame) -> DataFrame:
    """From zip files (path, content, as the binaryFile source gives them): each one's largest csv or txt member, as text.

    A file that is no archive, or has no such member, gives no row; one archive is one task's row.
    """
    import io
    import zipfile

    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for path, blob in zip(pdf["path"], pdf["content"], strict=True):
                if blob is None or bytes(blob[:2]) != b"PK":
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(blob))) as z:
                        members = [m for m in z.infolist() if m.filename.lower().endswith((".csv", ".txt"))]
                        if members:
                            best = max(members, key=lambda m: m.file_size)
                            out.append((path, best.filename, z.read(best).decode("utf-8", "replace")))
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    continue
            yield pd.DataFrame(out, columns=["path", "member", "text"])

    return archives.select("path", "content").mapInPandas(run, "path string, member string, text string")


def search_results(pages: DataFrame, page_id: str, html: Column, most: int = 10) -> DataFrame:
    """A result page's first ten hits: title, address, publisher and snippet.

    A redirecting link gives the address it carries; a snippet belongs to a hit only if it comes before the next hit.
    """
    link = r"""(?is)<a[^>]+class="[^"]*result__a[^"]*"[^>]+href="([^"]+)"[^>]*>(.*?)</a>"""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]+>", " "), "&amp;", "&"), r"\s+", " "))
    parts = F.slice(F.split(F.regexp_replace(html, r"""(?is)(<a[^>]+class="[^"]*result__a)""", "\u0001$1"), "\u0001"), 2, most)
    out = pages.select(page_id, F.posexplode(parts).alias("position", "_part")).filter(F.col("_part").rlike(link))
    href = F.regexp_replace(F.regexp_extract("_part", link, 1), "&amp;", "&")
    carried = F.nullif(F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1), F.lit(""))
    url = F.coalesce(F.try_url_decode(carried), F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href))
    snippet = F.regexp_extract("_part", r"""(?is)class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</(?:a|div)>""", 1)
    out = out.select(page_id, "position", plain(F.regexp_extract("_part", link, 2)).alias("title"), url.alias("url"), plain(snippet).alias("excerpt"))
    return out.withColumn("publisher", F.coalesce(F.lower(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))), F.lit("")))
