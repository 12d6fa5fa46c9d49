"""Cases with values for records, PFAS and loose sources."""

import io
import math
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import pfas as P
from tidewell.functions import records as R
from tidewell.functions import statistics as S
from tidewell.operators import records, stats
from tidewell.sources import readers

LEVELS = {"PFOA": 4.0, "PFOS": 4.0}


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first())


def test_pfas_units(spark):
    pairs = [("5.2", "ng/L"), ("0.006", "ug/L"), ("1", "mg/L"), ("4", "ppt"), ("0.006", "µg/L"), ("3", ""), ("3", None), ("<4", "ng/L"), (None, "ng/L"), ("7", "furlong")]
    got = one(spark, *[P.to_ng_l(F.lit(v).cast("string"), F.lit(u).cast("string")) for v, u in pairs])
    assert got == (5.2, 6.0, 1e6, 4.0, 6.0, 3.0, 3.0, None, None, 7.0)


def test_pfas_results(spark):
    rows = [("PFOA", "4", "ng/L", None), ("perfluorooctane sulfonate", "3.9", "ng/L", None), ("PFBA", "9", "ng/L", None), ("PFOA", "<4", "ng/L", None), ("PFOA", "5", "ng/L", "Not Detected"), ("Chlorine", "1", "ng/L", None), ("PFQQQ", "0", "ng/L", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [tuple(r[0]) for r in df.select(P.pfas_result(*[F.col(c) for c in "abcd"], LEVELS)).collect()]
    assert got == [
        ("PFOA", 4.0, 4.0, "detected", True), ("PFOS", 3.9, 4.0, "detected", False), ("PFBA", 9.0, None, "detected", None), ("PFOA", None, 4.0, "not-detected", None),
        ("PFOA", None, 4.0, "not-detected", None), (None, 1.0, None, "detected", None), ("PFQQQ", 0.0, None, "reported", None), (None, None, None, "reported", None),
    ]


def test_concentrations(spark):
    lit = lambda v, u, a: (F.lit(v), F.lit(u), F.lit(a))
    got = one(spark, R.compare_concentrations(*lit(1.0, "mg/L", "LEAD"), *lit(1000.0, "ppb", "LEAD")), R.compare_concentrations(*lit(1.0, "ng/L", "LEAD"), *lit(1.0, "ug/L", "IRON")), R.add_concentrations(*lit(1.0, "mg/L", "LEAD"), *lit(500.0, "ug/L", "LEAD")), R.convert(F.lit(1.0), F.lit("furlong"), "ug/L"))
    assert got == (0, None, 1.5, None)


def test_record_status_and_ids(spark):
    flag = F.lit(None).cast("boolean")
    status = [R.record_status(flag, F.lit(x).cast("string")) for x in ("<2", "ND", "0", "3.1", "present", None)]
    assert one(spark, *status) == ("not-detected", "not-detected", "not-detected", "detected", "reported", "reported")
    assert one(spark, *[R.pwsid_like(F.lit(x).cast("string")) for x in ("FL3590001", " 00359001 ", "3590001X", "12345", None)]) == ("3590001", "359001", None, None, None)


def test_adapter_takes_any_names(spark):
    df = spark.createDataFrame([("FL3590001", "3-JAN-2020", "LEAD", "5", "analysed; below detection", "2"), (None, "", None, "7", None, None)], "pwsid string, sample_date string, metal string, result string, remarks string, rdl string")
    a, b = R.adapt(df).collect()
    assert (a["pwsid"], str(a["sample_date"]), a["raw_sample_date"], a["analyte"], a["detected"], a["detection_limit"], a["source_year"]) == ("3590001", "2020-01-03", "3-JAN-2020", "LEAD", False, 2.0, "2020")
    assert (b["pwsid"], b["sample_date"], b["analyte"], b["detected"], b["lab_id"]) == (None, None, "UNKNOWN", True, None)


def test_normal_quantile(spark):
    got = one(spark, *[S.normal_quantile(F.lit(p)) for p in (0.5, 0.975, 0.01, 0.0, 1.0)])
    assert abs(got[0]) < 1e-9 and math.isclose(got[1], 1.959964, abs_tol=1e-5) and math.isclose(got[2], -2.326348, abs_tol=1e-5) and got[3:] == (None, None)


def test_imputation_needs_three_detects(spark):
    rows = [("a", i, float(2**i), None, False) for i in range(1, 6)] + [("a", 9, None, 1.5, True), ("b", 1, 4.0, None, False), ("b", 2, None, 1.0, True)]
    out = stats.impute_censored(spark.createDataFrame(rows, "k string, i int, v double, l double, c boolean"), ["k"], "i", "v", "l", "c")
    got = {(r["k"], r["i"]): r["value"] for r in out.collect()}
    assert got["a", 3] == 8.0 and 0 < got["a", 9] <= 1.5 and got["b", 2] is None
    assert stats.impute_censored(spark.createDataFrame([], "k string, i int, v double, l double, c boolean"), ["k"], "i", "v", "l", "c").count() == 0


def test_family_and_archives(spark, tmp_path):
    (tmp_path / "systems.json").write_text('[{"pwsid": "FL3590001", "name": "A"}]')
    schema = T.StructType().add("pwsid", "string").add("name", "string")
    tables, there = readers.read_family(spark, str(tmp_path), {"systems": schema, "violations": schema})
    assert tables["systems"].first()["pwsid"] == "3590001" and tables["violations"].count() == 0
    assert {r["name"]: r["ok"] for r in there.collect()} == {"systems": True, "violations": False}
    assert readers.manifest_status(there).first()["status"] == "partial"
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("a.csv", "x\n1")
        z.writestr("b.TXT", "longer text")
        z.writestr("c.pdf", "much longer than the others")
    files = spark.createDataFrame([("p", blob.getvalue()), ("broken", b"PK no archive"), ("plain", b"x"), ("none", None)], "path string, content binary")
    assert [tuple(r) for r in readers.largest_member(files).collect()] == [("p", "b.TXT", "longer text")]


def test_report_rows_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Copper 1.3 ppm\r\nMCLG goal 5 ppb\nBarium ≤ 2 mg/L and more")], "i int, t string")
    assert [(r["i"], r["contaminant"], r["reported_value"], r["unit"]) for r in readers.report_rows(df, "i", F.col("t")).collect()] == [(3, "Copper", "1.3", "ppm"), (3, "Barium", "≤2", "mg/L")]


def test_report_index_finds_the_uncovered(spark):
    configured = spark.createDataFrame([(["1", "2"], "u", 2020)], "pwsids array<string>, url string, report_year int")
    links = spark.createDataFrame([("3", "v", 2021)], "pwsid string, url string, report_year int")
    systems = spark.createDataFrame([("1", "COMMUNITY"), ("4", "Community"), ("5", "TNC")], "pwsid string, system_type string")
    got = sorted((r["kind"], r["pwsid"], r["report_year"]) for r in readers.report_index(configured, links, systems, "f").collect())
    assert got == [("configured", "1", 2020), ("configured", "2", 2020), ("discovered", "3", 2021), ("finder", "4", None)]


def test_a_laboratory_that_stands_twice(spark):
    """The active entry counts, then the one that lasts longest, whatever order they come in."""
    import datetime as dt

    labs = [("L1", "One", "revoked", None, True), ("L1", "One", "active", dt.date(2023, 1, 1), True), ("l1 ", "One", "active", dt.date(2030, 1, 1), True), ("L2", "Two", "active", dt.date(2020, 1, 1), True), ("L2", "Two", "active", None, True)]
    rows = [(i, "k", "1", f"o{i}", "s", lab, name, dt.date(2024, 5, 1)) for i, (lab, name) in enumerate([("L1", None), ("L2", None), (None, "one"), (None, "Nobody")])]
    samples = spark.createDataFrame(rows, "rid int, k string, result string, origin string, source string, lab string, lab_name string, d date")
    for entries in (labs, labs[::-1]):
        out = records.verify(samples, ["k"], "rid", "result", "origin", "source", spark.createDataFrame(entries, "lab_id string, name string, status string, expires_on date, certified boolean"), "lab", "lab_name", "d")
        got = {r["rid"]: r["accreditation"] for r in out.collect()}
        assert got[0] == got[1] == got[2] == "accredited" and got[3] != "accredited"
