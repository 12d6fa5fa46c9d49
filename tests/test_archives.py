"""Members of archives row by row, with damage told and both passes of a bulk scan."""

import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.sources import archives


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("geographic_areas.csv", "PWSID,County Served,Area Type Code\nP1,Here,CN\nP2,There,CN\nP3,\"Here, too\",CN\n\n")
        z.writestr("violations.CSV", "﻿PWS id,PWSID,Violation-Code\nx,P1,7\nx,P1,7\ny,P2,8\nz,P3,9\nz,P9,1\n")
        z.writestr("notes.txt", "a\n1\n")
        z.writestr("image.png", b"\x89PNG")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("more_violations.csv", "PWSID,Violation-Code\nP3,9\nP3,10\n")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 this is no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    return tmp_path


def test_rows_and_damage(spark, folder):
    rows = archives.archive_rows(spark, str(folder)).collect()
    good = [(r["member"], r["kind"], r["place"], r["fields"]) for r in rows if r["reason"] is None]
    assert ("violations.CSV", "violations", 3, {"pws_id": "y", "pwsid": "P2", "violation_code": "8"}) in good
    assert ("geographic_areas.csv", "areas", 3, {"pwsid": "P3", "county_served": "Here, too", "area_type_code": "CN"}) in good and len(good) == 3 + 5 + 1 + 2
    assert sorted(r["archive"].rsplit("/", 1)[1] for r in rows if r["reason"]) == ["broken.zip", "empty.zip"]


def test_largest_and_nothing(spark, folder, tmp_path_factory):
    with zipfile.ZipFile(folder / "c.zip", "w") as z:
        z.writestr("small.csv", "a\n1\n")
        z.writestr("large.txt", "a\n" + "2\n" * 50)
    assert {r["member"] for r in archives.archive_rows(spark, str(folder / "c.zip"), largest=True).collect()} == {"large.txt"}
    assert archives.archive_rows(spark, str(tmp_path_factory.mktemp("none"))).count() == 0


def test_a_damaged_member_keeps_the_rows_before(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("systems.csv", "pwsid\n" + "".join(f"P{i}\n" for i in range(20_000)))
    data = bytearray((tmp_path / "d.zip").read_bytes())
    data[90_000] ^= 1  # its checksum no longer holds
    (tmp_path / "d.zip").write_bytes(bytes(data))
    rows = archives.archive_rows(spark, str(tmp_path / "d.zip")).collect()
    told = [r for r in rows if r["reason"]]
    assert len(told) == 1 and "CRC" in told[0]["reason"].upper() and len(rows) > 10_000


def test_a_member_is_read_in_pieces(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("systems.csv", "w") as f:
        f.write(b"pwsid,pws_name\n")
        for _ in range(400):
            f.write(b"P1,a name that stands often\n" * 4000)  # 45 MB
    reader = archives._Reader(str(tmp_path / "big.zip"), False)
    tracemalloc.start()
    rows = reader.read(reader.partitions()[0])
    for _ in range(300_000):
        next(rows)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_two_passes(spark, folder):
    rows = archives.archive_rows(spark, str(folder))
    kept, damage = archives.two_passes(rows, lambda f: F.coalesce(f["county_served"], F.lit("")).startswith("Here"), known=spark.createDataFrame([("P9",)], "pwsid string"))
    got = sorted((r["kind"], r["pwsid"], r["fields"].get("violation_code")) for r in kept.collect())
    assert got == [("areas", "P1", None), ("areas", "P3", None), ("violations", "P1", "7"), ("violations", "P3", "10"), ("violations", "P3", "9"), ("violations", "P3", "9"), ("violations", "P9", "1")]
    assert damage.count() == 2
