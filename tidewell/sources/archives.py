"""Delimited members of zip archives as a data source: a task a member, read row by row.

    spark.dataSource.register(Archives)
    spark.read.format("archive_members").load("folder or file")

A member is inflated as its rows are read, in pieces of fixed size, so that neither an archive nor a member has to fit in
memory. Rows: archive, member, kind (what the member holds, by its name and headers), place (from 1), fields (by snake-case
header), reason (null). A file that is no archive, or a member that can't be read on, gives a row with the reason alone, after
the rows before the damage. Option largest=true takes each archive's largest member only. Paths are local or shared ones, or
of a store that Arrow's file systems read.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewell.sources.readers import table_kind

SCHEMA = "archive string, member string, kind string, place long, fields map<string, string>, reason string"
#: Characters of a field at most; a longer one ends its member with a reason.
LONGEST_FIELD = 16_000_000
#: Damage that is told as a reason.
DAMAGE = (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, csv.Error, ValueError)


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path) else (pafs.LocalFileSystem(), path)
    return fs, at


def snake(name: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", "_", (name or "").strip().lower()).strip("_")


@dataclass
class Member(InputPartition):
    archive: str
    member: str | None
    reason: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, path: str, largest: bool):
        self.path, self.largest = path, largest

    def partitions(self) -> list[Member]:
        fs, at = _open(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        info = fs.get_file_info(at)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == pafs.FileType.File), key=lambda f: f.path):
            name = scheme + f.path
            try:
                with fs.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:  # the list of members alone
                    members = [m for m in z.infolist() if m.filename.lower().endswith((".csv", ".txt"))]
                if self.largest and members:
                    members = [max(members, key=lambda m: m.file_size)]
                out += [Member(name, m.filename) for m in members]
            except DAMAGE as e:
                out.append(Member(name, None, f"{type(e).__name__}: {e}"))
        return out or [Member("", None)]

    def read(self, partition: Member) -> Iterator[tuple]:
        name, member = partition.archive, partition.member
        if member is None:
            if partition.reason:
                yield name, None, None, None, None, partition.reason
            return
        csv.field_size_limit(LONGEST_FIELD)
        fs, at = _open(name)
        kind, place = None, 0
        try:
            with fs.open_input_file(at) as raw, zipfile.ZipFile(raw) as z, z.open(member) as stream:
                rows = csv.reader(io.TextIOWrapper(stream, "utf-8-sig", "replace", newline=""))
                headers = [snake(h) for h in next(rows, [])]
                kind = table_kind(member, headers)
                for row in rows:
                    if row:
                        place += 1
                        yield name, member, kind, place, {h: v.strip() for h, v in zip(headers, row) if h and v.strip()}, None
        except DAMAGE as e:
            yield name, member, kind, None, None, f"{type(e).__name__}: {e}"


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("largest", "false").lower() == "true")


def archive_rows(spark: SparkSession, path: str, largest: bool = False) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format("archive_members").option("largest", str(largest).lower()).load(path)


def two_passes(rows: DataFrame, here: Callable[[Column], Column], key: str = "pwsid", telling: tuple[str, ...] = ("systems", "areas"), known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the keys of this place, damage) of archive rows.

    The first pass reads the keys of rows of the `telling` kinds whose fields are `here`, beside those `known`; the second keeps every kind's rows
    of these keys, each once however often it stands. Damaged archives and members come apart, with the reason.
    """
    good, damage = rows.filter("reason is null"), rows.filter("reason is not null").select("archive", "member", "reason")
    keys = good.filter(F.col("kind").isin(*telling)).filter(here(F.col("fields"))).select(F.col("fields")[key].alias(key)).filter(F.col(key).isNotNull())
    keys = (keys if known is None else keys.unionByName(known.select(F.col(key).cast("string").alias(key)))).distinct()
    kept = good.filter("kind <> 'unknown'").withColumn(key, F.col("fields")[key]).join(keys, key, "left_semi")
    same = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    first = F.min_by(F.struct("archive", "member", "place", "fields"), F.struct("archive", "member", "place"))
    return kept.groupBy("kind", key, same.alias("_same")).agg(first.alias("r")).select("kind", key, "r.*"), damage
