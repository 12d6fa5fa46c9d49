"""Shared Spark steps of the corpus operators: group sizes, lineage cuts and keys that repeat."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Text bytes that one grouped task call gets, about.
GROUP_BYTES = 4_000_000


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir. Only a local master may do without it, with a new folder of
    its own; on a cluster that would lose what other machines need."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a reliable checkpoint, so that later steps neither recompute nor lose them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def group_count(docs: DataFrame, text: str = "text") -> int:
    """How many groups of about GROUP_BYTES the texts make; grows with the input."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count("*").alias("n")).first()
    return max(8, -(-((total["b"] or 0) + 64 * (total["n"] or 0)) // GROUP_BYTES))


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by bucket and key, and where each bucket begins (buckets + 1 places)."""
    b = bucket_of(keys, buckets)
    order = np.lexsort((keys, b))
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket, from its high bits."""
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


KEYS_SCHEMA = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
KEYS_DDL = "bucket int, g int, keys binary, counts binary"


def key_rows(g: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket that has keys of this group: its distinct keys and their counts here."""
    order, at = by_bucket(keys, buckets)
    keys, counts = keys[order], counts[order].astype(np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    return pa.table(
        [
            pa.array(full.astype(np.int32)), pa.array(np.full(len(full), g, np.int32)),
            pa.array([keys[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()),
            pa.array([counts[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()),
        ],
        schema=KEYS_SCHEMA,
    )


def repeated_keys(rows: DataFrame) -> DataFrame:
    """(g, keys, counts): of each group's keys those whose counts over all groups come to two or more, with that total.

    A group sends a key once, however often it has it, so a very common key is a few bytes a group.
    """

    def total(table: pa.Table) -> pa.Table:
        groups, blobs = table["g"].to_numpy(), table["keys"].to_pylist()
        keys = [np.frombuffer(b, np.uint64) for b in blobs]
        counts = [np.frombuffer(b, np.uint32) for b in table["counts"].to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        k, c = every[order], np.concatenate(counts).astype(np.int64)[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, c = k[at], np.add.reduceat(c, at)
        k, c = k[c > 1], c[c > 1]
        out_g, out_k, out_c = [], [], []
        for g, own in zip(groups, keys):
            place = np.minimum(np.searchsorted(k, own), max(len(k) - 1, 0))
            hit = (k[place] == own) if len(k) else np.zeros(len(own), bool)
            if hit.any():
                out_g.append(g)
                out_k.append(own[hit].tobytes())
                out_c.append(np.minimum(c[place[hit]], 2**32 - 1).astype(np.uint32).tobytes())
        return pa.table([pa.array(out_g, pa.int32()), pa.array(out_k, pa.binary()), pa.array(out_c, pa.binary())], names=["g", "keys", "counts"])

    return rows.groupBy("bucket").applyInArrow(total, "g int, keys binary, counts binary")


def joined_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a group's rows from repeated_keys, sorted, with their totals."""
    if table.num_rows == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    k = np.concatenate([np.frombuffer(b, np.uint64) for b in table["keys"].to_pylist()])
    c = np.concatenate([np.frombuffer(b, np.uint32) for b in table["counts"].to_pylist()])
    order = np.argsort(k)
    return k[order], c[order]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _squeezed(text: pa.Buffer | None) -> bytes | None:
    return None if text is None else _ZIP.compress(text)


def unzipped(packed: Iterable[bytes | None]) -> list[str | None]:
    """Texts that `zipped` has packed."""
    return [None if x is None else _UNZIP.decompress(x).decode() for x in packed]


def zipped(rows: DataFrame, text: str = "text", packed: str = "packed") -> DataFrame:
    """The rows with the text as a compressed binary at the end, half as large on its way as the shuffle makes it; null stays null."""
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.as_buffer() if x.is_valid else None for x in batch[text].cast(pa.large_binary())]
            out = pa.array(list(map(_squeezed, data)), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), out], names=[*(f.name for f in kept), packed])

    return rows.mapInArrow(run, StructType([*kept, StructField(packed, BinaryType())]))


def summed(parts: DataFrame, size: int, kind: type = np.uint32) -> np.ndarray:
    """Sum of the vectors of `size` numbers in column `v`, in two steps; one vector reaches the driver. Counts of type uint32 stop at its end."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64 if kind is np.uint32 else kind)
        for x in table["v"]:
            total += np.frombuffer(x.as_py(), kind)
        total = np.minimum(total, 2**32 - 1) if kind is np.uint32 else total
        return pa.table([table["part"][:1], pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part", "v"])

    salted = parts.select(F.expr("cast(rand(7) * 64 as int)").alias("part"), "v")
    once = salted.groupBy("part").applyInArrow(add, "part int, v binary").select(F.lit(0).alias("part"), "v")
    rows = once.groupBy("part").applyInArrow(add, "part int, v binary").collect()
    return np.frombuffer(bytes(rows[0]["v"]), kind).copy() if rows else np.zeros(size, kind)


def first_by_hash(rows: DataFrame, id_col: str, class_col: str, per_class: int, seed: int = 11) -> DataFrame:
    """(id, class, place) of the `per_class` rows of each class with the least hashes: the same rows at every run.

    Hashes above three times the share that is wanted are dropped before rows are ranked, so ranking sees a few times
    `per_class` rows of a class however many it has.
    """
    rows = rows.select(id_col, class_col, (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) / float(1 << 52)).alias("_u"))
    size = rows.groupBy(class_col).agg(F.count("*").alias("_n"))
    few = rows.join(size, class_col).filter(F.col("_u") * F.col("_n") <= 3 * per_class + 200)
    rank = F.row_number().over(Window.partitionBy(class_col).orderBy("_u", id_col))
    return few.withColumn("place", rank).filter(F.col("place") <= per_class).select(id_col, class_col, "place")


def within_bytes(sample: DataFrame, class_col: str, most: int) -> DataFrame:
    """The rows of a sample, with columns place and text, up to `most` bytes a class.

    Texts above a quarter of that are passed over, the others taken by place while they fit; a class of which none is taken keeps
    its shortest text, cut to a quarter. Windows over a bounded number of rows a class; texts pass through them one by one.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    in_order = Window.partitionBy(class_col).orderBy("place", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    rows = sample.withColumn("_size", size).withColumn("_sofar", F.sum(F.when(F.col("_size") <= most // 4, F.col("_size"))).over(in_order))
    rows = rows.withColumn("_in", (F.col("_size") <= most // 4) & (F.col("_sofar") <= most))
    shortest = F.row_number().over(Window.partitionBy(class_col).orderBy("_size", "place", F.xxhash64("text"))) == 1
    alone = shortest & ~F.max("_in").over(Window.partitionBy(class_col))
    rows = rows.withColumn("_alone", alone).filter(F.col("_in") | F.col("_alone"))
    cut = F.when(F.col("_alone"), F.substring("text", 1, max(1, most // 16))).otherwise(F.col("text"))  # a character has 4 bytes at most
    return rows.withColumn("text", cut).drop("_size", "_sofar", "_in", "_alone", "place")


def in_one_task(sample: DataFrame, fit) -> bytes | None:
    """What `fit` makes of a sample of bounded size, in a task of its own; None without rows."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([fit(table.drop_columns(["one"]))], pa.binary())], names=["model"])

    rows = sample.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else None
