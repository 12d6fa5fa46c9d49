"""Hard negatives by a two-dimensional block matrix multiply (SUMMA): tiles of anchors by rows, added up over dimension ranges.

Components become floor(256 * x). Rows are dealt to blocks of at most about ROWS by a hash of their id, anchors (ids divisible by `every`)
to blocks of about ANCHORS, and both are cut into at most CHUNKS ranges of dimensions; a block has BLOCK_BYTES of components at most. An
anchor block meets a row block in a task of its own, strip by strip of its anchors: the products of each range are added up to the strip's
scores in int64, and only what is read off them leaves the task. The first pass gives each anchor's best rows of its own label, from which the
positives come; in the second the tiles are multiplied again, beside their anchors' positives, and each gives the best rows of
other labels within the window that a positive sets. A tile sends on at most as many rows as are asked for, of each anchor
or pair, and Spark's top-k by group ends it.

The anchors are a stated set against all rows, in blocks; no side is broadcast or collected. The work is anchors times rows, twice, but no
score is written. A block is sent once to each block of the other side, so what is shuffled is the table times its anchors' blocks.

Scores are exact where they fit a long, whatever the parts wrap to; beyond it they stop at the largest long. Components beyond 2^62
count as 2^62. The window 50 * p <= 100 * n <= 95 * p is ceil(p / 2) <= n <= p - ceil(p / 20), which can't overflow.

Edge cases: rows with a null id, label, vector or component, or a non-finite one, take no part; shorter vectors count as zeros
beyond their end, an empty one as zeros; rows that share an id count once, that of the least label and vector; equal scores go
by the smaller id; fewer rows than asked for give all of them; an anchor alone in its label and a positive with nothing in its window
give no rows, as does an empty table; one label may hold most rows, since nothing is grouped by label; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import _shuffle
from tidewell.llm.topk import SCALE, width_of

POSITIVES, NEGATIVES, EVERY = 5, 3, 50
#: Rows in a block, anchors in a block, at most about; ranges of dimensions at most, and dimensions in a range at least.
ROWS, ANCHORS, CHUNKS, LEAST_DIMS = 32768, 16384, 16, 32
#: Bytes of components in a block, scores in a strip; blocks of rows that a table of some size has, and rows in these at least.
BLOCK_BYTES, STRIP, LEAST_BLOCKS, LEAST_ROWS = 4_000_000, 1_000_000, 24, 1024
BLOCK_DDL = "block long, chunk int, ids binary, labels binary, m binary"
FOUND_DDL = "anchor_id long, other_id long, score long"


def blocks(rows: DataFrame, number: Column, dims: int, width: int) -> DataFrame:
    """(block, chunk, ids, labels, m): for each range of dimensions a block's components in it, and with the first the block's ids in order and their labels."""
    step = max(LEAST_DIMS, -(-dims // CHUNKS))

    def pack(table: pa.Table) -> pa.Table:
        t = table.sort_by("id")
        n, lists = t.num_rows, t["v"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        m = np.zeros((n, dims), f"<i{width}")
        m[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(np.floor(SCALE * flat.astype(np.float64)), -(2.0**62), 2.0**62)
        ids, labels = t["id"].to_numpy().tobytes(), t["label"].to_numpy().tobytes()
        parts = [m[:, a : a + step].tobytes() for a in range(0, dims, step)]
        k = len(parts)
        return pa.table({"block": pa.array([t["block"][0].as_py()] * k, pa.int64()), "chunk": pa.array(range(k), pa.int32()), "ids": pa.array([ids] + [b""] * (k - 1), pa.binary()), "labels": pa.array([labels] + [b""] * (k - 1), pa.binary()), "m": pa.array(parts, pa.binary())})

    return rows.select(number.alias("block"), "id", "label", "v").groupBy("block").applyInArrow(pack, BLOCK_DDL)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in int64; by floats where these hold all sums exactly."""
    bound = a.shape[1] * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    kind = np.float64 if bound < 2.0**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _whole(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids and labels of a block, and its components by range."""
    parts = sorted((x for x in table.to_pylist() if x["chunk"] >= 0), key=lambda x: x["chunk"])
    ids, labels = (np.frombuffer(parts[0][c], np.int64) for c in ("ids", "labels"))
    return ids, labels, [np.frombuffer(x["m"], f"<i{width}").reshape(len(ids), -1) for x in parts]


def strips(x: list[np.ndarray], y: list[np.ndarray], wide: bool, narrow: bool) -> Iterator[tuple[int, np.ndarray]]:
    """The products of x's rows with all of y's, added up over the ranges, a strip of x at a time with where it begins."""
    step = max(1, STRIP // max(1, len(y[0])))
    for at in range(0, len(x[0]), step):
        total = size = 0
        for xm, ym in zip(x, y):
            total = total + products(xm[at : at + step], ym)
            if wide:
                size = size + xm[at : at + step].astype(np.float64) @ ym.astype(np.float64).T
        if wide:
            total = np.where(size >= 2.0**63, np.iinfo(np.int64).max, np.where(size < -(2.0**63), np.iinfo(np.int64).min, total))
        yield at, total.astype(np.int32) if narrow else total


def tiles(anchors: DataFrame, rows: DataFrame, n_anchor: int, n_row: int):
    """Each pair of an anchor block and a row block as a cogroup."""
    deal = lambda df, side, n: df.withColumn(side, F.explode(F.expr(f"sequence(0l, {n - 1}l)")))
    left, right = deal(anchors.withColumnRenamed("block", "i"), "j", n_row), deal(rows.withColumnRenamed("block", "j"), "i", n_anchor)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return at[np.lexsort((ids[at], -scores[at].astype(np.float64) if scores.dtype != np.int64 else ~scores[at]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


def positives_of(anchors: DataFrame, rows: DataFrame, n_anchor: int, n_row: int, width: int, wide: bool, narrow: bool, k: int) -> DataFrame:
    """Of each tile each anchor's k best other rows of its label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            (aids, alabels, x), (ids, labels, y) = _whole(left, width), _whole(right, width)
            for start, scores in strips(x, y, wide, narrow):
                for a, own, s in zip(aids[start:], alabels[start:], scores):
                    at = np.flatnonzero((labels == own) & (ids != a))
                    at = at[_best(s[at], ids[at], k)]
                    out.append((np.full(len(at), a), ids[at], s[at].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "other_id", "score"])

    return tiles(anchors, rows, n_anchor, n_row).applyInArrow(run, FOUND_DDL)


def negatives_of(anchors: DataFrame, rows: DataFrame, positives: DataFrame, n_anchor: int, n_row: int, width: int, wide: bool, narrow: bool, k: int) -> DataFrame:
    """Of each tile the k best rows of other labels in the window of each positive of its anchors; positives carry their anchor block `a`."""

    def pack(t: pa.Table) -> pa.Table:
        """A block's positives as a part of it, numbered -1: anchors, rows and scores."""
        cols = [pa.array([t[c].to_numpy().tobytes()], pa.binary()) for c in ("anchor_id", "other_id", "score")]
        return pa.table([t["a"][:1].combine_chunks(), pa.array([-1], pa.int32()), *cols], names=["block", "chunk", "ids", "labels", "m"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 5]
        asked = left.filter(pc.equal(left["chunk"], -1))
        if asked.num_rows and right.num_rows:
            (aids, alabels, x), (ids, labels, y) = _whole(left, width), _whole(right, width)
            anchor, other, p = (np.frombuffer(asked[c][0].as_py(), np.int64) for c in ("ids", "labels", "m"))
            order = np.argsort(anchor, kind="stable")
            anchor, other, p = anchor[order], other[order], p[order]
            lows, highs = -(-p // 2), p - -(-p // 20)
            for at, scores in strips(x, y, wide, narrow):
                for a, own, s in zip(aids[at:], alabels[at:], scores):
                    mine = slice(*np.searchsorted(anchor, [a, a + 1]))
                    low, high = lows[mine], highs[mine]
                    if not len(low):
                        continue
                    on = np.flatnonzero((labels != own) & (s >= low.min()) & (s <= high.max()))
                    on = on[np.lexsort((ids[on], ~s[on]))]  # highest first
                    up = ~s[on].astype(np.int64)
                    start, end = np.searchsorted(up, ~high, "left"), np.searchsorted(up, ~low, "right")
                    for q, ps, i, j in zip(other[mine], p[mine], start, np.minimum(end, start + k)):
                        if j > i:
                            out.append((np.full(j - i, a), np.full(j - i, q), np.full(j - i, ps), ids[on[i:j]], s[on[i:j]].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    asked = positives.groupBy("a").applyInArrow(pack, BLOCK_DDL)
    return tiles(anchors.unionByName(asked), rows, n_anchor, n_row).applyInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """For each anchor and positive the best rows of other labels whose score is 50 to 95 hundredths of the positive's."""
    kind = rows.schema[vec_col].dataType.simpleString()  # floats travel as such, and order alike
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    usable = usable.filter("id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    anchor = F.pmod("id", F.lit(every)) == 0
    # over all rows, also those whose id repeats: these sizes are bounds
    size = usable.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max(F.expr("aggregate(v, 0d, (a, x) -> greatest(a, abs(x)))")).alias("largest")).first()
    usable = usable.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    dims, largest = max(1, size["dims"] or 1), size["largest"] or 0.0
    bound, width = dims * (SCALE * largest + 1) ** 2, width_of(largest)
    wide, narrow = bound >= 2.0**62, bound < 2.0**30
    most = max(1, BLOCK_BYTES // (dims * width))
    n_anchor = max(1, -(-size["anchors"] // min(ANCHORS, most)))
    n_row = max(1, -(-size["n"] // min(ROWS, most)), min(LEAST_BLOCKS, size["n"] // LEAST_ROWS))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    left, right = (_shuffle.cut(blocks(df, number(n), dims, width)) for df, n in ((usable.filter(anchor), n_anchor), (usable, n_row)))
    shape = (n_anchor, n_row, width, wide, narrow)
    rank = lambda *by, score, other: F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(other)))
    near = positives_of(left, right, *shape, positives).withColumn("rank", rank("anchor_id", score="score", other="other_id")).filter(F.col("rank") <= positives)
    near = near.withColumn("a", F.pmod(F.xxhash64("anchor_id"), F.lit(n_anchor)))
    found = negatives_of(left, right, near, *shape, negatives)
    found = found.withColumn("rank", rank("anchor_id", "positive_id", score="negative_score", other="negative_id")).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """The rows with every label whose id is divisible by 7 moved to the next of ten."""
    return rows.withColumn(label_col, F.when(F.pmod(F.col(id_col), F.lit(7)) == 0, F.pmod(F.col(label_col) + 1, F.lit(10))).otherwise(F.col(label_col)))


#: The same in DuckDB's SQL, in integers of 128 bits.
OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, m.label AS label, list_transform(m.e, lambda x: least(greatest(floor(256 * x), -4611686018427387904::DOUBLE), 4611686018427387904::DOUBLE)::HUGEINT) AS e FROM (SELECT vec_id, min({'label': label, 'e': e}) AS m FROM r GROUP BY vec_id)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(range(1, least(len(a.e), len(c.e)) + 1), lambda i: a.e[i] * c.e[i])), 0)::HUGEINT AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, negative_id, positive_score::BIGINT AS positive_score, negative_score::BIGINT AS negative_score FROM n
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) QUALIFY row_number() OVER w <= 3
"""
