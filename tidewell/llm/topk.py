"""Exact top-k inner products over integer vectors: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz residuals.

Components become floor(256 * x). All vectors' second moments (one small matrix a task) give the rotation whose leading
axes carry most of the length, as in a singular value decomposition. Vectors are cut by length into strata and these
into blocks of bounded size, each stratum by its own count. The longest block meets all queries first, which gives each its k-th best score so far; a
further block is sent to a block of queries only if length times length can reach one of these. Inside a pair of blocks,
vectors come by descending length: a query drops those whose length, then whose partial sum over the leading axes plus
the product of the residual lengths, stays below its k-th best. What is left gets its exact integer product.

Queries are a stated set (ids divisible by `every`); they meet all vectors in blocks, and no side is broadcast. What
travels are the queries, TOGETHER of their blocks at a time, in the narrowest integers that hold all components; a block
of vectors goes once to each such batch of query blocks that it may matter to.

Edge cases: vectors that are null or have null or non-finite components, and rows of null id, take no part; shorter
vectors count as zeros beyond their end; rows that share an id count once, the smallest vector; fewer candidates than k
give all of them; ties go to the smaller id; an empty table gives no rows; other columns are not read.
Scores are exact where they fit a long, whatever parts of the sum wrap to; beyond it they stop at its ends. Components beyond 2^62
count as 2^62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import _shuffle

K, EVERY, SCALE = 5, 50, 256
#: Vectors in a block, queries in a block, and strata of length at most.
BLOCK, QUERIES, STRATA = 8192, 2048, 512
#: Leading axes of the partial sums, vectors taken at a time, and dimensions whose axes are worked out.
LEAD, STEP, ROTATED = 16, 512, 1024
#: Blocks of queries that meet a block of vectors in one task call.
TOGETHER = 16
LOWEST = np.iinfo(np.int64).min
VECTOR_DDL = "vec_id long, v binary, norm double"
BLOCK_DDL = "block long, n int, top double, ids binary, v binary"


def _matrix(blob: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{width}").reshape(n, -1)


def width_of(largest: float) -> int:
    """Bytes of the narrowest integer that holds floor(SCALE * x) for every |x| up to this."""
    return next((w for w in (2, 4) if SCALE * largest + 1 < 2 ** (8 * w - 1)), 8)


def vectors(rows: DataFrame, dims: int, width: int) -> DataFrame:
    """(vec_id, v, norm): integer components as bytes, `dims` of them, and the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"]
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = np.zeros((len(lists), dims), f"<i{width}")
            row = np.repeat(np.arange(len(lists)), size)
            m[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(np.floor(SCALE * flat), -(2.0**62), 2.0**62)
            norm = np.sqrt((m.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([x.tobytes() for x in m], pa.binary()), pa.array(norm)], names=["vec_id", "v", "norm"])

    return rows.mapInArrow(run, VECTOR_DDL)


def rotation(rows: DataFrame, dims: int, width: int) -> np.ndarray:
    """The LEAD orthonormal axes along which all vectors have most of their length, as columns; the tasks' matrices are added in two steps.

    Beyond ROTATED dimensions the axes are those of the ROTATED dimensions with most length; any axes give right bounds.
    """

    def total(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + of(_matrix(b"".join(batch["v"].to_pylist()), batch.num_rows, width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([] if isinstance(total, float) else [total.tobytes()], pa.binary())], names=["v"])

        return rows.select("v").mapInArrow(run, "v binary")

    chosen = np.arange(dims)
    if dims > ROTATED:
        chosen = np.sort(np.argsort(-_shuffle.summed(total(lambda m: (m**2).sum(0)), dims, np.float64))[:ROTATED])
    n = len(chosen)
    moments = _shuffle.summed(total(lambda m: m[:, chosen].T @ m[:, chosen]), n * n, np.float64).reshape(n, n)
    axes = np.zeros((dims, min(LEAD, n)))
    axes[chosen] = np.linalg.eigh(moments)[1][:, ::-1][:, :LEAD]
    return axes


def blocks(rows: DataFrame, block: F.Column) -> DataFrame:
    """One row for each block: ids and components by descending length."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["vec_id"].to_numpy(), -table["norm"].to_numpy()))
        t = table.take(pa.array(order))
        return pa.table([table["block"][:1], pa.array([t.num_rows], pa.int32()), pa.array([t["norm"][0].as_py()]), pa.array([t["vec_id"].to_numpy().tobytes()], pa.binary()), pa.array([b"".join(t["v"].to_pylist())], pa.binary())], names=["block", "n", "top", "ids", "v"])

    return rows.select(block.alias("block"), "vec_id", "v", "norm").groupBy("block").applyInArrow(pack, BLOCK_DDL)


def cell_numbers(rows: DataFrame, stratum: F.Column) -> F.Column:
    """The block of each vector. A stratum of more than BLOCK vectors, as many of one length make, is cut by a hash of
    the id into parts of half a block on average; STRATA counts at most reach the driver."""
    count = {r["s"]: r["n"] for r in rows.groupBy(stratum.cast("int").alias("s")).agg(F.count("*").alias("n")).collect()}
    parts = [1 if count.get(s, 0) <= BLOCK else -(-2 * count[s] // BLOCK) for s in range(max(count, default=0) + 1)]
    first = np.cumsum([0, *parts]).tolist()
    of = lambda x: F.get(F.array(*[F.lit(n).cast("long") for n in x]), stratum.cast("int"))
    return of(first[:-1]) + F.pmod(F.xxhash64("vec_id"), of(parts))


class Best:
    """Each query's k best (score, id) so far, by descending score and ascending id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(queries, LOWEST)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~score, q))
        q = q[order]
        start = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - start
        keep = rank < self.k
        self.q, self.score, self.ids = q[keep], score[order][keep], ids[order][keep]
        full = rank[keep] == self.k - 1
        self.kth[self.q[full]] = np.maximum(self.kth[self.q[full]], self.score[full])


def search(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, axes: np.ndarray, k: int = K) -> Best:
    """The k best vectors of a block for each query, among those that may reach the scores `kth` known before."""
    best = Best(len(qids), k)
    best.kth = np.maximum(best.kth, kth)
    largest = m.shape[1] * float(np.abs(m.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    exact = np.float64 if largest < 2.0**53 else np.int64  # sums that wrap still end where the whole one does
    qf, qr = q.astype(exact), q.astype(np.float64) @ axes
    length = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1))
    rest_of = lambda norm, lead: np.sqrt(np.maximum(norm**2 - (lead**2).sum(1), 0))  # noqa: E731  beyond the leading axes
    q_wide = q.astype(np.float64) if largest >= 2.0**62 else None
    qn = length(q)
    q_rest = rest_of(qn, qr)
    for a in range(0, len(ids), STEP):
        part = m[a : a + STEP]
        r = part.astype(np.float64) @ axes
        norm = length(part)
        slack = 1e-7 * qn * norm[0] + 0.5  # a residual that is nearly 0 is off by some 1e-8 of the length
        reach = np.where(best.kth > LOWEST, np.nextafter(best.kth.astype(np.float64), -np.inf), -np.inf)  # not above the k-th best, whatever its float was rounded to
        on = np.flatnonzero(qn * norm[0] + slack >= reach)  # by length alone; all later vectors are shorter
        if not len(on):
            break
        bound = qr[on] @ r.T + q_rest[on, None] * rest_of(norm, r)[None, :]
        open_ = (bound + slack[on, None] >= reach[on, None]) & (qids[on, None] != ids[None, a : a + STEP])
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        if len(i) * 8 > open_.size:
            score = (qf[on] @ part.astype(exact).T).astype(np.int64)[i, j]
        else:
            score = (qf[on[i]] * part[j].astype(exact)).sum(1).astype(np.int64)
        if q_wide is not None:
            size = (q_wide[on[i]] * part[j].astype(np.float64)).sum(1)
            score = np.where(size >= 2.0**63, -(LOWEST + 1), np.where(size < -(2.0**63), LOWEST, score))
        ok = score >= best.kth[on[i]]
        best.add(on[i[ok]], score[ok], ids[a + j[ok]])
    return best


def top_products(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query."""
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    usable = usable.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = usable.agg(F.max(F.size("v")).alias("dims"), F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0d, (a, x) -> greatest(a, abs(x)))")).alias("largest")).first()
    dims, n, width = max(1, size["dims"] or 1), size["n"], width_of(size["largest"] or 0.0)
    data = _shuffle.cut(vectors(usable, dims, width))
    axes = rotation(data, dims, width)
    total = -(-n // BLOCK)
    strata = min(STRATA, max(1, total))
    edges = sorted(set(data.approxQuantile("norm", [i / strata for i in range(1, strata)], 0.2 / strata))) if strata > 1 else []
    # stratum 0 has the longest vectors; its number is that of the edges at or above the length
    stratum = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e > F.col("norm"))) if edges else F.lit(0)
    cells = _shuffle.cut(blocks(data, cell_numbers(data, stratum)))
    asked = data.filter(F.pmod("vec_id", F.lit(every)) == 0)
    groups = max(1, -(-asked.count() // QUERIES))
    packed = blocks(asked, F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    questions = _shuffle.cut(packed.select(F.col("block").alias("qb"), F.col("n").alias("qn"), F.col("top").alias("q_top"), F.col("ids").alias("qids"), F.col("v").alias("q")))
    found_ddl = "qb long, query_id long, vec_id long, score long"

    def scored(block: pa.Table, asking: pa.Table) -> pa.Table:
        """A block's best for each of the query blocks that meet it here."""
        out = [(np.zeros(0, np.int64),) * 4]
        for r in block.to_pylist():
            ids, m = np.frombuffer(r["ids"], np.int64), _matrix(r["v"], r["n"], width)
            for x in asking.to_pylist():
                qids = np.frombuffer(x["qids"], np.int64)
                kth = np.frombuffer(x["kth"], np.int64) if x["kth"] else np.full(len(qids), LOWEST)
                b = search(ids, m, qids, _matrix(x["q"], x["qn"], width), kth, axes, k)
                out.append((np.full(len(b.q), x["qb"]), qids[b.q], b.ids, b.score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["qb", "query_id", "vec_id", "score"])

    def meet(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Scores of the pairs (block, qb), in batches of query blocks; `known` has each query block's numbers."""
        batch = (F.col("qb") / TOGETHER).cast("long")
        asking = pairs.join(known, "qb").select(F.col("block").alias("at"), batch.alias("of"), "qb", "qn", "qids", "q", "kth")
        sent = pairs.select("block", batch.alias("batch")).distinct().join(cells.select("block", "n", "ids", "v"), "block")
        return sent.groupBy("block", "batch").cogroup(asking.groupBy("at", "of")).applyInArrow(scored, found_ddl)

    ahead = _shuffle.cut(meet(questions.select(F.lit(0).cast("long").alias("block"), "qb"), questions.withColumn("kth", F.lit(None).cast("binary"))))

    def limits(table: pa.Table, scores: pa.Table) -> pa.Table:
        r = table.to_pylist()[0]
        qids, q = np.frombuffer(r["qids"], np.int64), _matrix(r["q"], r["qn"], width)
        kth = np.full(len(qids), LOWEST)
        order = np.argsort(qids)
        at = order[np.searchsorted(qids[order], scores["query_id"].to_numpy())]
        count = np.bincount(at, minlength=len(qids))
        low = np.full(len(qids), -(LOWEST + 1))
        np.minimum.at(low, at, scores["score"].to_numpy())
        kth[count >= k] = low[count >= k]
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        ratio = np.where(norm > 0, (kth - 0.5) / np.maximum(norm, 1e-300), np.where(kth > 0.5, np.inf, -np.inf))
        return pa.table([pa.array([r["qb"]]), pa.array([kth.tobytes()], pa.binary()), pa.array([float(ratio.min(initial=np.inf)) * (1 - 1e-9)])], names=["qb", "kth", "reach"])

    bounds = _shuffle.cut(questions.groupBy("qb").cogroup(ahead.groupBy("qb")).applyInArrow(limits, "qb long, kth binary, reach double"))
    meta = cells.filter(F.col("block") > 0).select("block", "top", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qb")).withColumn("qb", F.col("qb").cast("long"))
    pairs = meta.join(bounds.select("qb", "reach"), "qb").filter("top >= reach").select("block", "qb")
    rest = meet(pairs, questions.join(bounds, "qb"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = ahead.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB's SQL.
OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(min(list_transform(embedding, lambda x: x::DOUBLE)), lambda x: least(greatest(floor(256 * x), -4611686018427387904::DOUBLE), 4611686018427387904::DOUBLE)::HUGEINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0)::HUGEINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
t AS (SELECT query_id, vec_id, least(greatest(score, -9223372036854775808::HUGEINT), 9223372036854775807::HUGEINT)::BIGINT AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM t)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
