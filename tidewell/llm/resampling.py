"""Importance resampling towards a target corpus, over hashed word n-grams, with long texts cut into overlapping chunks.

Words are runs of digits, letters and non-ASCII bytes, with A-Z lower-cased; features are all runs of 1 to N words,
joined by a space, and fall into crc32 % BUCKETS. A bucket's gain is how much more often the target has it than the
corpus, in thousandths of a nat; a document's weight is the floored mean of its features' gains. Adding Gumbel noise from
a hash of the id and taking the highest scores draws documents without replacement, in proportion to their weights.

A text above CHUNK bytes is split at word boundaries into chunks that own the words starting in their stretch and carry
the next N - 1 words, so every feature is counted by the one chunk that owns its first word. Chunks are dealt out by a
hash, so one long text is the work of many tasks; counts and sums of gains are then added by document. Shorter texts are
chunks by themselves and aren't shuffled. Corpus counts are one vector of BUCKETS longs a task, added in two steps.

The draw's ranks come from counts of documents by score: scores are whole thousandths, so the distinct ones are bounded
by the range of gains and noise, not by the documents. Their running sum is made in two levels, and no window holds
more than the rows of one score or the scores of one stretch.

Edge cases: null, empty and wordless texts have no features, weight 0, and are never drawn when `least` is above 0; a null
id is hashed as nothing and comes last among ties; rows that share an id are documents of their own, and copies of an
id and text alike have one weight and score and follow each other in rank; an empty corpus gives no rows, an empty
target only the smoothing; very long texts are cut as above, a word longer than a chunk stays whole; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import _seq, _shuffle

N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Bytes of text whose words a chunk owns, and words longer than this many bytes, which are hashed one by one.
CHUNK, LONG_WORD = 1 << 16, 64
#: Scores in a stretch of the running sum.
STRETCH = 256

_IS_WORD = np.array([b >= 128 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 for b in range(256)])


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()


def _shifts(most: int) -> np.ndarray:
    """Table [n, k, b]: what byte b at place k of a crc32 becomes when n zero bytes follow. A crc32 of two strings in a
    row is the first one's, shifted by the second's length, xor the second's."""
    out = np.zeros((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(most):
        out[n + 1] = _CRC[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


_SHIFT = _shifts(LONG_WORD + 1)


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    b = np.uint32(255)
    return _SHIFT[n, 0, crc & b] ^ _SHIFT[n, 1, (crc >> np.uint32(8)) & b] ^ _SHIFT[n, 2, (crc >> np.uint32(16)) & b] ^ _SHIFT[n, 3, crc >> np.uint32(24)]


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words in a buffer of texts; no word crosses two texts."""
    on = np.concatenate([[False], _IS_WORD[data], [False]])
    change = on[1:] != on[:-1]
    cut = np.unique(off[(off > 0) & (off < len(data))])
    cut = cut[on[cut] & on[cut + 1]]  # two words meet where their texts do
    edges = np.sort(np.concatenate([np.flatnonzero(change), cut, cut]))
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each word, a byte a step for all words that still have bytes."""
    size = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    on = np.flatnonzero(size <= LONG_WORD)
    on = on[np.argsort(-size[on], kind="stable")]
    left = size[on]
    for k in range(int(left.max(initial=0))):
        on = on[: np.searchsorted(-left, -k, "left")]  # those longer than k
        left = left[: len(on)]
        crc[on] = _CRC[(crc[on] ^ data[starts[on] + k]) & np.uint32(255)] ^ (crc[on] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_WORD):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return crc


def features(text: pa.Array, owned: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk number and bucket of each feature that starts at one of a chunk's first `owned` words (all if negative), and
    each chunk's words of its own."""
    data, off = _seq.text_bytes(text)
    data = _seq.lower_ascii(data)
    starts, ends, of = words_of(data, off)
    first = np.searchsorted(of, np.arange(len(owned) + 1))
    own = np.where(owned < 0, np.diff(first), owned)
    mine = np.arange(len(starts)) - first[of] < own[of]
    word, size = word_crcs(data, starts, ends), ends - starts
    spaced = _shifted(np.full(len(word), zlib.crc32(b" "), np.uint32), np.minimum(size, LONG_WORD)) ^ word  # of a space and the word
    chunk, bucket, at, run = [of[mine]], [word[mine]], np.flatnonzero(mine), word[mine]
    for k in range(1, n):
        keep = at + k < first[of[at] + 1]
        at, run = at[keep], run[keep]
        last = at + k
        run = _shifted(run, np.minimum(size[last] + 1, LONG_WORD + 1)) ^ spaced[last]
        for i in np.flatnonzero(size[last] > LONG_WORD):
            words = range(at[i], last[i] + 1)
            run[i] = zlib.crc32(b" ".join(data[starts[w] : ends[w]].tobytes() for w in words))
        chunk.append(of[at])
        bucket.append(run)
    return np.concatenate(chunk), (np.concatenate(bucket) % np.uint32(BUCKETS)).astype(np.int64), own


def split(text: str, size: int, n: int = N) -> Iterator[tuple[str, int]]:
    """Chunks of a text and how many of their words each owns: those that start in a stretch of `size` bytes, with the next n - 1 words carried."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words_of(data, np.array([0, len(data)]))
    stretch = starts // size
    cuts = np.concatenate([np.flatnonzero(np.diff(stretch, prepend=-1)), [len(starts)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield raw[starts[a] : ends[min(b + n - 1, len(ends)) - 1]].decode(), int(b - a)


def chunks(docs: DataFrame, id_col: str, text_col: str, n: int = N) -> DataFrame:
    """(id, key, text, owned, head): texts of up to CHUNK bytes as they are, longer ones as chunks, dealt out by a hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.filter(F.octet_length("text") <= CHUNK).select("id", F.lit(None).cast("string").alias("key"), "text", F.lit(-1).cast("long").alias("owned"), F.lit(True).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key, text in zip(batch["id"].to_pylist(), batch["key"].to_pylist(), batch["text"]):
                pieces = [*split(text.as_py(), CHUNK, n)] or [("", 0)]
                out = pa.table({"id": pa.array([i] * len(pieces), pa.int64()), "key": [key] * len(pieces), "text": [p for p, _ in pieces], "owned": pa.array([o for _, o in pieces], pa.int64()), "head": [k == 0 for k in range(len(pieces))]})
                yield from out.to_batches(max_chunksize=64)

    long = rows.filter(F.octet_length("text") > CHUNK).withColumn("key", F.sha2("text", 256)).mapInArrow(run, "id long, key string, text string, owned long, head boolean")
    return short.unionByName(long.repartition("id", "key", F.xxhash64("text")))


def bucket_counts(pieces: DataFrame, n: int = N) -> np.ndarray:
    """Features of all chunks by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(features(batch["text"], batch["owned"].to_numpy(), n)[1], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return _shuffle.summed(pieces.select("text", "owned").mapInArrow(run, "v binary"), BUCKETS, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed rate in the target over that in the corpus, by bucket."""
    s_all, t_all = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(pieces: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """(id, n_words, n_features, weight) for each document of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, bucket, own = features(batch["text"], batch["owned"].to_numpy(), n)
            order = np.argsort(of, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            count = np.bincount(of, minlength=batch.num_rows)
            end = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["key"], batch["head"], pa.array(own.astype(np.int64)), pa.array(count), pa.array(sums[end] - sums[end - count])], names=["id", "key", "head", "w", "f", "s"])

    each = pieces.mapInArrow(run, "id long, key string, head boolean, w long, f long, s long")
    short = each.filter("key is null").select("id", "w", "f", "s")
    # copies of one id and text have their chunks under one key: each gets its part of the sums
    long = each.filter("key is not null").groupBy("id", "key").agg(F.sum("w").alias("w"), F.sum("f").alias("f"), F.sum("s").alias("s"), F.count_if("head").alias("c"))
    long = long.select("id", F.expr("w div c").alias("w"), F.expr("f div c").alias("f"), F.expr("s div c").alias("s"), F.explode(F.expr("sequence(1l, c)")).alias("_"))
    mean = F.when(F.col("f") == 0, F.lit(0)).otherwise(F.expr("(s - pmod(s, f)) div f")).cast("long")
    return short.unionByName(long.drop("_")).select("id", F.col("w").alias("n_words"), F.col("f").alias("n_features"), mean.alias("weight"))


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """The rows with `rank` by descending score and ascending id; null beyond `most` and where score is null."""
    by_score = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last())
    counts = rows.filter("score is not null").groupBy("score").agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("score") / STRETCH))
    below = Window.partitionBy("stretch").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole, before = counts.groupBy("stretch").agg(F.sum("n").alias("n")).collect(), 0  # one row a stretch of scores
    first = {}
    for r in sorted(whole, key=lambda r: -r["stretch"]):
        first[r["stretch"]], before = before, before + r["n"]
    if not first:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    starts = F.map_from_arrays(F.lit(list(first)), F.lit(list(first.values())))
    ahead = counts.select("score", (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.element_at(starts, F.col("stretch"))).alias("ahead"))
    rank = (F.col("ahead") + F.row_number().over(by_score)).cast("long")
    placed = rows.filter("score is not null").join(ahead, "score").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.select(*rows.columns, "rank").unionByName(rows.filter("score is null").withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = N, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Each document's id, n_features, weight, score, and its rank if it is drawn; `percent` of those with at least `least` words are."""
    pieces, aim = chunks(docs, id_col, text_col, n), chunks(target.select(F.lit(0).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", n)
    gain = gains(bucket_counts(pieces, n), bucket_counts(aim, n))
    rows = _shuffle.cut(weights(pieces, gain, n).withColumn("all_scores", F.col("weight") + noise("id", seed)).withColumn("score", F.when(F.col("n_words") >= least, F.col("all_scores"))))
    drawn = ranked(rows, percent * rows.filter("score is not null").count() // 100)
    return drawn.select(F.col("id").alias(id_col), "n_features", "weight", F.col("all_scores").alias("score"), "rank")


#: The same in DuckDB's SQL; crc32 is folded over the bytes of each distinct feature.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) t(b) UNION ALL
    SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
texts AS (SELECT row_number() OVER () AS r, doc_id, text, 0 AS aim FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark),
w AS MATERIALIZED (SELECT r, doc_id, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT r, aim, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda a, y: xor(tab[xor(a % 256, y) + 1], a // 256), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM hexed, crc),
n AS (SELECT b, count(*) FILTER (aim = 0) AS s, count(*) FILTER (aim = 1) AS t FROM f JOIN b USING (f) GROUP BY b),
al AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
g AS (SELECT b, floor(1000 * ln((n.t + 1)::DOUBLE * (al.s + 10000) / ((n.s + 1)::DOUBLE * (al.t + 10000))))::BIGINT AS g FROM n, al),
sums AS (SELECT r, sum(g)::BIGINT AS g, count(*) AS n FROM f JOIN b USING (f) JOIN g USING (b) WHERE aim = 0 GROUP BY r),
d AS (SELECT w.r, doc_id, len(w.w) AS words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight FROM w LEFT JOIN sums USING (r) WHERE aim = 0),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS total FROM sc WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * total // 100 THEN k END AS rank FROM sc LEFT JOIN p USING (r)
"""
