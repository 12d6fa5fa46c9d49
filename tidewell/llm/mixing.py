"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Every source gets a target number of words: its share of all words by weight, but at most `cap` times
its own size; what a capped source leaves is shared again by weight (water filling, in closed form).
A document's expected copies are target / source size. Their prefix sum within the source, shifted by one
offset a source, is cut at the integers: a document is emitted once for each integer in its interval.

Prefix sums are spread out: a source is cut into cells by size class and a hash of the id, the cells' counts
are summed within the source (a source has at most 256 cells in each of some 250 classes, whatever the input),
and rows are numbered inside their cell. So a source that holds a third of all rows is dealt to as many tasks
as any other rows. Classes come in order of size, which keeps the words taken near the target.

Edge cases: null text has size 0; a null source is a source of its own, last in order; empty tables give
no rows; repeated rows are separate documents, numbered next to each other; other columns play no part, and
`mixed_rows` hands them on. A source without words has target 0 and none of its documents is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PARTS = 256


def word_count(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_part(value: Column, parts: int) -> Column:
    """0 to parts - 1 from the first 28 bits of the value's MD5, which every SQL engine can repeat."""
    return (F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 7), 16, 10).cast("long") % parts).cast("int")


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size) -> also weight and target, one row a source.

    With sources in ascending order of cap * size / weight, the first ones are full at cap * size and all others
    get weight * level, where level = (all words - full words) / (weight left) at the first that stays below its cap.
    """
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(listed) - 1) % len(weights) + 1).cast("long")
    rows = sources.withColumn("weight", weight).withColumn("_full", F.col("source_size") * cap)
    order = Window.orderBy((F.col("_full").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_full_before", F.coalesce(F.sum("_full").over(before), F.lit(0))).withColumn("_weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0))).withColumn("_rank", F.row_number().over(order))
    every = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("_words", F.sum("source_size").over(every)).withColumn("_weights", F.sum("weight").over(every))
    rows = rows.withColumn("_level", (F.col("_words") - F.col("_full_before")).cast("double") / (F.col("_weights") - F.col("_weight_before")).cast("double"))
    open_ = F.col("_full").cast("double") > F.col("_level") * F.col("weight")
    level = F.min(F.when(open_, F.struct("_rank", "_level"))).over(Window.partitionBy(F.lit(1)))["_level"]
    rows = rows.withColumn("_common", level)
    target = F.least(F.col("_full").cast("double"), F.coalesce(F.col("_common") * F.col("weight"), F.col("_full").cast("double")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def systematic_copies(docs: DataFrame, seed: int = 17, cap: int = 3, weights=WEIGHTS, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document; with carry its whole row as struct `row`."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carried)
    bits = F.length(F.bin("size"))
    rows = rows.withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")),
            "_class": bits * 4 + F.expr("cast(shiftright(size, greatest(length(bin(size)) - 3, 0)) as int) & 3"),
            "_part": hash_part(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(str(seed))), PARTS),
        }
    )
    cell = ["_source", "_class", "_part"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum("size").alias("_s"))
    sources = source_targets(cells.groupBy("_source").agg(F.sum("_s").alias("source_size")).select(F.expr("if(_source = '', null, substr(_source, 2))").alias("source"), "source_size"), weights, cap)
    sources = sources.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_source"), "source_size", "target")
    before = Window.partitionBy("_source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_s").join(sources, "_source")
    # rows of one id and size are told apart by their texts, so that reruns agree on what is taken
    tie = [F.xxhash64("row.text")] if carry else []
    inside = Window.partitionBy(*cell).orderBy("size", "doc_id", *tie)
    rows = rows.withColumn("_row", F.row_number().over(inside)).join(cells, cell).withColumn("_at", F.col("_before") + F.col("_row"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    offset = hash_part(F.concat(F.col("_source"), F.lit(f"/{seed}")), 1 << 28) / F.lit(float(1 << 28))
    crossed = F.floor(F.col("_at") * rate + offset) - F.floor((F.col("_at") - 1) * rate + offset)
    return rows.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies"), *(["row"] if carry else []))


def mix_report(docs: DataFrame, seed: int = 17, cap: int = 3, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and taken, the words the mix takes of each document."""
    rows = systematic_copies(docs, seed, cap, weights)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 17, cap: int = 3, weights=WEIGHTS) -> DataFrame:
    """The mix: each document's row, with the columns it came with, as often as it is taken."""
    taken = systematic_copies(docs, seed, cap, weights, carry=True).filter("copies > 0")
    return taken.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"), "row").select("row.*")


#: The same in DuckDB's SQL.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce('s' || source, '') AS src FROM documents),
c AS (SELECT *, length(bin(size)) * 4 + ((size >> greatest(length(bin(size)) - 3, 0)::BIGINT) & 3) AS cls,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR || '/', '') || '17'), 1, 7))::BIGINT % 256 AS part FROM d),
s0 AS (SELECT source, src, sum(size)::BIGINT AS source_size FROM c GROUP BY ALL),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
s2 AS (SELECT *, row_number() OVER o AS rk, coalesce(sum(3 * source_size) OVER b, 0) AS fb, coalesce(sum(w) OVER b, 0) AS wb,
    sum(source_size) OVER () AS t, sum(w) OVER () AS tw FROM s1
    WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST),
    b AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (t - fb)::DOUBLE / (tw - wb)::DOUBLE AS lv FROM s2),
s4 AS (SELECT (SELECT lv FROM s3 WHERE (3 * source_size)::DOUBLE > lv * w ORDER BY rk LIMIT 1) AS l),
s5 AS (SELECT src, source_size, least((3 * source_size)::DOUBLE, coalesce(l * w, (3 * source_size)::DOUBLE)) AS target,
    (('0x' || substr(md5(src || '/17'), 1, 7))::BIGINT % 268435456)::DOUBLE / 268435456.0::DOUBLE AS u FROM s3, s4),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cls, part, size, doc_id) AS p FROM c),
q AS (SELECT doc_id, size, source_size, target, p, u, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM r JOIN s5 USING (src))
SELECT doc_id, size, source_size, target, (least(floor(p * rate + u) - floor((p - 1) * rate + u), 3) * size)::BIGINT AS taken FROM q
"""
