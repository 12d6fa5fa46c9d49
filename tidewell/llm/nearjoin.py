"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes of its links.

A document's set holds its distinct word shingles. Two documents link when 100 * intersection >= percent * union.
Tokens stand in one global order, rare ones first, by counts over all documents in a fixed number of hashed counters
(any fixed order is exact; the counts only make it cheap). A set of m tokens whose partners share at least need(m) of
them has the prefix of level l: its first m - need(m) + l tokens. Linked sets share at least l tokens of their
prefixes of level l. Each document takes the level that its counts make cheapest: a longer prefix reads more postings,
but asks for more common tokens before a pair is verified; a pair goes by the lower level of the two.

1. One pass gives each document's set size and digest, and the counters. Equal sets become one class, told by its
   smallest id: copies, however many, are handled as one.
2. Groups of documents send their distinct prefix tokens and get back those that others have too; only documents with
   such a token go on, with their sets.
3. Star pairs: for each token every document is paired with one centre. That is linear in the postings. Verified pairs
   are links and give first components.
4. All remaining pairs that lie in different components, share a token that not all of one component have and pass the
   multi-match test are verified. Documents meet by token and size band, and only where the places of the token leave
   room for enough common tokens, so these filters stand in the join's key. No pair of two known fellows is verified,
   and no link between components is lost.

Edge cases: a null or empty text or one without words has the empty set and is linked with nothing; one with fewer words
than a shingle has one token, its whole sequence. Repeated rows are copies. Where ids are shared or null in several rows,
each id and text digest is a node of its own, numbered in order of id and digest. A null id counts as the smallest and is
given back as null, so the column component_id alone doesn't tell the classes of several null ids (or of the unlike texts
of one id) apart; `one_of_each` goes by nodes and does. Very long texts are one set each; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewell.llm import _seq, _shuffle
from tidewell.llm._repeats import COPY, KEYS, NOTE_DDL, NULL_ID, digested, find, group_of, ids_repeat, join_hashes, note_rows, notes, numbers, packed_rows

WORDS, PERCENT = 5, 80
#: Hashed counters for the token order: 2 MB in all, whatever the input.
COUNTERS = 1 << 19
SLICES = 16
#: Least and greatest number of common prefix tokens that a pair must have (fewer for sets that need fewer).
LOW, HIGH = 4, 8
#: Bytes of a posting and of a token sent for verification, and the postings that a rare token may be counted wrong by.
POSTING, TOKEN, CHANCE = 12, 8, 0.05
#: Hashes that choose centres, and the documents of a token from which on places choose them.
CENTRES, MANY = 8, 16
#: Ratio of the sizes in one band, and the answers of a token that stand together in the exact join.
BAND, SALT = 1.06, 512
STRIP = 400_000


def need(size, percent: int = PERCENT):
    """The least intersection that a set of this size has with a partner."""
    return (percent * size + 99) // 100


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit fingerprints; texts are read in strips."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + STRIP, "right")) - 1)
        low = _seq.lower_ascii(data[off[a] : off[b]])
        own = off[a : b + 1] - off[a]
        s, e, doc = _seq.word_spans(low, own)
        h = _seq.hash_spans(low, s, e)
        at = np.searchsorted(doc, np.arange(b - a + 1))
        grams = join_hashes(h, words)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            if j - i >= words:
                yield np.unique(grams[i : j - words + 1])
            elif j > i:  # the whole sequence, told apart from shingles by its length
                yield np.array([int.from_bytes(hashlib.blake2b(h[i:j].tobytes(), digest_size=8).digest(), "little")], np.uint64)
            else:
                yield h[:0]
        a = b


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


PROFILE_DDL = "doc_id long, size long, digest binary, slice int, counts binary"


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """Rows of (doc_id, size, digest), and of each task's token counts in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(COUNTERS, np.uint32), [x.split()[0] for x in PROFILE_DDL.split(", ")]
        for batch in batches:
            sizes, digests = [], []
            for tokens in shingle_sets(*_seq.text_bytes(batch["text"]), words):
                counts += np.bincount(slot(tokens), minlength=COUNTERS).astype(np.uint32) if len(tokens) > 20_000 else np.uint32(0)
                if len(tokens) <= 20_000:
                    np.add.at(counts, slot(tokens), np.uint32(1))
                sizes.append(len(tokens))
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(counts, SLICES)], pa.binary())], names=names)

    return docs.mapInArrow(run, PROFILE_DDL)


def token_counts(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up slice by slice; COUNTERS numbers reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // SLICES, np.uint64)
        for batch in table.to_batches():
            for x in batch["counts"]:
                total += np.frombuffer(x.as_py(), np.uint32)
        return pa.table([table["slice"][:1], pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["slice", "counts"])

    # a tree of two steps, so that no task reads the slices of all tasks
    salted = rows.filter("slice is not null").select("slice", "counts", F.expr("cast(rand(7) * 8 as int)").alias("part"))

    def part(table: pa.Table) -> pa.Table:
        return add(table)

    once = salted.groupBy("slice", "part").applyInArrow(part, "slice int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    for r in once.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        n = COUNTERS // SLICES
        out[r["slice"] * n : (r["slice"] + 1) * n] = np.frombuffer(bytes(r["counts"]), np.uint32)
    return out


def prefix(tokens: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The tokens of the longest prefix that this set may need, in order, and the set's level."""
    m = len(tokens)
    c = counts[slot(tokens)]
    order = np.lexsort((tokens, c))
    base = m - need(m, percent)
    low, top = min(LOW, need(m, percent)), min(HIGH, need(m, percent))
    others = np.cumsum(np.maximum(c[order[: base + top]].astype(np.float64) - 1 - noise, CHANCE))
    level, best = low, None
    for k in range(low, top + 1):  # k common tokens make a candidate, so postings / k candidates at most
        total = POSTING * (base + k + others[base + k - 1]) + TOKEN * m * others[base + k - 1] / k
        if best is None or total < best:
            level, best = k, total
    return tokens[order[: base + level]], level


def may_link(size: int, level: int, place: np.ndarray, percent: int) -> bool:
    """Whether a set has enough repeated prefix tokens for a pair at any level that a partner of its may have."""
    least = min(LOW, need(need(size, percent), percent))
    from_level = np.maximum(place + 1 - (size - need(size, percent)), 1)
    return any((from_level <= k).sum() >= k for k in range(max(1, least), level + 1))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of the links (a, b): the smallest node that can be reached, by alternating stars."""
    edges = _shuffle.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def star(rows: DataFrame, both: bool) -> DataFrame:
        near = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else rows
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = near.join(low, "u")
        if both:
            return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")

    sign = None
    while True:
        edges = _shuffle.cut(star(star(edges, True).distinct(), False).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first())
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = now


def verified(pairs: DataFrame, kept: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. A text goes once, packed, to each group that has a partner of it."""
    place = kept.select("doc_id", "g")
    pairs = pairs.join(place.select(F.col("doc_id").alias("b"), F.col("g").alias("to")), "b").join(place.select(F.col("doc_id").alias("a"), F.col("g").alias("at")), "a").select("a", "b", "at", "to")
    here = kept.select("g", "doc_id", "packed").groupBy("g")

    def send(own: pa.Table, asked: pa.Table) -> pa.Table:
        row = {d: i for i, d in enumerate(own["doc_id"].to_pylist())}
        take = pa.array([row[d] for d in asked["a"].to_pylist()], pa.int64())
        return pa.table([asked["to"], own["doc_id"].take(take), own["packed"].take(take), pa.nulls(len(take), pa.int64())], names=["to", "doc_id", "packed", "b"])

    moved = here.cogroup(pairs.select("at", "to", "a").distinct().groupBy("at")).applyInArrow(send, "to int, doc_id long, packed binary, b long")
    told = moved.unionByName(pairs.select("to", F.col("a").alias("doc_id"), F.lit(None).cast("binary").alias("packed"), "b"))

    def sets(ids: list[int], packed: list[bytes]) -> dict[int, np.ndarray]:
        texts = pa.array(_shuffle.unzipped(packed), pa.string())
        return dict(zip(ids, shingle_sets(*_seq.text_bytes(texts), words)))

    def check(own: pa.Table, told: pa.Table) -> pa.Table:
        asked, ids, packed = [], [], []
        for a, x, b in zip(*[told[c].to_pylist() for c in ("doc_id", "packed", "b")]):
            if x is None:
                asked.append((a, b))
            else:
                ids.append(a)
                packed.append(x)
        sent, wanted = sets(ids, packed), {b for _, b in asked}
        mine = [(d, x) for d, x in zip(own["doc_id"].to_pylist(), own["packed"].to_pylist()) if d in wanted]
        here = sets([d for d, _ in mine], [x for _, x in mine])
        out = []
        for a, b in asked:
            x, y = sent[a], here[b]
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                out.append((a, b))
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])

    return here.cogroup(told.groupBy("to")).applyInArrow(check, "a long, b long")


SETS_DDL = "g int, doc_id long, size int, level int, packed binary, low_at int, own_at int, prefix array<long>, place array<int>"


#: What a posting has of its document: size, level, and the places of the repeated tokens that make the lowest level and its own.
FACTS = ("size", "level", "low_at", "own_at")


def postings(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each repeated prefix token: its place in the document's order, and how many repeated ones stand before it."""
    each = rows.select("doc_id", *FACTS, *columns, F.posexplode(F.arrays_zip("prefix", "place")).alias("ahead", "p"))
    return each.select("doc_id", *FACTS, *columns, "ahead", F.col("p.prefix").alias("token"), F.col("p.place").alias("place"))


def sides(rows: DataFrame, side: str, *columns: str) -> list:
    """doc_id, its facts and the token's place under the names of one side of a pair."""
    return [F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in (*FACTS, "place", "ahead", *columns)]]


def in_both_prefixes(percent: int) -> str:
    """Whether a common token counts for a pair: sets that link share `least` tokens at least, so they share `level` of
    the first size - least + level tokens of either; the shorter set has the shorter prefix. Either must have that many
    repeated tokens there at all. What stands before a common token and is not repeated is not common, so common tokens
    are at most the repeated ones before it and all that follow."""
    least = f"(({percent} * (a_size + b_size) + {99 + percent}) div {100 + percent})"
    level = "least(a_level, b_level)"
    of = lambda x, y: f"greatest({x}_place, if({x}_level <= {y}_level, {x}_own_at, {x}_low_at)) < {x}_size - {least} + {level}"
    most = "least(a_ahead, b_ahead) + least(a_size - a_place, b_size - b_place)"
    return f"{least} <= {most} and {of('a', 'b')} and {of('b', 'a')}"


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a token's centre and the token's other documents.

    A token of few documents says so together with another one at least, and its centre is the least by one of CENTRES
    hashes. One of many documents has the document for centre in which it stands earliest: the one with the fewest rare
    tokens of its own, which is nearest to all others of a large group. What star pairs leave out is left to the exact step.
    """
    facts = ("doc_id", *FACTS, "place", "ahead")
    order = F.xxhash64("doc_id", F.pmod("token", F.lit(CENTRES)))
    low = rows.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), *facts)).alias("few"), F.min(F.struct(F.col("place").cast("long").alias("o"), *facts)).alias("more")).filter("n > 1")
    low = low.withColumn("c", F.when(F.col("n") > MANY, F.col("more")).otherwise(F.col("few")))
    near = rows.join(low.select("token", "n", F.col("c.doc_id").alias("a"), *[F.col(f"c.{c}").alias(f"a_{c}") for c in facts[1:]]), "token")
    near = near.select("a", *[f"a_{c}" for c in facts[1:]], *sides(near, "b"), (F.col("n") > MANY).alias("many")).filter("a <> b").filter(in_both_prefixes(percent))
    return near.groupBy("a", "b").agg(F.count("*").alias("n"), F.bool_or("many").alias("many")).filter("n > 1 or many").select("a", "b")


def size_band(size) -> Column:
    """The band of a size; sizes in one band differ by BAND at most."""
    return F.floor(F.log(size) / math.log(BAND)).cast("int")


def with_reach(rows: DataFrame, percent: int) -> DataFrame:
    """Postings with `reach`, the largest size of a partner that the token can be common with.

    Sets of sizes a and b that link share percent * (a + b) / (100 + percent) tokens at least. What a posting leaves room
    for (the repeated tokens ahead of it and all that follow, and the place of its last counted prefix token) bounds the
    tokens shared, and so the partner's size.
    """
    room = F.expr("least(ahead + size - place, size - place + level - 1, size - low_at + level - 1)")
    return rows.withColumn("reach", (F.floor(room * (100 + percent) / percent) - F.col("size")).cast("int"))


def exact_pairs(known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough prefix tokens, each once.

    Of a pair the larger set asks and the smaller answers (of equal ones the larger id asks). A set answers only at
    postings whose reach is its own size or more, and asks only in the bands between its least partner's size and its
    reach, so sets whose own tokens rule out every partner of a size never meet them, however common the token is.
    Most documents of a token may lie in one component (`main`); these are met only by documents of others. A token's
    answers are split into salts of SALT.
    """
    by_root = known.groupBy("token", "root").agg(F.count("*").alias("n"))
    mixed = by_root.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("token", "main")
    both = with_reach(known.join(mixed, "token"), percent).withColumn("in_main", F.col("root") == F.col("main"))
    answers = both.filter("reach >= size").withColumn("band", size_band(F.col("size")))
    least = F.expr(f"({percent} * size + 99) div 100")
    top = F.least("size", "reach")
    asks = both.filter(top >= least).withColumn("band", F.explode(F.sequence(size_band(least), size_band(top))))
    count = answers.groupBy("token", "band").agg(F.count("*").alias("every"), F.count_if(~F.col("in_main")).alias("outside"), F.min("root").alias("one"), F.max("root").alias("other"))
    asks = asks.join(count, ["token", "band"]).filter("(one <> other or one <> root) and (not in_main or outside > 0)")
    # within `main` documents ask those outside only
    salts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / SALT)).cast("int")
    asks = asks.withColumn("salts", F.when(F.col("in_main"), salts("outside")).otherwise(salts("every")))
    asks = asks.select("token", "band", F.col("in_main").alias("a_in_main"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *sides(both, "a", "root"))
    answers = answers.join(count.select("token", "band", "every", "outside"), ["token", "band"])
    # an answer stands once for askers outside `main`, and once more for those inside if it is outside itself
    dealt = lambda n: F.pmod(F.xxhash64("doc_id"), salts(n)).cast("int")
    kinds = F.array(F.struct(F.lit(False).alias("to_main"), dealt("every").alias("salt")), F.when(~F.col("in_main"), F.struct(F.lit(True).alias("to_main"), dealt("outside").alias("salt"))))
    answers = answers.withColumn("k", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select("token", "band", F.col("k.to_main").alias("a_in_main"), F.col("k.salt").alias("salt"), *sides(both, "b", "root"))
    near = asks.join(answers, ["token", "band", "a_in_main", "salt"]).filter("a_root <> b_root and (b_size < a_size or (b_size = a_size and b < a))").filter(in_both_prefixes(percent))
    near = near.groupBy("a", "b").agg(F.count("*").alias("n"), F.first(F.least("a_level", "b_level")).alias("level")).filter("n >= level")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def class_roots(kept: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the documents that link: star pairs first, then every pair left between components."""
    links = _shuffle.cut(verified(star_pairs(postings(kept), percent), kept, words, percent))
    roots = components(links)
    known = postings(kept.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "root")
    rest = _shuffle.cut(exact_pairs(known, percent))
    more = _shuffle.cut(verified(rest, among(kept, rest), words, percent))
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def among(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that the pairs are made of."""
    return kept.join(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "doc_id", "left_semi")


def node_classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text), whose ids are nodes."""
    spark = docs.sparkSession
    groups = _shuffle.group_count(docs)
    rows = _shuffle.cut(profiles(docs, words))
    counts = token_counts(rows)
    noise = float(counts.sum()) / COUNTERS
    shared = spark.sparkContext.broadcast(counts)  # COUNTERS numbers
    own = rows.filter("slice is null").select("doc_id", "size", "digest")
    # classes are found by another form of the digest than the one rows meet them by, so that Spark may split a large class
    first = own.filter("size > 0").groupBy(F.hex("digest").alias("_hex")).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last")).withColumn("digest", F.unhex("_hex"))

    def blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield note_rows(batch["g"].to_numpy(), COPY, [np.array([d]).tobytes() for d in batch["doc_id"].to_pylist()])

    # empty sets take no part either
    again = own.join(first.filter("_last > rep").select("digest", "rep"), "digest").filter("doc_id > rep").select("doc_id").unionByName(own.filter("size = 0").select("doc_id"))
    copies = again.select(group_of(groups).alias("g"), "doc_id").mapInArrow(blob, NOTE_DDL)
    texts = _shuffle.zipped(docs.select(group_of(groups).alias("g"), "doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def members(table: pa.Table, told: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """Ids, packed texts and sets of the group's class representatives."""
        blobs = notes(told, COPY)[0]
        skip = np.concatenate([np.frombuffer(b, np.int64) for b in blobs]) if blobs else np.zeros(0, np.int64)
        keep = np.flatnonzero(~np.isin(table["doc_id"].to_numpy(), skip))
        part = table.take(pa.array(keep))
        packed = part["packed"].to_pylist()
        return zip(part["doc_id"].to_pylist(), packed, shingle_sets(*_seq.text_bytes(pa.array(_shuffle.unzipped(packed), pa.string())), words))

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        found = [prefix(tokens, shared.value, noise, percent)[0] for _, _, tokens in members(table, told) if len(tokens)] if table.num_rows else []
        if not found:
            return _shuffle.KEYS_SCHEMA.empty_table()
        key, times = np.unique(np.concatenate(found), return_counts=True)
        return _shuffle.key_rows(table["g"][0].as_py(), key, times, groups)

    sent = texts.groupBy("g").cogroup(copies.groupBy("g")).applyInArrow(send, _shuffle.KEYS_DDL)
    repeated = _shuffle.repeated_keys(sent).select("g", F.lit(KEYS).alias("kind"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(None).cast("binary").alias("c"))

    def keep(table: pa.Table, told: pa.Table) -> pa.Table:
        blobs = notes(told, KEYS)[0]
        keys = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])) if blobs else np.zeros(0, np.uint64)
        out = []
        for d, packed, tokens in members(table, told) if len(keys) and table.num_rows else []:
            if len(tokens):
                lead, level = prefix(tokens, shared.value, noise, percent)
                hit = np.flatnonzero(find(keys, lead))
                if may_link(len(tokens), level, hit, percent):
                    out.append((d, len(tokens), level, packed, lead[hit].view(np.int64), hit.astype(np.int32), *(int(hit[k - 1]) if len(hit) >= k else 1 << 30 for k in (max(1, min(LOW, need(need(len(tokens), percent), percent))), level))))
        g = table["g"][0].as_py() if table.num_rows else 0
        kinds = {"doc_id": pa.int64(), "size": pa.int32(), "level": pa.int32(), "packed": pa.binary(), "prefix": pa.list_(pa.int64()), "place": pa.list_(pa.int32()), "low_at": pa.int32(), "own_at": pa.int32()}
        made = pa.table([pa.array([g] * len(out), pa.int32()), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())]], names=["g", *kinds])
        return made.select([x.split()[0] for x in SETS_DDL.split(", ")])

    kept = _shuffle.cut(texts.groupBy("g").cogroup(copies.unionByName(repeated).groupBy("g")).applyInArrow(keep, SETS_DDL))
    roots = class_roots(kept, words, percent)
    own = own.join(first.select("digest", "rep"), "digest", "left").withColumn("rep", F.when(F.col("size") > 0, F.col("rep")))
    return own.join(roots, own["rep"] == roots["node"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def nodes(rows: DataFrame, node: str) -> DataFrame:
    """(doc_id, text) of packed rows, with their nodes for ids."""
    return rows.select(F.col(node).alias("doc_id"), F.col("row.text").cast("string").alias("text"))


def apart(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(n, row): one row of each id and digest. Repeated rows are taken together before they are shuffled."""
    return _shuffle.cut(rows.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row")).join(of, ["id", "digest"]).select("n", "row"))


def near_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.select("doc_id", "text")
    if ids_repeat(docs):
        rows = digested(docs)
        of = numbers(rows)
        found = node_classes(nodes(apart(rows, of), "n"), words, percent).join(of.select(F.col("n").alias("component_id"), F.col("id").alias("least")), "component_id")
        told = of.join(found.select(F.col("doc_id").alias("n"), "n_shingles", "least"), "n").drop("n")
        out = rows.select("id", "digest").join(told, ["id", "digest"]).select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    else:
        out = node_classes(nodes(packed_rows(docs), "id"), words, percent)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), "n_shingles", real("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that have the smallest node of their component; of rows with one id and text one is kept."""
    if ids_repeat(docs):
        rows = digested(docs)
        rows = apart(rows, numbers(rows)).withColumnRenamed("n", "id")
    else:
        rows = packed_rows(docs)
    kept = node_classes(nodes(rows, "id"), words, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("id"))
    columns = rows.schema["row"].dataType.names
    rest = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in columns if c != "text"]).alias("rest")
    left = _shuffle.zipped(rows.select("id", rest, F.col("row.text").cast("string").alias("text"))).join(kept, "id", "left_semi")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["rest"], pa.array(_shuffle.unzipped(batch["packed"].to_pylist()), pa.string())], names=["rest", "text"])

    whole = left.select("rest", "packed").mapInArrow(unpack, StructType([left.schema["rest"], StructField("text", StringType())]))
    return whole.select(*[F.col(f"rest.`{c}`").alias(c) if c != "text" else F.col("text").cast(docs.schema["text"].dataType).alias("text") for c in columns])
