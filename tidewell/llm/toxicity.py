"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6 bytes of the word between marks, hashed to slots), its vector the
mean of their embeddings; a text is the mean of its words. A softmax over that mean gives the score. An unseen spelling
thus has the n-grams, and so the vectors, that it shares with known ones. Training takes PER_CLASS labelled rows of each
label at most (the ones with the least hashes, SAMPLE_BYTES in all; a text above an eighth of that is passed over, or cut if its label has no other) and corrects the intercept for the labels' true shares, counted on all
learnable rows. As mean and softmax are linear, a task that scores needs one number a slot, SLOTS in all, broadcast.

Edge cases: null, empty and wordless texts get the score of the intercept alone; very long texts are averaged whole, in
strips; repeated rows get equal scores; null labels are left out, those of unknown documents count in the shares only, and an
id with several labels counts as toxic if one says so; without labelled rows every score is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import _grams, _seq, _shuffle

PER_CLASS, SAMPLE_BYTES = 2000, 64_000_000
SLOTS, DIMS, SIZES = 1 << 17, 8, (3, 4, 5, 6)
#: Passes over the sample at most, texts a step, rate of Adagrad, pull of embeddings towards zero for each text of the
#: sample, the squares Adagrad starts from, and the share of a pass's loss below which the next one must stay.
EPOCHS, BATCH, RATE, DECAY, FLOOR, FLAT = 8, 64, 0.3, 5e-9, 1e-6, 0.97
THRESHOLD = 0.3
#: Short passages taken of each clean text in training.
PASSAGES = 6
STRIP = 400_000


def word_bags(data: np.ndarray, off: np.ndarray):
    """Distinct words' slots: (flat slots, offsets by word), and for each text its words' numbers as (word, offsets)."""
    low = _grams.WORD_BYTES[data]
    s, e, doc = _seq.word_spans(low, off)
    h = _seq.hash_spans(low, s, e)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    size = (e - s)[first]
    marked = np.full(int((size + 2).sum()), 60, np.uint8)  # <word>
    bounds = np.concatenate([[0], np.cumsum(size + 2)])
    marked[_seq.ragged(bounds[:-1] + 1, size)] = low[_seq.ragged(s[first], size)]
    marked[bounds[1:] - 1] = 62
    u = _seq.lanes(marked) if len(marked) else np.zeros(0, np.uint64)
    counts, slots, owner = np.zeros(len(size), np.int64), [], []
    for n in SIZES:
        k, at = _grams.within(bounds, n)
        slots.append(_grams.gram_slots(u[at], n, SLOTS))
        owner.append(np.repeat(np.arange(len(size)), k))
        counts += k
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.concatenate([[0], np.cumsum(counts)]), back, np.searchsorted(doc, np.arange(len(off)))


def _rows_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; empty pieces give zero."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def bag_matrix(texts: list[str], together: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's slots and weights, whose sum over the embeddings is the text's mean: (slots, weights, offsets)."""
    slots, weights, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
    for i in range(0, len(texts), together):
        data, off = _seq.text_bytes(pa.array(texts[i : i + together], pa.large_string()))
        flat, at, word, doc_at = word_bags(data, off)
        n, words = len(off) - 1, len(at) - 1
        # distinct (text, word) pairs with their share of the text, then their n-grams
        doc = np.repeat(np.arange(n), np.diff(doc_at))
        pair, times = np.unique(doc * words + word, return_counts=True)
        doc, word = np.divmod(pair, max(words, 1))
        size = np.diff(at)[word]
        share = times / np.diff(doc_at)[doc] / np.maximum(size, 1)
        key = np.repeat(doc * SLOTS, size) + flat[_seq.ragged(at[:-1][word], size)]
        own, back = np.unique(key, return_inverse=True)
        slots.append((own % SLOTS).astype(np.int32))
        weights.append(np.bincount(back, weights=np.repeat(share, size), minlength=len(own)).astype(np.float32))
        sizes.append(np.bincount(own // SLOTS, minlength=n))
    return np.concatenate(slots), np.concatenate(weights), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def train(texts: list[str], labels: np.ndarray, shares: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """A weight for each slot and the intercept, from embeddings and softmax trained together with Adagrad."""
    rng = np.random.default_rng(seed)
    # short passages of each clean text, so that a few common words alone don't look like anything
    short = []
    for t in (t for t, y in zip(texts, labels) if y == 0):
        words = t.split()
        for _ in range(PASSAGES):
            n = int(rng.integers(3, 40))
            a = int(rng.integers(0, max(1, len(words) - n)))
            short.append(" ".join(words[a : a + n]))
    labels = np.concatenate([labels, np.zeros(len(short), np.int64)])
    mine = np.bincount(labels, minlength=2) / max(len(labels), 1)
    slots, weights, bounds = bag_matrix([*texts, *short])
    emb = np.zeros((SLOTS, DIMS), np.float32)  # an n-gram that training never met says nothing
    decay, best = DECAY * len(texts), np.inf
    out, bias = rng.normal(0, 1, (DIMS, 2)), np.zeros(2)
    seen_emb, seen_out, seen_bias = np.full(SLOTS, FLOOR, np.float32), np.full((DIMS, 2), 1e-8), np.full(2, 1e-8)
    n, scale, number = len(labels), 20.0, np.zeros(SLOTS, np.int64)
    for epoch in range(EPOCHS):
        rate, loss = RATE * (1 - epoch / EPOCHS), 0.0
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            docs = order[a : a + BATCH]
            size = bounds[docs + 1] - bounds[docs]
            at = _seq.ragged(bounds[docs], size)
            s, w = slots[at], weights[at] * scale
            own = np.concatenate([[0], np.cumsum(size)])
            mean = np.zeros((len(docs), DIMS))
            full = size > 0
            if full.any():
                mean[full] = np.add.reduceat(emb[s] * w[:, None], own[:-1][full], axis=0)
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            loss -= np.log(p[np.arange(len(docs)), labels[docs]] + 1e-12).sum()
            p[np.arange(len(docs)), labels[docs]] -= 1
            p /= len(docs)
            g_out, g_bias, g_mean = mean.T @ p, p.sum(0), p @ out.T
            g = np.repeat(g_mean, size, axis=0) * w[:, None]
            used = np.flatnonzero(np.bincount(s, minlength=SLOTS))
            number[used] = np.arange(len(used))
            back = number[s]
            g_emb = np.stack([np.bincount(back, weights=g[:, d], minlength=len(used)) for d in range(DIMS)], axis=1)
            g_emb += decay * emb[used]
            seen_emb[used] += (g_emb**2).sum(1)
            emb[used] -= rate * g_emb / np.sqrt(seen_emb[used])[:, None]
            seen_out += g_out**2
            out -= rate * g_out / np.sqrt(seen_out)
            seen_bias += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_bias)
        if loss > best * FLAT:
            break
        best = loss
    shift = np.log(shares[1] / shares[0]) - np.log(mine[1] / mine[0]) if min(*shares, *mine) > 0 else 0.0
    return ((emb @ (out[:, 1] - out[:, 0])) * scale).astype(np.float32), float(bias[1] - bias[0] + shift)


def text_scores(data: np.ndarray, off: np.ndarray, table: np.ndarray, intercept: float) -> np.ndarray:
    """Each text's score; texts are read in strips, a long one in parts cut at spaces."""
    total, words = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    size, a = len(data), 0
    while a < size:
        b = min(a + STRIP, size)
        if b < size:  # back to the last space or start of a text
            spaces = np.flatnonzero(_grams.WORD_BYTES[data[a:b]] == 32)
            starts = off[(off > a) & (off <= b)]
            b = max([x for x in (a + int(spaces[-1]) + 1 if len(spaces) else 0, int(starts[-1]) if len(starts) else 0) if x > a] or [b])
        d0, d1 = int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b, "left"))
        own = np.clip(off[d0 : d1 + 1], a, b) - a
        flat, at, word, doc_at = word_bags(data[a:b], own)
        n = np.diff(at)
        value = _rows_sum(table[flat].astype(np.float64), at) / np.maximum(n, 1)
        total[d0:d1] += _rows_sum(value[word], doc_at)
        words[d0:d1] += np.diff(doc_at)
        a = b
    return 1 / (1 + np.exp(-(total / np.maximum(words, 1) + intercept)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """The model from the learnable labelled rows, trained in one task on `per_class` texts of each label at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(~_shuffle.held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = _shuffle.first_by_hash(known, "doc_id", "toxic", per_class)
    # 2 * per_class ids at most
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = _shuffle.within_bytes(sample.select("doc_id", "text", "toxic", "place"), "toxic", SAMPLE_BYTES // 2)
    shares = np.array([count.get(0, 0), count.get(1, 0)], float) / max(1, sum(count.values()))

    def learn(table: pa.Table) -> bytes:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        weights, intercept = train([t or "" for t in table["text"].to_pylist()], table["toxic"].to_numpy().astype(np.int64), shares)
        return np.append(weights.astype(np.float64), intercept).tobytes()

    model = _shuffle.in_one_task(sample, learn)
    if model is None:
        return np.zeros(SLOTS, np.float32), -1e3
    numbers = np.frombuffer(model, np.float64)
    return numbers[:-1].astype(np.float32), float(numbers[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # SLOTS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = model.value
        for batch in batches:
            data, off = _seq.text_bytes(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(text_scores(data, off, table, intercept))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _shuffle.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose text scores below the threshold, as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # SLOTS numbers
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, intercept = model.value
        for batch in batches:
            data, off = _seq.text_bytes(batch.column(place).cast(pa.string()))
            yield batch.filter(pa.array(text_scores(data, off, table, intercept) < threshold))

    return docs.mapInArrow(keep, docs.schema)
