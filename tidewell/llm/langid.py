"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader.

Features are a text's n-grams of 1 to 3 characters, in lower case and hashed to SLOTS: their share of the text times
their inverse document frequency, which is counted over all learnable documents. Training is FTRL-proximal with
elastic-net penalties on a sample: of each language the PER_CLASS texts with the least hashes, SAMPLE_ROWS and
SAMPLE_BYTES in all at most (a text above a quarter of its language's share is passed over, or cut if the language has no other). One in VALID of them only sets the
temperature of the softmax, by least negative log-likelihood. As the scores are linear in the shares, a task that
predicts needs one weight for each slot and language, which is broadcast.

Edge cases: null texts and texts without letters are `und` with score 0; very long texts are read whole, in strips;
repeated rows get equal predictions; rows without lang or id teach nothing; with one language learned it is always
predicted, and with none every text is `und`; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import _seq, _shuffle

PER_CLASS, VALID = 800, 5
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64_000_000
SLOTS, SIZES, SCALE = 1 << 15, (1, 2, 3), 30.0
#: FTRL's learning rate parameters and elastic-net penalties, passes over the sample and texts a step.
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 1.0, 0.012, 0.001, 4, 16
#: Characters that are looked at together, and bytes of text whose strings a task holds.
STRIP, PORTION = 250_000, 4_000_000
UNKNOWN = "und"


def code_points(text: str) -> np.ndarray:
    """The characters of a text in lower case, each by itself (so a capital sigma gives the same letter anywhere)."""
    return np.frombuffer(text.replace("\u03a3", "\u03c3").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def strips(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, characters, offsets of the texts, characters ahead that were told before) of STRIP characters about.

    A text longer than a strip comes in several, each of one text alone, with the last characters of the one before ahead.
    """
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STRIP:
            yield first, np.concatenate(held), np.cumsum([0, *map(len, held)]), 0
            held, size, first = [], 0, i
        if len(t) <= STRIP:
            held.append(code_points(t))
            size += len(t)
            continue
        ahead = np.zeros(0, np.uint64)
        for a in range(0, len(t), STRIP):
            part = np.concatenate([ahead, code_points(t[a : a + STRIP])])
            yield i, part, np.array([0, len(part)]), len(ahead)
            ahead = part[-(SIZES[-1] - 1) :]
        first = i + 1
    if held:
        yield first, np.concatenate(held), np.cumsum([0, *map(len, held)]), 0


def gram_slots(c: np.ndarray, off: np.ndarray, ahead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the slots of a strip's texts, and the offsets of the texts; a character has 21 bits."""
    for n in SIZES:
        begin = off[:-1] + max(0, ahead - n + 1)
        size = np.maximum(off[1:] - begin - n + 1, 0)
        at = _seq.ragged(begin, size)
        u = c[at]
        for k in range(1, n):
            u = u | (c[at + k] << np.uint64(21 * k))
        yield (_seq.mix((u + np.uint64(n)) * _seq._M1) & np.uint64(SLOTS - 1)).astype(np.int32), np.concatenate([[0], np.cumsum(size)])


def letters(texts: list[str], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without ASCII letters are looked at one by one."""
    low = _seq.lower_ascii(data)
    count = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = count[off[1:]] > count[off[:-1]]
    for d in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[d] = any(c.isalpha() for c in texts[d])
    return out


def strings(column) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and how many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.uint32)
        seen, current = np.zeros(SLOTS, bool), -1
        for batch in _seq.portions(batches, "text", PORTION):
            for first, c, off, ahead in strips(strings(batch["text"])):
                slots = list(gram_slots(c, off, ahead))
                for d in range(len(off) - 1):
                    if (first + d, ahead > 0) != (current, True):  # else the same long text goes on
                        total[:SLOTS] += seen
                        seen[:] = False
                    for s, at in slots:
                        seen[s[at[d] : at[d + 1]]] = True
                    current = first + d
            total[:SLOTS] += seen
            seen[:], current = False, -1
            total[SLOTS] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    total = _shuffle.summed(texts.select("text").mapInArrow(count, "v binary"), SLOTS + 1)
    return total[:SLOTS], int(total[SLOTS])


def features(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's slots and TF-IDF values."""
    out = []
    for t in texts:
        slots = np.concatenate([np.zeros(0, np.int32), *[s for _, c, off, ahead in strips([t]) for s, _ in gram_slots(c, off, ahead)]])
        own, times = np.unique(slots, return_counts=True)
        out.append((own, SCALE * times / max(1, len(slots)) * idf[own]))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Ftrl:
    """FTRL-proximal with elastic net for a softmax; weights follow from z and n, and L1 leaves most at zero."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))  # the last row is the intercept

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        slots = np.concatenate([np.append(s, SLOTS) for s, _ in docs])
        values = np.concatenate([np.append(v, 1.0) for _, v in docs])
        row = np.repeat(np.arange(len(docs)), [len(s) + 1 for s, _ in docs])
        used, back = np.unique(slots, return_inverse=True)
        w = self.weights(used)
        x = np.zeros((len(docs), len(used)))
        x[row, back] = values
        p = softmax(x @ w)
        p[np.arange(len(docs)), labels] -= 1
        g = x.T @ p / len(docs)
        n = self.n[used]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[used] += g - sigma * w
        self.n[used] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by a search in steps of 2 %.

    Each label stands for all but one in n + 2 of itself, so that a sample without a fault doesn't call for certainty.
    """
    if not len(labels):
        return 1.0
    n, classes = logits.shape
    soft = np.full((n, classes), 1 / (n + 2) / max(1, classes - 1))
    soft[np.arange(n), labels] = 1 - 1 / (n + 2)
    grid = np.exp(np.arange(-4, 4, 0.02))
    loss = [-(soft * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(texts: list[str], langs: list[str], idf: np.ndarray, seed: int = 3) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights times IDF for each slot, intercepts and temperature."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    x = features(texts, idf)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    apart = np.setdiff1d(np.arange(0, len(order), VALID), np.unique(y[order], return_index=True)[1])  # each language's first text trains
    valid, fit = order[apart], np.delete(order, apart)
    model = Ftrl(len(names))
    for _ in range(EPOCHS):
        fit = rng.permutation(fit)
        for a in range(0, len(fit), BATCH):
            model.step([x[i] for i in fit[a : a + BATCH]], y[fit[a : a + BATCH]])
    w = model.weights()
    logits = np.array([v @ w[s] + w[SLOTS] for s, v in (x[i] for i in valid)]).reshape(len(valid), len(names))
    return names, (SCALE * idf[:, None] * w[:SLOTS]).astype(np.float32), w[SLOTS], temperature(logits, y[valid])


def predict(texts: list[str], model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language, or -1 for none, and its calibrated probability; texts are read in strips."""
    names, weights, intercept, t = model
    n = len(texts)
    total, count = np.zeros((n, len(names))), np.zeros(n)
    for first, c, off, ahead in strips(texts):
        for s, at in gram_slots(c, off, ahead):
            k = np.diff(at)
            full = np.flatnonzero(k)
            if len(full):
                for name in range(len(names)):
                    total[first + full, name] += np.add.reduceat(weights[:, name][s].astype(np.float64), at[full])
            count[first : first + len(k)] += k
    p = softmax((total / np.maximum(count, 1)[:, None] + intercept) / t)
    best = p.argmax(1)
    score = p[np.arange(n), best]
    none = ~letters(texts, *_seq.text_bytes(pa.array(texts, pa.large_string())))
    return np.where(none, -1, best), np.where(none, 0.0, score)


def fit(docs: DataFrame, per_class: int = PER_CLASS):
    """The model from the learnable rows, trained in one task on the sample; its size doesn't grow with the input."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null and text is not null").filter(~_shuffle.held_out())
    count, total = document_counts(rows)
    langs = max(1, rows.select(F.count_distinct("lang")).first()[0])
    chosen = _shuffle.first_by_hash(rows, "doc_id", "lang", max(1, min(per_class, SAMPLE_ROWS // langs)))  # SAMPLE_ROWS ids, or one a language
    sample = _shuffle.within_bytes(rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "text", "lang", "place"), "lang", SAMPLE_BYTES // langs)
    idf = np.log((1.0 + total) / (1.0 + count)) + 1.0

    def learn(table: pa.Table) -> bytes:
        table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        return pickle.dumps(train(table["text"].to_pylist(), table["lang"].to_pylist(), idf))

    model = _shuffle.in_one_task(sample, learn)
    return None if model is None else pickle.loads(model)


def languages(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_class))  # SLOTS weights for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _seq.portions(batches, "text", PORTION):
            if model.value is None:
                names, best, score = [], np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            else:
                names, (best, score) = model.value[0], predict(strings(batch["text"]), model.value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array([names[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _shuffle.held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
