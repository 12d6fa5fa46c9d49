import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import frame, held_out, odd_documents
from tidewell.llm import _seq, langid, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(own) > 200 and sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = odd_documents(1, 30)
    got = {}
    for r in langid.languages(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for d in (1000, 1001, 1002, 1008):
        assert got[d][0]["lang_pred"] == "und" and got[d][0]["score"] == 0
    assert {r["lang_pred"] for x in got.values() for r in x} <= {"en", "de", "und"}
    none = langid.languages(frame(spark, [(1, "text", None, "a")])).collect()
    assert none[0]["lang_pred"] == "und" and langid.languages(frame(spark, [])).count() == 0


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    own = [r for r in rows if r["held_out"]]
    bad, good = [r["score"] for r in own if r["toxic"] == 1], [r["score"] for r in own if r["toxic"] == 0]
    ranked = sum(b > g for b in bad for g in good) / max(1, len(bad) * len(good))
    assert bad and good and ranked > 0.75  # 37 toxic rows to learn from, 14 to rank
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_unseen_spelling():
    import numpy as np
    import pyarrow as pa

    from tidewell.llm import _seq

    rng = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "ro", "ki") for c in ("s", "th", "m")]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = [say(30) for _ in range(150)] + [f"{say(15)} horridfool {say(10)} horridfools {say(5)}" for _ in range(50)]
    model = toxicity.train(texts, np.array([0] * 150 + [1] * 50), np.array([0.75, 0.25]))
    data, off = _seq.text_bytes(pa.array([say(25), f"{say(12)} horidfool {say(12)}"]))
    clean, misspelt = toxicity.text_scores(data, off, *model)
    assert clean < 0.3 < misspelt


def test_toxicity_edges(spark):
    rows = odd_documents(1, 40)
    labels = spark.createDataFrame([(r[0], int(i % 9 == 0), "x") for i, r in enumerate(rows) if r[0] is not None] + [(5, None, "x"), (None, 1, "x"), (99999, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r["held_out"] == (r["doc_id"] is not None and held_out(r["doc_id"])) and 0 <= r["score"] <= 1 for r in got)
    kept = toxicity.not_toxic(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert {r["score"] for r in toxicity.toxicity_scores(frame(spark, rows[:3]), labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(frame(spark, []), labels).count() == 0


def naive_toxicity(text, table, intercept):
    """The mean over words of the mean over a word's n-grams of the learned weights, word by word."""
    from tidewell.llm import _grams, _seq

    words = bytes(_grams.WORD_BYTES[list((text or "").encode())]).split()
    values = []
    for w in words:
        marked = b"<" + w + b">"
        grams = [marked[i : i + n] for n in toxicity.SIZES for i in range(len(marked) - n + 1)]
        slots = [int(_grams.gram_slots(_seq.lanes(np.frombuffer(g, np.uint8))[:1], len(g), toxicity.SLOTS)[0]) for g in grams]
        values.append(sum(float(table[s]) for s in slots) / max(1, len(slots)))
    return 1 / (1 + math.exp(-(sum(values) / max(1, len(values)) + intercept)))


@pytest.mark.parametrize("strip", [1_500_000, 50])
def test_toxicity_scores_are_the_naive_sums(monkeypatch, strip):
    monkeypatch.setattr(toxicity, "STRIP", strip)
    texts = [t for _, t, *_ in odd_documents(3, 25)] + ["x" * 300, "w*rd @ $1 it's"]
    rng = np.random.default_rng(2)
    table = rng.normal(0, 1, toxicity.SLOTS).astype(np.float32)
    got = toxicity.text_scores(*_seq.text_bytes(pa.array(texts, pa.large_string())), table, -0.4)
    whole = [i for i, t in enumerate(texts) if t is None or max(map(len, t.split()), default=0) < 50]  # a word is cut only where it is longer than a strip
    for i in whole if strip == 50 else range(len(texts)):
        assert got[i] == pytest.approx(naive_toxicity(texts[i], table, -0.4), abs=1e-6), texts[i]


def test_bags_of_texts_together_are_those_of_each():
    texts = [t or "" for _, t, *_ in odd_documents(5, 30)]
    s, w, b = toxicity.bag_matrix(texts, 7)
    for i, t in enumerate(texts):
        own, weight, _ = toxicity.bag_matrix([t])
        assert np.array_equal(s[b[i] : b[i + 1]], own) and np.allclose(w[b[i] : b[i + 1]], weight)


@pytest.mark.parametrize("strip", [1_000_000, 40])
def test_language_scores_are_the_naive_sums(monkeypatch, strip):
    monkeypatch.setattr(langid, "STRIP", strip)
    texts = [t or "" for _, t, *_ in odd_documents(3, 25)] + ["ΑΣ Σ İstanbul ÄÖÜ 日本語の文", "12 34"]
    rng = np.random.default_rng(4)
    names, weights, intercept, t = ["a", "b", "c"], rng.normal(0, 300, (langid.SLOTS, 3)).astype(np.float32), rng.normal(0, 1, 3), 1.7
    best, score = langid.predict(texts, (names, weights, intercept, t))
    for i, text in enumerate(texts):
        low = "".join(c.lower() for c in text)
        z, n = np.zeros(3), 0
        for k in langid.SIZES:
            for a in range(len(low) - k + 1):
                u = sum(ord(c) << (21 * j) for j, c in enumerate(low[a : a + k]))
                slot = int((_seq.mix((np.array([u], np.uint64) + np.uint64(k)) * _seq._M1) & np.uint64(langid.SLOTS - 1))[0])
                z, n = z + weights[slot], n + 1
        p = langid.softmax(((z / max(1, n) + intercept) / t)[None, :])[0]
        if any(c.isalpha() for c in text):
            assert best[i] == p.argmax() and score[i] == pytest.approx(p.max(), abs=1e-6)
        else:
            assert best[i] == -1 and score[i] == 0


def test_document_counts(spark):
    texts = ["ab" * 40, "", "abc", "xyz " * 30]
    want = langid.document_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    again = np.zeros(langid.SLOTS, int)
    for t in texts:
        slots = {s for k in langid.SIZES for a in range(len(t) - k + 1) for s in _seq.mix((np.array([sum(ord(c) << (21 * j) for j, c in enumerate(t[a : a + k]))], np.uint64) + np.uint64(k)) * _seq._M1) & np.uint64(langid.SLOTS - 1)}
        for s in slots:
            again[int(s)] += 1
    assert want[1] == 4 and np.array_equal(want[0], again)


def test_samples_are_bounded_in_bytes(spark):
    from pyspark.sql import functions as F

    from tidewell.llm import _shuffle

    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"), (F.col("id") % 2).alias("lang"), F.col("id").cast("int").alias("place"))
    got = _shuffle.within_bytes(rows, "lang", 450).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(8))
    # an oversize text is passed over, and a class of such texts keeps its shortest, cut
    texts = [("a", "y" * 900, 0), ("a", "x" * 50, 1), ("a", "z" * 150, 2), ("b", "w" * 800, 0), ("b", "v" * 700, 1), ("c", None, 0)]
    got = _shuffle.within_bytes(spark.createDataFrame(texts, "lang string, text string, place int"), "lang", 400).collect()
    assert sorted((r["lang"], r["text"]) for r in got) == [("a", "x" * 50), ("b", "v" * 25), ("c", None)]


def test_no_learnt_language_is_lost(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 6000)
    words = {"de": "der hund und die katze", "en": "the dog and the cat"}
    rows = [(i, (lang := ("de", "en")[i % 2], f"{words[lang]} {i} ")[1] * (400 if i in (8, 9, 10, 11) else 4), lang, "a") for i in range(160)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows)
    every_long = [(i, f"{words[lang]} " * 600, lang, "a") for i, lang in enumerate(["de", "en"] * 40)]
    got = [r["lang_pred"] for r in langid.languages(spark.createDataFrame(every_long, "doc_id long, text string, lang string, source string")).collect()]
    assert set(got) == {"de", "en"}
