import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from tests.llm.cases import LOWER, frame, odd_documents
from tidewell.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, aims, buckets=10_000, least=20, percent=25):
    """(doc_id, n_features, weight, score, rank) of every row, sorted."""

    def features(text):
        w = WORDS.findall((text or "").translate(LOWER))
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    each = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in aims for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for d, w, f in each:
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = odd_documents(4)
    rows += [(2000, "x" * 300 + " tail of it " + "ü" * 200, "en", "a"), (2001, "A1-b2_c3 É" * 40, "en", "a"), (1006, rows[-5][1], "en", "b"), (1006, rows[-5][1], "en", "b"), (2002, "w1 " * 25 + "z" * 400 + " w2" * 30, "de", "a")]
    aims = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(20)] + [None, ""]
    want = brute([r[:2] for r in rows], aims)
    target = spark.createDataFrame([(i, a) for i, a in enumerate(aims)], "item_id long, text string")
    for size in (1 << 16, 200, 7):
        monkeypatch.setattr(resampling, "CHUNK", size)
        assert got(resampling.resampled(frame(spark, rows), target)) == want


def test_chunks_own_each_word_once():
    rng = random.Random(5)
    for n in (1, 2, 3):
        text = " ".join(rng.choice(["a", "bb", "Ünï", "x" * 90, "--", "c3"]) for _ in range(300))
        whole = resampling.features(pa.array([text]), np.array([-1]), n)[1]
        pieces = [*resampling.split(text, 50, n)]
        cut = resampling.features(pa.array([p for p, _ in pieces]), np.array([o for _, o in pieces]), n)[1]
        assert sorted(whole) == sorted(cut) and len(pieces) > 20


def test_ties_and_empty(spark):
    same = [(i, "one two " * 15, "en", "a") for i in (5, 5, 5, 5)]
    target = spark.createDataFrame([], "text string")
    assert got(resampling.resampled(frame(spark, same), target)) == brute([r[:2] for r in same], [])
    assert resampling.resampled(frame(spark, []), target).count() == 0
    assert [r["rank"] for r in resampling.resampled(frame(spark, [(1, None, "", ""), (None, "few words", "", "")]), target).collect()] == [None, None]


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = resampling.resampled(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert got(df) == sorted(con.execute(resampling.OP12_SQL).fetchall(), key=str)
