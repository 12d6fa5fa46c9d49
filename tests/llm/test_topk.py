import math
import random

import duckdb
import numpy as np

from tidewell.llm import topk

DDL = "vec_id long, embedding array<float>, norm string, v string"


def brute(rows, k=5, every=50):
    vecs = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        e = [float(np.float32(x)) for x in e]
        vecs[i] = min(vecs.get(i, e), e)
    vecs = {i: [math.floor(256 * x) for x in e] for i, e in vecs.items()}
    out = []
    for q in vecs:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(vecs[q], vecs[c])), c) for c in vecs if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "n", "v") for i, e in rows], DDL)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 3]) for _ in range(20)]) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 460)]  # ties
    rows += [(600, None), (601, [1.0, None]), (602, [math.nan] * 20), (603, [math.inf] * 20), (None, [1.0] * 20), (604, []), (605, [2.0]), (0, rows[0][1]), (650, [0.0] * 20)]
    got = sorted(map(tuple, topk.top_products(frame(spark, rows)).collect()))
    assert got == brute(rows)


def test_few_and_none(spark):
    rows = [(50, [1.0, 2.0]), (51, [0.5, 0.5]), (52, [-1.0, 0.0])]
    assert sorted(map(tuple, topk.top_products(frame(spark, rows)).collect())) == brute(rows)
    assert topk.top_products(frame(spark, [])).count() == 0
    assert topk.top_products(frame(spark, [(7, [1.0])])).count() == 0


def test_many_vectors_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    sizes, pack = [], topk.blocks
    monkeypatch.setattr(topk, "blocks", lambda rows, block: sizes.append(pack(rows, block)) or sizes[-1])
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(i, [1.5, -2.0] + [0.0] * 6) for i in range(300, 600)]
    got = sorted(map(tuple, topk.top_products(frame(spark, rows)).collect()))
    assert got == brute(rows)
    assert max(r["n"] for r in sizes[0].select("n").collect()) <= 40


def test_large_components(spark):
    """Sums beyond 2^53, of few large components and of many, and beyond a long."""
    one = [(50, [(2.0**27 - 1) / 256, 1 / 256]), (51, [(2.0**27 - 1) / 256, 0.0]), (52, [(2.0**27 - 1) / 256, 1 / 256]), (53, [(2.0**27 - 2) / 256, 1 / 256])]
    many = [(i, [(2.0**21 - 1) / 256] * 8192) for i in (50, 51)] + [(52, [(2.0**21 - 2) / 256] + [(2.0**21 - 1) / 256] * 8191)]
    for rows in (one, many):
        df = spark.createDataFrame([(*r, "n", "v") for r in rows], DDL.replace("float", "double"))
        whole = {i: [math.floor(256 * x) for x in e] for i, e in rows}
        want = sorted((-sum(a * b for a, b in zip(whole[50], e)), i) for i, e in whole.items() if i != 50)
        assert sorted(map(tuple, topk.top_products(df).collect())) == [(50, n + 1, i, -s) for n, (s, i) in enumerate(want)]
    beyond = [(50, [2.0**30, 2.0**30]), (51, [2.0**30, 0.0]), (52, [-(2.0**30), 0.0]), (53, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "n", "v") for r in beyond], DDL.replace("float", "double"))
    assert sorted(map(tuple, topk.top_products(df).collect())) == [(50, 1, 51, 2**63 - 1), (50, 2, 53, 2**47), (50, 3, 52, -(2**63))]


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert sorted(map(tuple, topk.top_products(spark.read.parquet(path)).collect())) == sorted(con.execute(topk.OP5_SQL).fetchall())
