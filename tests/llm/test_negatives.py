import math
import pathlib
import random

import duckdb
import numpy as np
import pytest

from tidewell.llm import negatives

DDL = "vec_id long, embedding array<double>, label int, id string, v string, a string"


def brute(rows, every=50):
    vecs = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        vecs[i] = min(vecs.get(i, (label, e)), (label, e))
    vecs = {i: (label, [math.floor(256 * x) for x in e]) for i, (label, e) in vecs.items()}
    out = []
    for a, (own, x) in vecs.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in vecs.items() if i != a}
        for p in sorted((i for i in score if vecs[i][0] == own), key=lambda i: (-score[i], i))[:5]:
            able = [i for i in score if vecs[i][0] != own and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(sorted(able, key=lambda i: (-score[i], i))[:3])]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "i", "v", "a") for r in rows], DDL)
    return sorted(map(tuple, negatives.hard_negatives(negatives.relabelled(df)).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, n in (("ROWS", 60), ("ANCHORS", 3), ("LEAST_DIMS", 3), ("CHUNKS", 4)):
        monkeypatch.setattr(negatives, name, n)


def test_against_brute_force(spark, small):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(rng.choice([20, 20, 20, 7]))], rng.choice([0, 1, 1, 1, 1, 9])) for i in range(400)]
    rows += [(i, rows[i % 7][1], rng.randrange(3)) for i in range(400, 460)]  # ties
    rows += [(600, None, 1), (601, [1.0, None], 1), (602, [math.nan] * 20, 1), (603, [math.inf] * 20, 1), (None, [1.0] * 20, 1), (650, [1.0] * 20, None), (604, [], 1), (605, [2.0], 2), (0, rows[0][1], 5), (700, [0.0] * 20, 1), (-50, rows[3][1], 1)]
    want = brute(rows)
    assert len(want) > 50 and got(spark, rows) == want


def test_large_components(spark, small):
    """Sums beyond 2^53 and parts beyond 2^63 whose sum is not."""
    big = 2.0**22
    rows = [(50, [big, 1.0, big, 0.25], 1), (51, [big, 1.0, big, 0.5], 1), (52, [big, 1.0, 0.0, 0.75], 2), (53, [big * 0.75, 0.5, 0.0, 0.0], 2), (54, [big, -1.0, 0.0, 0.5], 2)]
    assert got(spark, rows) == brute(rows) != []
    high = 7_900_000.0
    rows = [(50, [high, high, high, high], 1), (51, [high, high, high, -high], 1), (52, [high, 0.5, 0.0, 0.0], 2), (53, [high * 1.25, 0.5, 0.0, 0.0], 2)]
    assert got(spark, rows) == brute(rows) != []


def test_few_and_none(spark):
    rows = [(50, [1.0, 2.0], 1), (51, [1.0, 1.0], 1), (52, [0.75, 0.75], 2)]
    assert got(spark, rows) == brute(rows) != []
    assert got(spark, []) == [] == got(spark, [(50, [1.0], 1)])


def test_parts_wrap_and_sums_do_not():
    a, b = np.array([[2**40, 2**40]]), np.array([[2**40, -(2**40)], [3, 4]])
    assert negatives.products(a, b).tolist() == [[0, 7 * 2**40]]


def test_sql_agrees(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    got = negatives.hard_negatives(negatives.relabelled(spark.read.parquet(path)))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(negatives.OP11_SQL).fetchall())


def test_no_scores_are_written(spark):
    """Half of the rows are anchors: 18 million scores, 72 MB where each is written once."""
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    used = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(rng.normal(size=(6000, 4)).round(2))], "vec_id long, embedding array<float>, label int")
    before = used()
    got = negatives.hard_negatives(rows, every=2).filter("anchor_id < 40").collect()
    assert len(got) > 100 and used() - before < 5_000_000
