import random

import duckdb
import pandas as pd

from tests.llm.cases import WORD, frame, odd_documents
from tidewell.llm import mixing


def sql(rows):
    con = duckdb.connect()
    con.register("docs", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[3] for r in rows]}))
    con.sql("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM docs")
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in con.sql(mixing.OP3_SQL).fetchall()), key=str)


def test_equals_sql(spark):
    for seed in (1, 2):
        rows = odd_documents(seed, 80)
        got = mixing.mix_report(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert sorted(map(tuple, got), key=str) == sql(rows)
    assert mixing.mix_report(frame(spark, [])).count() == 0


def test_targets_and_taken(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 60), "en", rng.choice(["a"] * 8 + ["b", "c", "d"])) for i in range(1500)]
    got = mixing.mix_report(frame(spark, rows)).toPandas().merge(pd.DataFrame({"doc_id": [r[0] for r in rows], "source": [r[3] for r in rows]}), on="doc_id")
    sizes = got.groupby("source")["size"].sum()
    target = got.groupby("source")["target"].first()
    assert abs(target.sum() - sizes.sum()) < 1e-6 and (target <= 3 * sizes + 1e-9).all()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"] == 0).all()
    taken = got.groupby("source")["taken"].sum()
    assert ((taken - target).abs() <= 3 * 60 + 0.02 * target).all(), (taken, target)
    again = mixing.mix_report(frame(spark, list(reversed(rows)))).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == got.sort_values("doc_id")["taken"].tolist()


def test_mixed_rows_repeat_documents(spark):
    rows = [(i, " ".join("w" * (i % 5 + 1)), "en", "st"[i % 3 == 0]) for i in range(60)] + [(99, None, "en", "t")]
    docs = frame(spark, rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.systematic_copies(docs).collect()}
    mixed = mixing.mixed_rows(docs).collect()
    assert {d: sum(r["doc_id"] == d for r in mixed) for d in copies} == copies and all(r["copies"] == "copies" for r in mixed)
    words = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect()} == {d: words[d] * n for d, n in copies.items()}


def test_texts_of_one_id_and_size_are_taken_alike_at_every_run(spark):
    rows = [(7, f"word{i:03d} more", "en", "a") for i in range(40)] + [(8 + i, "w " * 40, "en", "b") for i in range(40)]
    one, two = (sorted(r["text"] for r in mixing.mixed_rows(frame(spark, x)).collect()) for x in (rows, list(reversed(rows))))
    assert one == two
