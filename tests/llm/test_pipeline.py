import corpus_pipeline
from tests.llm.cases import brute_near, brute_substring

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        rows = docs.collect()
        old = [(r["doc_id"], r["text"]) for r in before]
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert 0.7 * len(before) < len(rows) <= len(before)
        if name == "near_duplicates":
            assert sorted(r["doc_id"] for r in rows) == sorted(d for d, (_, c) in brute_near(old).items() if c == d)
        if name == "substring_dedup":
            want = brute_substring(old)
            assert sum(len(r["text"].split()) for r in rows) == sum(n - m for x in want.values() for n, m, _ in x)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "packing":
            tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
            assert sum(r["length"] for r in rows) == sum(tokens[d] for d, _ in old)
    assert corpus_pipeline.run(spark, SF).count() == len(rows)
