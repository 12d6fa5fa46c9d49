import random

import pyarrow as pa

from tests.llm.cases import brute_near, frame, odd_documents
from tidewell.llm import _seq, _shuffle, nearjoin


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 3000)
    rows = odd_documents(4, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_classes(frame(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Variants of one text at similarities around the threshold, so that links form long chains."""
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 20000)
    rng = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_classes(frame(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_one_of_each_and_empty(spark):
    rows = odd_documents(5, 30)
    kept = [r["doc_id"] for r in nearjoin.one_of_each(frame(spark, rows)).collect()]
    want = {d for d, (_, c) in brute_near(rows).items() if d == c}
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert nearjoin.near_classes(frame(spark, [])).count() == 0


def test_template_texts_make_no_pairs(spark, monkeypatch):
    """Texts of one template with words of their own lie below the threshold: their common tokens must not pair them."""
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 20000)
    rng = random.Random(3)
    template = " ".join(f"c{i}" for i in range(12))
    rows = [(i, f"{template} o{rng.randrange(10**9)} p{rng.randrange(10**9)}", None, None) for i in range(300)]
    rows += [(300 + i, f"{template} o{rng.randrange(10**9)}", None, None) for i in range(30)]  # these link
    made, exact = [], nearjoin.exact_pairs
    monkeypatch.setattr(nearjoin, "exact_pairs", lambda *a: made.append(exact(*a)) or made[-1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_classes(frame(spark, rows)).collect()}
    assert got == brute_near(rows)
    assert made[0].count() <= 30


def test_texts_longer_than_a_strip(monkeypatch):
    texts = pa.array([" ".join(f"w{i * k % 97}" for i in range(n)) for k, n in ((1, 400), (3, 2), (5, 0), (7, 90), (2, 700))])
    sets = lambda: [x.tolist() for x in nearjoin.shingle_sets(*_seq.text_bytes(texts))]
    want = sets()
    monkeypatch.setattr(nearjoin, "STRIP", 200)
    assert sets() == want and len(want) == 5


def test_salts_and_bands(spark, monkeypatch):
    """Answers of a token split into salts."""
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 20000)
    monkeypatch.setattr(nearjoin, "SALT", 3)
    monkeypatch.setattr(nearjoin, "MANY", 4)
    rng = random.Random(5)
    base = [[f"t{b}x{i}" for i in range(60)] for b in range(3)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words[rng.randint(0, 6) :]), None, None))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearjoin.near_classes(frame(spark, rows)).collect()}
    assert got == brute_near(rows)
