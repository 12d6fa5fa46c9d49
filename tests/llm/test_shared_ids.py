"""Rows without an id, and unlike texts of one id, are documents of their own in the pipeline."""

import random

from tests.llm.cases import frame
from tidewell.llm import _shuffle, nearjoin, substring


def test_one_of_each_keeps_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 3000)
    rng = random.Random(3)
    say = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    near = lambda t: t.rsplit(" ", 1)[0] + " edited"
    alone = [say(60) for _ in range(12)]
    twice, shared, other = say(60), say(60), say(60)
    rows = [(None, t, None, None) for t in alone]
    rows += [(None, twice, None, None), (None, near(twice), None, None), (None, alone[0], None, None), (None, None, None, None), (None, None, None, None)]
    rows += [(5, shared, None, None), (5, other, None, None), (7, near(shared), None, None), (8, near(other), None, None), (9, near(alone[1]), None, None)]
    got = [(r["doc_id"], r["text"]) for r in nearjoin.one_of_each(frame(spark, rows)).collect()]
    assert sum(t in (twice, near(twice)) for _, t in got) == 1
    want = [(None, t) for t in alone] + [(None, None), (5, shared), (5, other)]
    assert sorted((x for x in got if x[1] not in (twice, near(twice))), key=str) == sorted(want, key=str)
    found = sorted(map(tuple, nearjoin.near_classes(frame(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert found == sorted([(d, {7: 5, 8: 5, 9: None}.get(d, d)) for d, *_ in rows], key=str)


def test_without_repeats_tells_texts_of_an_id_apart(spark, monkeypatch):
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 3000)
    rng = random.Random(4)
    say = lambda k: " ".join(f"w{rng.randrange(5000)}" for _ in range(k))
    passage = say(30)
    texts = [say(20) for _ in range(8)]
    rows = [(None, f"{t} {passage}", None, None) for t in texts[:4]] + [(3, f"{texts[4]} {passage}", None, None), (3, texts[5], None, None), (4, texts[6], None, None)]
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in substring.without_repeats(frame(spark, rows)).collect()), key=str)
    assert sum(passage in t for _, t, _ in got) == 1
    assert sorted(((d, t.replace(" " + passage, "")) for d, t, _ in got), key=str) == sorted([(None, t) for t in texts[:4]] + [(3, texts[4]), (3, texts[5]), (4, texts[6])], key=str)
