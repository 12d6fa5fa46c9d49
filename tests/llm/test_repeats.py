import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import brute_runs, brute_substring, frame, odd_documents
from tidewell.llm import _repeats, _shuffle, runs_index, substring


def check(got, want):
    found = {}
    for r in got:
        found.setdefault(r[0], []).append(tuple(r[1:]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_documents(spark, monkeypatch, seed):
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 3000)
    rows = odd_documents(seed)
    check(substring.substring_report(frame(spark, rows)).collect(), brute_substring(rows))
    check(runs_index.run_report(frame(spark, rows)).collect(), brute_runs(rows))


def test_low_entropy(spark, monkeypatch):
    """Periodic texts over a tiny alphabet, where windows overlap themselves and keys recur."""
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 2000)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 90))), None, None) for i in range(40)]
    rows += [(100, "a " * 100, None, None), (101, "a b " * 50, None, None), (102, "b a " * 50, None, None), (103, "ab" * 200, None, None), (104, "ba" * 200, None, None), (105, "z" * 500, None, None)]
    check(substring.substring_report(frame(spark, rows), 6).collect(), brute_substring(rows, 6))
    check(runs_index.run_report(frame(spark, rows), 17).collect(), brute_runs(rows, 17))


def test_empty_table(spark):
    assert substring.substring_report(frame(spark, [])).count() == 0
    assert runs_index.run_report(frame(spark, [])).count() == 0


def test_texts_without_repeats(spark):
    rows = [(1, "k " * 3 + " ".join(f"p{i}" for i in range(30)), "en", "a"), (2, "head " + " ".join(f"p{i}" for i in range(30)) + " tail", "en", "a"), (3, " ".join(f"p{i}" for i in range(25)), "en", "b"), (4, "own  text\n", "en", "b"), (5, None, None, None)]
    got = {r["doc_id"]: r for r in substring.without_repeats(frame(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "head tail" and got[4]["text"] == "own  text\n" and got[5]["text"] is None
    assert 3 not in got and got[2]["g"] == "g"


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(30):
        passages = [[rng.randrange(3) for _ in range(rng.randint(1, 20))] for _ in range(4)]
        automaton, at = substring.SuffixAutomaton(), 0
        flat = []
        for p in passages:
            automaton.add(p, list(range(at, at + len(p))))
            flat.append((at, p))
            at += len(p)
        automaton.settle()
        text = [rng.randrange(4) for _ in range(40)]
        for size in (1, 3, 5):
            for i, got in enumerate(automaton.matches(text, size)):
                part = text[i - size + 1 : i + 1] if i + 1 >= size else None
                ends = [a + j + size - 1 for a, p in flat for j in range(len(p) - size + 1) if p[j : j + size] == part]
                assert got == (min(ends) if ends else -1)


def test_run_index_matching_statistics():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(10):
        text = rng.integers(0, 3, 80)
        index = runs_index.RunIndex(text)
        query = rng.integers(0, 4, 60)
        got = np.zeros(60, int)

        def keep(at, length, place, got=got):
            got[at] = length

        index.matching(query, np.array([0, 20, 40]), np.array([20, 40, 60]), keep)
        body = text.tobytes()
        for i in range(60):
            end = (i // 20 + 1) * 20
            best = max((k for k in range(end - i + 1) if any((text[j : j + k] == query[i : i + k]).all() for j in range(len(text) - k + 1))), default=0)
            assert got[i] == best, (i, got[i], best, body)


def test_suffix_automaton_tells_the_earliest_place_in_any_order():
    rng = random.Random(7)
    for _ in range(30):
        passages = [[rng.randrange(3) for _ in range(rng.randint(1, 20))] for _ in range(4)]
        places = [[rng.randrange(1000)] for _ in passages]
        automaton = substring.SuffixAutomaton()
        for p, at in zip(passages, places):
            automaton.add(p, list(range(at[0], at[0] + len(p))))
        automaton.settle()
        text = [rng.randrange(4) for _ in range(40)]
        for size in (1, 3, 5):
            for i, got in enumerate(automaton.matches(text, size)):
                part = text[i - size + 1 : i + 1] if i + 1 >= size else None
                ends = [a[0] + j + size - 1 for a, p in zip(places, passages) for j in range(len(p) - size + 1) if p[j : j + size] == part]
                assert got == (min(ends) if ends else -1)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_keys(spark, monkeypatch, hot):
    """A passage that all texts have, with edges of their own; keys looked at window by window."""
    monkeypatch.setattr(_shuffle, "GROUP_BYTES", 3000)
    monkeypatch.setattr(_repeats, "HOT", hot)
    rng = random.Random(8)
    say = lambda k: " ".join(f"w{rng.randrange(900)}" for _ in range(k))
    passage = say(50)
    rows = [(i, f"{say(rng.randint(0, 60))} {passage} {say(rng.randint(0, 60))}", None, None) for i in range(60)] + odd_documents(9, 20)[-12:]
    check(substring.substring_report(frame(spark, rows)).collect(), brute_substring(rows))
    check(runs_index.run_report(frame(spark, rows)).collect(), brute_runs(rows))


def test_straddling_windows_of_a_hot_key_stay_at_home(spark, monkeypatch):
    """Of a hot key only windows that repeat go to its shard."""
    monkeypatch.setattr(_repeats, "HOT", 8)
    rng = random.Random(10)
    say = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage = say(40)
    unit = _repeats.Unit(True, 20, 6)
    texts = pa.table({"doc_id": pa.array(range(30), pa.int64()), "text": [f"{say(30)} {passage} {say(30)}" for _ in range(30)]})
    t, none = _repeats.load(unit, texts), np.zeros(0, np.int64)
    key, count = _repeats.key_counts(unit, t, none, True)
    hot = key[count > 8]
    again, times = _repeats.hot_windows(unit, t, none, hot)
    assert len(hot) and (times > 1).sum() == 21
    _, windows, _, _ = _repeats.segments(unit, t, none, hot, hot, again[times > 1])
    assert windows.sum() == 30 * 21


@pytest.mark.parametrize("unit", [_repeats.Unit(True, 20, 6), _repeats.Unit(False, 50, 16)])
def test_texts_longer_than_a_strip(monkeypatch, unit):
    """Strips cut runs, but no window is left out or told twice."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(n)) for n in (300, 3, 0, 90, 25)] * 2
    t, none = _repeats.load(unit, pa.table({"doc_id": pa.array(range(10), pa.int64()), "text": texts})), np.zeros(0, np.int64)

    def windows():
        key, count = _repeats.key_counts(unit, t, none, False)
        hot = key[count > 2]
        again, times = _repeats.hot_windows(unit, t, none, hot)
        start, n, key, doc = _repeats.segments(unit, t, none, key[count > 1], hot, again[times > 1])
        return sorted((d, p, k) for s, m, k, d in zip(start.tolist(), n.tolist(), key.tolist(), doc.tolist()) for p in range(s, s + m))

    want = windows()
    monkeypatch.setattr(_repeats, "STRIP", 37)
    got = windows()
    assert len(want) == len(set(want)) and want and set(want) <= set(got)


def test_a_group_takes_a_few_times_its_bytes():
    """What a task holds at once is bounded by the group, with no index of eight bytes for each byte of it."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**4)}" for _ in range(400)) for _ in range(800)]
    table, unit = pa.table({"doc_id": pa.array(range(800), pa.int64()), "text": texts}), _repeats.Unit(True, 20, 6)
    tracemalloc.start()
    t = _repeats.load(unit, table)
    loaded = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    _repeats.key_counts(unit, t, np.zeros(0, np.int64), True)
    counted = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(map(len, texts))
    assert loaded < 10 * size and counted < 20 * size


def test_only_changed_texts_leave_the_task():
    t = _repeats.load(_repeats.Unit(True, 20, 6), pa.table({"doc_id": pa.array([1, 2, _repeats.NULL_ID, 3], pa.int64()), "text": ["a b", "", "c  d e", None]}))
    assert substring._text(t, np.array([False, False, True, False, True])).to_pylist() == [{"doc_id": None, "kept": "d"}]
    assert substring._text(t, None).num_rows == 0
    assert substring._text(t, np.ones(5, bool)).to_pylist() == [{"doc_id": 1, "kept": ""}, {"doc_id": None, "kept": ""}]
