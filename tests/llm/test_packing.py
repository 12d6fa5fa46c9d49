import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from tokenizers import Tokenizer

from tests.llm.cases import frame, odd_documents
from tidewell.llm import _seq, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_and_windows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 20_000)
    rows = odd_documents(3, 60) + [(2000, "It's 3 o'clock | naïve café — ÀÉ 12,5% <|endoftext|> foo_bar x y 中文 don't", None, None)]
    got = packing.pack_documents(frame(spark, rows), PATH).toPandas()
    full = Tokenizer.from_file(PATH)
    want = {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append([*full.encode(t or "", add_special_tokens=False).ids, 1])
    for d, own in got.groupby("doc_id", dropna=False):
        docs = want[None if d != d else int(d)]
        ids = docs[0]
        assert (own["doc_tokens"] == len(ids)).all() and own["length"].sum() == len(ids) * len(docs)
        for p in own.itertuples():
            part = ids[p.start : p.start + p.length]
            assert len(part) == p.length and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == p.ids_crc32
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window["offset"].iloc[0] == 0 and (window["offset"].to_numpy()[1:] == np.cumsum(window["length"])[:-1]).all() and window["length"].sum() <= packing.CAPACITY
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0


def test_little_padding():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 4000)
    window, offset = packing.pack(sizes, 2048)
    fill = np.bincount(window, weights=sizes)
    assert fill.max() <= 2048 and sizes.sum() / (2048 * len(fill)) > 0.97


def test_differencing_is_near_equal():
    sizes = np.array([8, 7, 6, 5, 4])
    got = np.bincount(packing.differencing(sizes, 2), weights=sizes)
    assert sorted(got) == [14, 16]  # differencing: 8-7, 6-5, 4 against 1 and 1
    big = np.random.default_rng(2).integers(1, 100, 900)
    load = np.bincount(packing.differencing(big, 30), weights=big)
    assert load.max() - load.min() <= 2


def test_window_count_rises():
    window, _ = packing.pack(np.array([60, 60, 60]), 100)
    assert len(set(window)) == 3


def test_ids_come_along_and_texts_may_be_longer_than_a_strip(monkeypatch):
    texts = [t for _, t, *_ in odd_documents(6, 40)]
    coder, full = packing.tokenizer(PATH), Tokenizer.from_file(PATH)
    for strip in (packing.STRIP_BYTES, 300):
        monkeypatch.setattr(packing, "STRIP_BYTES", strip)
        coder.clear()
        ids, bounds = coder.encode(*_seq.text_bytes(pa.array(texts)), 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*full.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_sequences_can_be_read_from_the_pieces(spark):
    rows = [r for r in odd_documents(7, 40) if r[0] is not None]
    got = packing.pack_documents(frame(spark, rows), PATH, ids=True).toPandas()
    full = Tokenizer.from_file(PATH)
    for p in got.itertuples():
        assert len(p.ids) == p.length and zlib.crc32(struct.pack(f"<{p.length}I", *p.ids)) == p.ids_crc32
    text = dict((r[0], r[1]) for r in reversed(rows))
    for d, own in got.groupby("doc_id"):
        ids = [i for p in own.sort_values("start").drop_duplicates("start").itertuples() for i in p.ids]
        assert ids == [*full.encode(text[d] or "", add_special_tokens=False).ids, 1]


def test_another_tokenizer_goes_by_its_own_rules(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.tokenizer(path).by_words and packing.tokenizer(PATH).by_words
    rows = [(1, "Two  spaces\n and CASE count, don't they?", None, None), (2, None, None, None)]
    got = {r["doc_id"]: list(r["ids"]) for r in packing.pack_documents(frame(spark, rows), path, ids=True).collect()}
    assert got == {1: [*Tokenizer.from_file(path).encode(rows[0][1], add_special_tokens=False).ids, 1], 2: [1]}


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 2_000)
    rows = [(None, "one text that many rows without an id share " * 4, None, None)] * 200
    got = packing.pack_documents(frame(spark, rows), PATH).toPandas()
    assert len(got) == 200 and (got["sequence_id"] // (1 << 24)).value_counts().max() < 60


def test_pieces_leave_strip_by_strip(monkeypatch):
    monkeypatch.setattr(packing, "STRIP_BYTES", 100)

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, pieces, _):
            return pieces

    monkeypatch.setattr(packing.F, "col", lambda _: Docs())
    monkeypatch.setattr(Docs, "cast", lambda self, _: self, raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"some words of text {i}" for i in range(40)]})
    out = list(packing.token_pieces(Docs(), public_tokenizers.path("word_bpe_49k.json"), ids=True)(iter([batch])))
    assert len(out) >= 10 and [i for b in out for i in b["doc_id"].to_pylist()] == list(range(40))
    coder = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    codes, bounds = coder.encode(*_seq.text_bytes(batch["text"]), 1)
    assert [x for b in out for x in b["ids"].to_pylist()] == [codes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
