import hashlib
import random

import pytest

from tests.llm.cases import frame, odd_documents
from tidewell.llm import pieces
from tidewell.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "\n", "a\nb", "▁", "▁▁a", " ▁ x", "日本語 \0 x", "😀😀 hi", "<s> </s> <unk> <0x0A>", "\t\t  tabs", "x" * 5000, " " * 5000, "ab" * 300 + " " + "é" * 100,
    "é fi ﬁ  A", "﻿bom", "a  b   c    d     e" + " " * 17 + "f" + " " * 40 + "g", "end ", "end  ", " end",
]


@pytest.fixture(scope="module")
def own():
    return pieces.Merger(PATH)


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(" abcdefghinorstu\n▁ é日😀́") for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def test_whole_texts_against_the_library(own, monkeypatch):
    texts = ODD + random_texts(1, 600) + [t or "" for _, t, *_ in odd_documents(9)]
    want = own.library.encode(texts)
    for short, cache in ((24, 10**6), (1, 50), (6, 400)):
        monkeypatch.setattr(pieces, "SHORT", short)
        monkeypatch.setattr(pieces, "CACHE", cache)
        own.known, own.older = {}, {}
        got = list(own.batch(texts))
        assert [[int(i) for i in x.split(",")] if x else [] for _, x, _ in got] == want
        assert [n for n, *_ in got] == [len(w) for w in want] and [t for *_, t in got] == own.library.decode(want)


def test_agendas_agree(own):
    segments = [pieces.MARK + t.replace(" ", pieces.MARK)[:20] for t in random_texts(2, 500)]
    assert own.together(segments) == [own.alone(s) for s in segments]


def test_an_unlike_result_ends_the_task(own, monkeypatch):
    own.known, own.older = {}, {}
    monkeypatch.setattr(own, "alone", lambda s: [5])
    with pytest.raises(ValueError, match="the library encodes"):
        list(own.batch(["w" * 100]))


def test_decoding_of_any_ids(own):
    for text in ODD:
        ids = own.library.encode(text)
        assert own.text_of(ids)[1:] == own.library.decode(ids)


def test_report(spark):
    rows = odd_documents(2) + [(3000 + i, t, "en", "a") for i, t in enumerate(ODD)]
    library = pieces.merger(PATH).library
    ids = [library.encode(t or "") for _, t, *_ in rows]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(((r[0], len(i), digest(",".join(map(str, i))), digest(library.decode(i))) for r, i in zip(rows, ids)), key=str)
    assert sorted(map(tuple, pieces.piece_report(frame(spark, rows), PATH).collect()), key=str) == want
    assert pieces.piece_report(frame(spark, []), PATH).count() == 0


def test_rows_keep_their_columns(spark):
    out = pieces.encoded(frame(spark, odd_documents(2)).withColumnRenamed("size", "ids"), PATH)
    rows = out.collect()
    assert out.columns.count("ids") == 1 and {"doc_id", "lang", "key", "decoded"} <= set(out.columns)
    assert all(r["decoded"] == (r["text"] or "") and pieces.merger(PATH).library.encode(r["text"] or "") == r["ids"] for r in rows)


def test_unsupported_models(tmp_path):
    with pytest.raises(Exception):
        pieces.Merger(str(tmp_path / "none.model"))
