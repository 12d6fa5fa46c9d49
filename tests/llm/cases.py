"""Small inputs with every odd case, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Column names of the operators' own that may clash with a table's.
EXTRA = ("g", "kind", "key", "size", "bucket", "shard", "tokens", "_id", "row", "copies")
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def odd_documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty, short and long texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["Ünïcode", "naïve", "日本", "the", "The", "a'b", "x|y"]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, rows = say(45), []
    for i in range(n):
        t = say(rng.randint(1, 120))
        if i % 5 == 0:
            t = f"{t} {passage}\n{say(3)}"
        if i % 7 == 0 and rows:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = "edited"
            t = " ".join(words)
        if i % 11 == 0 and rows:
            t = rng.choice(rows)[1]
        rows.append((i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, " \t\n ", None, None), (1003, "one", "de", "b"), (1004, "one", "de", "b"), (1005, "x " * 3000, "en", "c"), (1006, say(4000), "en", "a")]
    rows += [rows[3], (None, say(30), "en", "b"), (1007, "repeat " * 60, "en", "a"), (1008, "12345 !!", "en", "a")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], DDL)


def brute_substring(rows, window=20):
    """doc_id -> (words, removed, digest); rows of one id count as that id's places."""
    first, out = {}, {}
    split = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    rank = lambda d: (d is not None, d or 0)
    for d, w in split:
        for p in range(len(w) - window + 1):
            k, place = tuple(w[p : p + window]), (rank(d), p)
            first[k] = min(first.get(k, place), place)
    for d, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (rank(d), p):
                gone[p : p + window] = [True] * window
        out.setdefault(d, []).append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def brute_runs(rows, window=50):
    first, out = {}, {}
    rank = lambda d: (d is not None, d or 0)
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in data:
        for p in range(len(b) - window + 1):
            first[b[p : p + window]] = min(first.get(b[p : p + window], rank(d)), rank(d))
    for d, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < rank(d):
                gone[p : p + window] = b"\1" * window
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.setdefault(d, []).append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text, words=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_near(rows):
    """doc_id -> (set size, component), for rows whose ids are told apart by null first."""
    sets = [(d, shingles(t)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets}
    rank = lambda d: (d is not None, d or 0)

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)), key=rank)
                up[hi] = lo
    return {d: (len(x), root(d)) for d, x in sets}


def held_out(d):
    return zlib.crc32(str(d).encode()) % 4 == 2
