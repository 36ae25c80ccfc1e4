"""Periodic runs against a plain search of every period."""

import hashlib
import random
import zlib

import pytest

from closebook.llm import runs
from closebook.llm.queries import QUERIES


def plain_runs(words, least=6, times=4):
    """Every stretch by every period; the smallest period of a stretch is its own."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - begin + q
            if length >= max(least, times * q):
                found.setdefault((begin, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_plain_search(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 200:
        block = [str(rng.randrange(rng.choice([1, 2, 3, 30]))) for _ in range(rng.randrange(1, 9))]
        words += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randrange(len(block))]
    words = [w.encode() for w in words]
    for least, times in ((6, 4), (2, 2), (10, 3)):
        assert runs.word_runs(words, least, times) == plain_runs(words, least, times)


def test_runs_of_hard_sequences(monkeypatch):
    cases = [fibonacci(400), ["a"] * 300, (["a"] * 7 + ["b"]) * 30, (["a", "b"] * 20 + ["c"]) * 9, [str(bin(i).count("1") % 2) for i in range(400)], [str(i) for i in range(50)], [], ["x"] * 5]
    for prime in (runs._PRIME, 3):  # with 3, nearly every hash is false
        monkeypatch.setattr(runs, "_PRIME", prime)
        for case in cases:
            words = [w.encode() for w in case]
            assert runs.word_runs(words) == plain_runs(words) and runs.word_runs(words, 2, 2) == plain_runs(words, 2, 2)


def test_long_runs_end_in_time():
    words = [b"a"] * 300_000 + [b"b", b"c"] * 100_000 + [b"%d" % (i % 1000) for i in range(100_000)]
    assert runs.word_runs(words) == [(0, 300_000, 1), (300_000, 200_000, 2), (500_000, 100_000, 1000)]


def brute(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    out = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in out)))


def test_report_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a " * 9, "a\x1cb " * 6, "É é é " * 5, "x\x0by\x0cx\ry\nx y x y", *(" ".join(str(rng.randrange(5)) for _ in range(rng.randrange(60))) for _ in range(60))]
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, "a " * 9, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int, collapsed string")
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in runs.report(docs).collect()), key=key) == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert runs.report(docs.limit(0)).count() == 0
    kept = {r.doc_id: r for r in runs.find(docs).collect()}
    assert kept[3].collapsed == "a" and [tuple(x) for x in kept[3].runs] == [(0, 9, 1)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r[1] or "") < 8000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_find_runs"](spark, sf).collect()}
    assert len(rows) > 100 and all(got[r[0]] == brute(r[0], r[1]) for r in rows) and any(x[1] for x in got.values())
