"""Periodic runs of words: Lyndon words of both orders, extended by rolling-hash comparison.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period ``q`` (words ``q``
apart are alike) that no neighbour extends; runs of ``least`` words and ``times`` periods or more are found, all of them.

A word that occurs fewer than ``times`` times can't be part of such a run, so a text is cut at those words first. In
each piece a stack is scanned right to left, once under the order of the word numbers and once under its reverse; it
gives the longest Lyndon word that begins at each place. Every run has such a word as its root under one of the two
orders, so a place whose word is repeated is extended to both sides. Suffixes are compared word by word at first, then
by a binary search over prefix hashes; what the search says is verified word by word, and a verified stretch is
remembered for its distance, so no stretch is verified twice. A false hash can cost time, never a run.

Null text has no words. Repeated rows each give a row. A null doc_id is kept, and no words of it are ``varied``. Empty
tables give no rows; extra columns are ignored. A text is one task's work, in memory linear in its length.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

LEAST, TIMES = 6, 4
#: Words compared one by one before hashes are asked.
NEAR = 8
_PRIME, _BASE = (1 << 31) - 1, 911_382_323
_FOUND = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


class Piece:
    """One sequence of word numbers, and how far its places agree."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.words, self.n = ids, ids.tolist(), len(ids)
        self.hashes: list[int] | None = None
        self.verified: dict[int, tuple[int, int]] = {}

    def _hash(self) -> None:
        powers = np.ones(self.n + 1, dtype=np.uint64)
        done = 1
        while done <= self.n:
            step = int(powers[done - 1]) * _BASE % _PRIME
            more = min(done, self.n + 1 - done)
            powers[done : done + more] = powers[:more] * np.uint64(step) % np.uint64(_PRIME)
            done += more
        sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum((self.ids.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(_PRIME), out=sums[1:])
        self.hashes, self.powers = (sums % np.uint64(_PRIME)).tolist(), powers.tolist()

    def _alike(self, i: int, j: int, length: int) -> bool:
        h = self.hashes
        return ((h[i + length] - h[i]) * self.powers[j - i] - h[j + length] + h[j]) % _PRIME == 0

    def _search(self, most: int, alike) -> int:
        """The largest length up to ``most`` for which ``alike`` holds, by doubling and halving."""
        if self.hashes is None:
            self._hash()
        low, high = 0, NEAR
        while high < most and alike(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if alike(mid) else (low, mid)
        return low

    def _first_difference(self, i: int, j: int, length: int) -> int:
        """Place of the first pair of unlike words among ``length`` pairs, or ``length``."""
        unlike = self.ids[i : i + length] != self.ids[j : j + length]
        return int(unlike.argmax()) if unlike.any() else length

    def ahead(self, i: int, j: int) -> int:
        """How many words from i < j on are alike."""
        words, stop, k = self.words, min(NEAR, self.n - j), 0
        while k < stop and words[i + k] == words[j + k]:
            k += 1
        if k < stop or j + k == self.n:
            return k
        place, length = self.verified.get(j - i, (self.n, -1))
        if place <= i <= place + length:
            return place + length - i
        if self.hashes is None:
            self._hash()
        gap = place - i if length >= 0 and i < place else self.n
        if gap <= NEAR:  # these words have been compared
            same = gap + length
        elif j + gap <= self.n and self._alike(i, j, gap) and self._first_difference(i, j, gap) == gap:
            same = gap + length
        else:
            same = self._first_difference(i, j, self._search(self.n - j, lambda m: self._alike(i, j, m)))
        while j + same < self.n and words[i + same] == words[j + same]:  # in case the hash said less
            same += 1
        self.verified[j - i] = (i, same)
        return same

    def behind(self, i: int, j: int) -> int:
        """How many words before i < j are alike."""
        words, k = self.words, 0
        stop = min(NEAR, i)
        while k < stop and words[i - k - 1] == words[j - k - 1]:
            k += 1
        if k < stop or k == i:
            return k
        found = self._search(i, lambda m: self._alike(i - m, j - m, m))
        unlike = self.ids[i - found : i] != self.ids[j - found : j]
        same = int(unlike[::-1].argmax()) if unlike.any() else found
        while same < i and words[i - same - 1] == words[j - same - 1]:
            same += 1
        return same

    def lyndon(self, ranks: list[int]) -> np.ndarray:
        """Length of the longest Lyndon word that begins at each place: the way to the next smaller suffix."""
        n, out, stack, ahead = self.n, [0] * self.n, [], self.ahead
        for i in range(n - 1, -1, -1):
            own = ranks[i]
            while stack:
                j = stack[-1]
                other = ranks[j]
                if other == own:
                    k = ahead(i, j)
                    smaller = j + k == n or ranks[j + k] < ranks[i + k]
                else:
                    smaller = other < own
                if smaller:
                    break
                stack.pop()
            out[i] = (stack[-1] if stack else n) - i
            stack.append(i)
        return np.array(out, dtype=np.int64)

    def runs(self, least: int, times: int) -> set[tuple[int, int, int]]:
        """(start, length, period) of every run."""
        found: set[tuple[int, int, int]] = set()
        most = max(self.words, default=0)
        for ranks in (self.words, [most - x for x in self.words]):
            period = self.lyndon(ranks)
            at = np.arange(self.n)
            # The first root of a run begins less than a period after the run does.
            able = np.flatnonzero(at + (times - 1) * period <= self.n)
            for k in range(1, times - 1):
                p = period[able]
                able = able[(self.ids[able] == self.ids[able + k * p]) & (self.ids[able + p - 1] == self.ids[able + (k + 1) * p - 1])]
            upto: dict[int, int] = {}
            for i, p in zip(able.tolist(), period[able].tolist(), strict=True):
                if i + p <= upto.get(p, 0):  # of a run that is known
                    continue
                right = self.ahead(i, i + p)
                if right <= (times - 2) * p:
                    continue
                start = i - self.behind(i, i + p)
                length = i + p + right - start
                upto[p] = i + p + right
                if length >= max(least, times * p):
                    found.add((start, length, p))
        return found


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if times < 2:
        raise ValueError("a run repeats its period at least once")
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if not len(ids):
        return []
    rare = np.flatnonzero(np.bincount(ids)[ids] < times)
    begins, ends = np.r_[0, rare + 1], np.r_[rare, len(ids)]
    found: list[tuple[int, int, int]] = []
    for a, b in zip(begins[ends - begins >= least].tolist(), ends[ends - begins >= least].tolist(), strict=True):
        found += [(a + s, n, p) for s, n, p in Piece(ids[a:b]).runs(least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def varied(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by the crc32 of their id, repeat a stretch of theirs from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    if not runs:
        return b" ".join(words)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()])


def _find(batches, least: int, times: int, vary: bool):
    for batch in batches:
        for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            out: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                words = raw.split()
                if vary:
                    words = varied(words, doc)
                runs = word_runs(words, least, times)
                row = (doc, len(words), [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], collapsed(words, runs).decode())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), many, many, many, pa.string()), strict=True)], names=["doc_id", "n_words", "starts", "lengths", "periods", "collapsed"])


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, vary: bool = False) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed text of each document.

    ``vary``: texts are first changed as ``varied`` says, which plants runs.
    """
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_find, least=least, times=times, vary=vary), _FOUND)
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return found.select("doc_id", "n_words", runs.cast(kind).alias("runs"), "collapsed")


def report(docs: DataFrame, least: int = LEAST, times: int = TIMES, vary: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without a run) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    told = find(docs, least, times, vary).withColumn("best", best)
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
