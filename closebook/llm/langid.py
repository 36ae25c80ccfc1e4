"""Multilingual mixture inference: how much of each document is in which language.

Model: each language has a distribution over hashed byte trigrams of letters, counted by Spark over all
labelled documents (over a seeded choice only if ``per_language`` bounds them). Every labelled language is learned. Up to ``DENSE_LANGUAGES`` the distributions are one dense table, beyond that
only the counts that are not 0 are held, and a document's own rows are filled in from them.

Inference: a document's trigrams are drawn from a mixture of the languages. Expectation-maximisation
estimates the proportions; the set of languages is the one with the best penalised likelihood among the
nested sets by proportion, where each language beyond the first costs half the log of the number of
trigrams (a third of them counts, as each letter is in three).

``und`` with score 0 is given to null, empty and letterless texts, and to all if nothing could be learned.
Ties go to the language first by code point. Rows are independent, so repeated rows agree; empty input
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LETTER_BYTES, materialize, small, texts

BUCKETS, DENSE_LANGUAGES = 1 << 15, 64
_LETTER = re.compile(r"[^\W\d_]")


def grams(raw: bytes) -> np.ndarray:
    """Bucket of each trigram of the letters, words framed by single spaces."""
    words = raw.translate(_LETTER_BYTES).split()
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    g = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((g * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def sampled(rows: DataFrame, group: str, most: int, seed: int = 11) -> DataFrame:
    """A seeded choice of about ``most`` rows for each value of ``group``; smaller groups stay whole."""
    share = F.floor(F.least(F.lit(1.0), F.lit(most) / F.col("count")) * 1_000_000).alias("_share")
    shares = materialize(rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_group")).count().select("_group", share), "lang-shares")
    joined = rows.join(small(shares), rows[group] == shares["_group"])
    return joined.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < F.col("_share")).drop("_group", "_share")


def _count(batches):
    """Trigrams of each language by bucket; a task holds the counts of ``DENSE_LANGUAGES`` languages at most."""
    totals: dict[str, np.ndarray] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    held = 0

    def add():
        nonlocal held
        for lang, found in waiting.items():
            totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            totals[lang] += np.bincount(np.concatenate(found), minlength=BUCKETS)
        waiting.clear()
        held = 0

    def counted():
        add()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])
        totals.clear()

    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            if lang not in totals and lang not in waiting and len(totals.keys() | waiting.keys()) >= DENSE_LANGUAGES:
                yield from counted()
            found = grams(raw)
            waiting.setdefault(lang, []).append(found)
            held += len(found)
            if held >= 1 << 17:
                add()
    yield from counted()


class Model:
    """Smoothed trigram probabilities of the languages, each trigram's over its largest."""

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.langs = langs
        order = np.argsort(bucket, kind="stable")
        self.lang, self.n = lang[order].astype(np.int32), n[order].astype(np.float64)
        self.starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.totals = np.bincount(lang, weights=n, minlength=len(langs)) + 0.5 * BUCKETS
        self.dense = self._fill(np.arange(BUCKETS)) if 0 < len(langs) <= DENSE_LANGUAGES else None

    def _fill(self, buckets: np.ndarray) -> np.ndarray:
        counts = np.full((len(buckets), len(self.langs)), 0.5)
        begin, size = self.starts[buckets], self.starts[buckets + 1] - self.starts[buckets]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        counts[np.repeat(np.arange(len(buckets)), size), self.lang[at]] += self.n[at]
        p = counts / self.totals
        return p / p.max(1, keepdims=True)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        return self.dense[buckets] if self.dense is not None else self._fill(buckets)


def fit(docs: DataFrame, allowed: Column, per_language: int | None = None) -> Model:
    rows = docs.select("doc_id", "text", "lang").filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = (rows if per_language is None else sampled(rows, "lang", per_language)).mapInArrow(_count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    codes = table.column("lang").combine_chunks().dictionary_encode()
    names = codes.dictionary.to_pylist()
    langs = sorted(names)
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in names], np.int64)[codes.indices.to_numpy(zero_copy_only=False)]
    return Model(langs, lang, table.column("bucket").to_numpy(), table.column("n").to_numpy())


def proportions(rows: np.ndarray, times: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Mixture proportions of the columns, and the log-likelihood; row i stands ``times[i]`` times."""
    pi = np.full(rows.shape[1], 1 / rows.shape[1])
    for _ in range(rounds):
        new = pi * ((times / (rows @ pi)) @ rows) / times.sum()
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    pi = pi / pi.sum()
    return pi, float(times @ np.log(rows @ pi))


def mixture(raw: bytes, model: Model) -> tuple[list[int], np.ndarray]:
    """Chosen languages, largest first, and their proportions."""
    found, times = np.unique(grams(raw), return_counts=True)
    if not len(found) or not model.langs:
        return [], np.zeros(0)
    rows = model.rows(found)
    pi, full = proportions(rows, times)
    order = np.argsort(-pi, kind="stable")
    cost = 0.5 * np.log(times.sum())
    best, chosen = float(times @ np.log(rows[:, order[0]])) / 3, ([int(order[0])], np.ones(1))
    for n in range(2, len(order) + 1):
        if full / 3 - (n - 1) * cost <= best:  # the largest set bounds what any further one can gain
            break
        part, value = (pi[order], full) if n == len(order) else proportions(rows[:, order[:n]], times)
        if value / 3 - (n - 1) * cost > best:
            place = np.argsort(-part, kind="stable")
            best, chosen = value / 3 - (n - 1) * cost, ([int(order[i]) for i in place], part[place])
    return chosen


def _predictor(shared):
    def run(batches):
        model = shared.value
        langs = model.langs
        for batch in batches:
            out = [[], [], []]
            for raw in texts(batch):
                found, part = mixture(raw, model) if raw and _LETTER.search(raw.decode()) else ([], ())
                for column, value in zip(out, ([langs[i] for i in found], [float(x) for x in part], langs[found[0]] if found else "und"), strict=True):
                    column.append(value)
            keep = [batch.column("doc_id"), batch.column("held_out")]
            yield pa.RecordBatch.from_arrays([
                *keep, pa.array(out[2], pa.string()), pa.array([x[0] if x else 0.0 for x in out[1]], pa.float64()),
                pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.list_(pa.float64())),
            ], names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"])

    return run


def identify(docs: DataFrame, held_out: Column, per_language: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), languages, proportions; learned from rows not held out."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out, per_language))  # counts that are not 0, at most BUCKETS a language
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(
        _predictor(model), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"
    )
