"""Convolutional text classifier for toxicity, trained in numpy, with thresholds calibrated by language.

A word's vector is the mean of hashed embeddings of the word and of its letter 4-grams, so unseen forms
of a known stem still speak. Filters of several widths run over the whole text; each filter's largest
answer goes to a logistic output. The weights start from at most ``PER_CLASS`` labelled documents and
``CLASS_BYTES`` bytes of each class, none over a sixteenth of those (a seeded choice; the bounds are parameters).
If there are more, every labelled document is learned from: they are dealt to shards, a network goes on from the start
over each half of a shard, and the weights move by the mean of all. The sums are of whole numbers, so reruns agree.

The output is calibrated by language, which is inferred from a text's words (hashed word likelihoods learned
on all labelled documents): a threshold for each language is taken from the score, so that 0.5 is as likely toxic as
not. It is fitted by cross-fitting: each labelled document is scored by a network that has seen only the other
folds, or the other half of its shard. The threshold of all is drawn to 0 and a language's to that of all (``PRIOR`` documents' worth), so
small samples shift little and every language has a threshold of its own.

A score is a function of the text and the network alone: words' answers are computed word by word in a fixed order and
remembered, sums over a text follow its words, and the score is rounded to nine places.

Null and empty texts are scored as texts without words. Without labelled rows of both classes every
score is 0. Of repeated label rows the largest counts; null labels are left out. Empty input gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIndex, letter_words, materialize, remembered, small, texts
from .langid import sampled

ROWS, DIMS, FILTERS, WIDTHS = 1 << 14, 16, 12, (1, 2, 3)
PER_CLASS, CLASS_BYTES, LANG_BUCKETS, PAD = 2000, 16 << 20, 1 << 12, max(WIDTHS)
FOLDS, PRIOR, EPOCHS, STEPS, BATCH, BATCH_WORDS = 2, 10, 6, 250, 32, 1 << 17
#: Documents and bytes that are learned from at once, and at most how many tasks share them out.
SHARD_DOCS, SHARD_BYTES, TASKS = 2000, 4 << 20, 256
#: Steps of a sum of weights, in which the order of its parts does not matter; values of a row of it; steps of a score's histogram.
FIXED, BLOCK, BINS = 1 << 24, 1 << 13, 64


def _crc_tables() -> list[np.ndarray]:
    """What each of four bytes adds to a crc32, by its distance from the end."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0xEDB88320), first >> 1)
    out = [first]
    for _ in range(3):
        out.append(first[out[-1] & 255] ^ (out[-1] >> 8))
    return out


_CRC = _crc_tables()
_CRC_STATE = np.uint32(zlib.crc32(b"#") ^ 0xFFFFFFFF)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the words, its own and those of its framed 4-grams, and how many each has."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    counts = np.maximum(sizes - 1, 1) + 1
    begins, starts = np.cumsum(sizes + 2) - sizes - 2, np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - np.repeat(starts + 1, counts)  # a gram's place in its word; -1 for the word itself
    where = np.minimum(np.maximum(at, 0) + np.repeat(begins, counts), max(len(raw) - 4, 0))
    short = np.repeat(sizes == 1, counts)  # a framed word of one letter is shorter than a gram
    c = [raw[np.minimum(where + j, len(raw) - 1)] for j in range(4)]
    s = [(_CRC_STATE >> np.uint32(8 * j)) & np.uint32(255) for j in range(4)]
    rows = (~(_CRC[3][c[0] ^ s[0]] ^ _CRC[2][c[1] ^ s[1]] ^ _CRC[1][c[2] ^ s[2]] ^ _CRC[0][c[3] ^ s[3]]) % np.uint32(ROWS)).astype(np.int32)
    rows[starts] = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % ROWS
    for i in np.flatnonzero(short & (at >= 0)):
        rows[i] = zlib.crc32(b"#<" + words[np.searchsorted(starts, i, "right") - 1] + b">") % ROWS
    return rows, counts


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values[order], starts) if len(keys) else values


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins among rows, and the rows of its words; ``PAD`` empty rows follow each text.

    Filters answer from a text's first row to its first empty one, so none sees another text.
    """
    begins = np.cumsum(counts + PAD) - counts - PAD
    return begins, np.arange(counts.sum()) + np.repeat(PAD * np.arange(len(counts)), counts)


def _convolve(x: np.ndarray, filters: list[np.ndarray], biases: list[np.ndarray]) -> list[np.ndarray]:
    n, out = len(x) - PAD, []
    for f, b in zip(filters, biases, strict=True):
        c = x[:n] @ f[0] + b
        for j in range(1, len(f)):
            c += x[j : n + j] @ f[j]
        out.append(c)
    return out


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (ROWS, DIMS)).astype(np.float32)
        self.filters = [rng.normal(0, 0.5 / w, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.bias = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1, np.float32)
        self.langs: list[str] = []
        self.lang_logp = np.zeros((LANG_BUCKETS, 1), np.float32)
        self.thresholds = np.zeros(1)
        self.trained, self.state, self.crossed = False, {}, None

    def vectors(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Vectors of words with ``counts`` embedding rows each, which ``flat`` lists."""
        ends, out = np.cumsum(counts), np.zeros((len(counts), DIMS), self.table.dtype)
        for i in range(0, len(counts), 4096):
            begin, stop = ends[i] - counts[i], ends[min(i + 4096, len(counts)) - 1]
            part = counts[i : i + 4096]
            out[i : i + 4096] = np.add.reduceat(self.table[flat[begin:stop]], np.cumsum(part) - part) / part[:, None].astype(self.table.dtype)
        return out

    def answers(self, x: np.ndarray) -> list[np.ndarray]:
        """What each row of each filter says of each vector, a filter's rows in order.

        Sums are taken one dimension after the other, so that a vector's answers never depend on its neighbours, as
        those of a matrix product may in their last bits.
        """
        wide = np.concatenate([row for f in self.filters for row in f], axis=1)
        out = np.zeros((len(x), wide.shape[1]), x.dtype)
        for i in range(0, len(x), 512):
            for d in range(DIMS):
                out[i : i + 512] += x[i : i + 512, d : d + 1] * wide[d]
        return [np.ascontiguousarray(out[:, k : k + FILTERS]) for k in range(0, wide.shape[1], FILTERS)]

    def pooled_scores(self, answers: list[np.ndarray], at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The output before calibration; ``at`` lists the rows of ``answers`` for each text's words and ``PAD`` empty ones."""
        begins, n, k, z = np.cumsum(counts + PAD) - counts - PAD, len(at) - PAD, 0, np.full(len(counts), self.bias[0], np.float64)
        past = (begins + counts)[:, None] + np.arange(1, PAD)
        for i, (width, b) in enumerate(zip(WIDTHS, self.biases, strict=True)):
            c = np.take(answers[k], at[:n], axis=0) + b
            for j in range(1, width):
                c += np.take(answers[k + j], at[j : n + j], axis=0)
            c[past[past < n]] = -np.inf
            peak = np.maximum(np.maximum.reduceat(c, begins, axis=0), 0)
            for f in range(FILTERS):
                z += peak[:, f] * np.float64(self.out[i * FILTERS + f])
            k += width
        return z

    def raw_scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The output before calibration for texts of ``counts`` words with vectors ``x``."""
        _, places = _segments(counts)
        at = np.full(len(x) + PAD * (len(counts) + 1), len(x))
        at[places] = np.arange(len(x))
        return self.pooled_scores([np.concatenate([a, np.zeros((1, FILTERS), a.dtype)]) for a in self.answers(x)], at, counts)

    def train(self, words: list[np.ndarray], flat: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 5, rate: float = 0.05) -> None:
        """``words``: each text's word numbers; ``flat`` and ``counts``: the words' features. Adagrad on cross-entropy.

        A small sample is seen more often, so that there are ``STEPS`` steps at least.
        """
        rng = np.random.default_rng(seed)
        self.state = {k: np.full(v.shape, 1e-9, np.float32) for k, v in self._weights().items()}
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(words)))):
            self.proceed(words, flat, counts, labels, rng.permutation(len(words)), rate)

    def proceed(self, words: list[np.ndarray], flat: np.ndarray, counts: np.ndarray, labels: np.ndarray, order: np.ndarray, rate: float = 0.05) -> None:
        """One pass over the texts in ``order``. A batch has ``BATCH`` texts, fewer if they have more than ``BATCH_WORDS`` words."""
        offs, weights, state = np.cumsum(counts) - counts, self._weights(), self.state
        if len(order):
            upto = np.cumsum([len(words[i]) for i in order])
            last, edges = 0, [0]
            for i in range(1, len(order)):
                if i - edges[-1] == BATCH or upto[i] - last > BATCH_WORDS:
                    edges.append(i)
                    last = upto[i - 1]
            for begin, stop in zip(edges, [*edges[1:], len(order)], strict=True):
                part = order[begin:stop]
                grads, (rows, g) = self.gradients([words[i] for i in part], labels[part], flat, offs, counts)
                for k, x in grads.items():
                    state[k] += x * x
                    weights[k] -= rate * x / np.sqrt(state[k])
                state["table"][rows] += g * g
                self.table[rows] -= rate * g / np.sqrt(state["table"][rows])

    def _weights(self) -> dict[str, np.ndarray]:
        w = {"table": self.table, "out": self.out, "bias": self.bias}
        return w | {f"f{i}": f for i, f in enumerate(self.filters)} | {f"b{i}": b for i, b in enumerate(self.biases)}

    def gradients(self, texts_, y, flat, offs, counts) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of the mean cross-entropy: for every weight but the table, and for the table's touched rows."""
        n, kind = np.array([len(t) for t in texts_]), self.table.dtype
        used, back = np.unique(np.concatenate(texts_), return_inverse=True)
        c = counts[used]
        own = flat[np.repeat(offs[used] - np.cumsum(c) + c, c) + np.arange(c.sum())]
        v = self.vectors(own, c)
        begins, places = _segments(n)
        x = np.zeros((n.sum() + PAD * (len(n) + 1), DIMS), kind)
        word = np.full(len(x), -1)
        x[places], word[places] = v[back], back
        conv = _convolve(x, self.filters, self.biases)
        top = [np.stack([a + k[a:b].argmax(0) for a, b in zip(begins, begins + n + 1, strict=True)]) for k in conv]
        peak = [np.take_along_axis(k, t, 0) for k, t in zip(conv, top, strict=True)]
        pooled = np.concatenate([np.maximum(p, 0) for p in peak], axis=1)
        dz = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias[0], -30, 30))) - y).astype(kind) / len(y)
        grads = {"out": pooled.T @ dz, "bias": np.array([dz.sum()], kind)}
        at, gradient = [], []  # of the padded rows that a filter's largest answer came from
        for i, (f, t, p) in enumerate(zip(self.filters, top, peak, strict=True)):
            d = dz[:, None] * self.out[i * FILTERS : (i + 1) * FILTERS] * (p > 0)
            grads[f"b{i}"], g = d.sum(0), np.zeros_like(f)
            for j in range(len(f)):
                g[j] = np.einsum("tfd,tf->df", x[t + j], d)
                at.append((t + j).ravel())
                gradient.append((d[:, :, None] * f[j].T[None]).reshape(-1, DIMS))
            grads[f"f{i}"] = g
        at, gradient = word[np.concatenate(at)], np.concatenate(gradient)
        hit, per_word = _summed(at[at >= 0], gradient[at >= 0])
        starts = np.cumsum(c) - c
        cells = own[np.repeat(starts[hit] - np.cumsum(c[hit]) + c[hit], c[hit]) + np.arange(c[hit].sum())]
        return grads, _summed(cells, np.repeat(per_word / c[hit, None].astype(kind), c[hit], axis=0))


def _lang_bucket(word: bytes) -> int:
    return zlib.crc32(word) % LANG_BUCKETS


def learn(rows: list, prior: float) -> Network:
    """``rows``: (text bytes, toxic, lang or None); ``prior``: clean documents for each toxic one, as in all labels."""
    net = Network()
    y = np.array([r[1] for r in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return net
    index: dict[bytes, int] = {}
    words = [np.array([index.setdefault(w, len(index)) for w in letter_words(r[0])], dtype=np.int32) for r in rows]
    if not index:
        return net
    flat, counts = features(list(index))
    net.langs = sorted({r[2] for r in rows if r[2] is not None})
    buckets = np.array([_lang_bucket(w) for w in index], dtype=np.int32)
    del index
    lang_counts = np.full((LANG_BUCKETS, max(1, len(net.langs))), 0.1)
    for r, own in zip(rows, words, strict=True):
        if r[2] is not None:
            lang_counts[:, net.langs.index(r[2])] += np.bincount(buckets[own], minlength=LANG_BUCKETS)
    net.lang_logp = np.log(lang_counts / lang_counts.sum(0)).astype(np.float32)
    lang = np.array([net.lang_logp[buckets[own]].sum(0).argmax() for own in words])
    z, known = cross_scores(words, flat, counts, y)
    weight = np.where(y[known] > 0, 1.0, prior * (y == 1).sum() / (y == 0).sum())
    net.thresholds = calibrated(z[known], y[known], weight, lang[known], net.lang_logp.shape[1])
    net.train(words, flat, counts, y)
    net.trained, net.crossed = True, (z[known], y[known], [own for own, k in zip(words, known, strict=True) if k], buckets)
    return net


def cross_scores(words: list[np.ndarray], flat: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores by networks that have not seen the text, and for which texts there are such."""
    fold, z, known = np.zeros(len(y), int), np.zeros(len(y)), np.zeros(len(y), bool)
    for label in (0, 1):  # each fold has its share of both classes
        at = np.flatnonzero(y == label)
        fold[np.random.default_rng(7 + label).permutation(at)] = np.arange(len(at)) % FOLDS
    for k in range(FOLDS):
        held, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if not len(held) or len(np.unique(y[rest])) < 2:
            continue
        net = Network()
        net.train([words[i] for i in rest], flat, counts, y[rest])
        vectors = net.vectors(flat, counts)
        for part in (held[i : i + 32] for i in range(0, len(held), 32)):
            z[part] = net.raw_scores(vectors[np.concatenate([words[i] for i in part])], np.array([len(words[i]) for i in part]))
        known[held] = True
    return z, known


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray, lang: np.ndarray, langs: int) -> np.ndarray:
    """Each language's threshold: where a logistic curve over the scores, shifted by penalised likelihood, is at 0.5.

    The threshold of all is drawn to 0 and a language's to that of all, each as if by ``PRIOR`` documents at
    even odds.
    """

    def fitted(near: float, rows: np.ndarray) -> float:
        t = near
        for _ in range(200):  # Newton's method with steps of at most 1
            p = 1 / (1 + np.exp(-np.clip(z[rows] - t, -30, 30)))
            step = ((weight[rows] * (y[rows] - p)).sum() + PRIOR / 4 * (t - near)) / ((weight[rows] * p * (1 - p)).sum() + PRIOR / 4)
            t -= max(-1.0, min(1.0, step))
            if abs(step) < 1e-9:
                break
        return t

    whole = fitted(0.0, np.ones(len(z), bool))
    return np.array([fitted(whole, lang == k) for k in range(langs)])


def _index(net: Network, key: int) -> WordIndex:
    """The filters' answers to words and the words' language likelihoods, remembered for one network in each worker.

    The empty word, which stands for the rows that follow a text, has zeros.
    """

    def describe(words: list[bytes]) -> list[np.ndarray]:
        real = np.array([bool(w) for w in words])
        vectors = np.zeros((len(words), DIMS), np.float32)
        known = [w for w in words if w]
        if known:
            vectors[real] = net.vectors(*features(known))
        return [*net.answers(vectors), net.lang_logp[[_lang_bucket(w) for w in words]] * real[:, None]]

    return remembered(("toxicity", key), lambda: WordIndex(describe))


def _scores(net: Network, index: WordIndex, raws: list[bytes]) -> np.ndarray:
    """Each text's score, which does not depend on the texts beside it."""
    if not net.trained or not raws:
        return np.zeros(len(raws))
    words, counts = [], []
    for raw in raws:
        own = letter_words(raw)
        words += own
        words += [b""] * PAD
        counts.append(len(own))
    counts = np.array(counts)
    at = index([*words, *[b""] * PAD])
    z = net.pooled_scores(index.columns[:-1], at, counts)
    begins = np.cumsum(counts + PAD) - counts - PAD
    lang = np.add.reduceat(index.columns[-1][at[:-PAD]].astype(np.float64), begins, axis=0).argmax(1)
    return np.round(1 / (1 + np.exp(-np.clip(z - net.thresholds[lang], -30, 30))), 9)


def _scorer(shared, key: int):
    def run(batches):
        net = shared.value
        index = _index(net, key)
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                score = _scores(net, index, texts(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def _acceptor(shared, key: int):
    """Which texts are not predicted toxic. Only the texts go through Python; other columns stay in Spark."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        index = _index(net, key)
        for column in columns:
            raws = column.cast(pa.binary())
            yield pa.array(np.concatenate([_scores(net, index, [x or b"" for x in raws.slice(i, 64).to_pylist()]) < 0.5 for i in range(0, len(raws), 64)] or [np.zeros(0, bool)]))

    return F.arrow_udf(run, "boolean")


def _numbered(raws: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's word numbers, and the words."""
    index: dict[bytes, int] = {}
    return [np.array([index.setdefault(w, len(index)) for w in letter_words(raw)], dtype=np.int32) for raw in raws], list(index)


def _languages(batches):
    """Words of each language by bucket."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), texts(batch, "raw"), strict=True):
            own = letter_words(raw)
            total = totals.setdefault(lang, np.zeros(LANG_BUCKETS, np.int64))
            total += np.bincount(np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % LANG_BUCKETS, minlength=LANG_BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])


def _learner(shared):
    """Shards of documents, each in two halves: a network goes on from the shared one over each half and scores the other.

    Gives the sum of what the networks' weights moved, times their documents, in fixed steps; the documents behind it; and how many
    documents of a language and label have which score. Documents that the shared network has seen are not scored.
    """

    def run(batches):
        start = shared.value
        begin = _flat(start)
        moved, seen, scored = np.zeros(len(begin), np.int64), 0, {}

        def learn_from(rows):
            nonlocal moved, seen
            words, index = _numbered([r[0] for r in rows])
            if not index:
                return
            (flat, counts), y, half = features(index), np.array([r[1] for r in rows], np.float32), np.array([r[2] for r in rows])
            buckets = np.array([_lang_bucket(w) for w in index], dtype=np.int32)
            for k in range(FOLDS):
                mine = np.flatnonzero(half == k)
                net = copy.deepcopy(start)
                net.proceed(words, flat, counts, y, mine)
                moved += np.round((_flat(net) - begin) * (FIXED * len(mine))).astype(np.int64)
                seen += len(mine)
                vectors = net.vectors(flat, counts)
                for i in (i for i in range(len(rows)) if half[i] != k and not rows[i][3]):
                    z = net.raw_scores(vectors[words[i]], counts=np.array([len(words[i])]))[0]
                    key = (int(start.lang_logp[buckets[words[i]]].sum(0).argmax()), rows[i][1], round(BINS * max(-100.0, min(100.0, float(z)))))
                    scored[key] = scored.get(key, 0) + 1

        held, size, shard = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "toxic", "half", "started")]
            for at, toxic, half, started, raw in zip(*columns, texts(batch, "raw"), strict=True):
                if held and (at != shard or len(held) >= 2 * SHARD_DOCS or size >= 2 * SHARD_BYTES):
                    learn_from(held)
                    held, size = [], 0
                held.append((raw, toxic, half, started))
                size, shard = size + len(raw), at
        if held:
            learn_from(held)
        parts = [(0, i, 0, seen, moved[i : i + BLOCK].astype("<i8").tobytes()) for i in range(0, len(moved), BLOCK)] if seen else []
        parts += [(1 + 2 * lang + toxic, z, 0, n, None) for (lang, toxic, z), n in scored.items()]
        for i in range(0, len(parts), 1024):
            kind, place, _, n, payload = zip(*parts[i : i + 1024], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(n, pa.int64()), pa.array(payload, pa.binary())], names=["kind", "place", "n", "payload"])

    return run


def _summed_blocks(table: pa.Table) -> pa.Table:
    """One block of the sum over all tasks."""
    total = np.sum([np.frombuffer(x, "<i8") for x in table.column("payload").to_pylist()], axis=0, dtype=np.int64)
    return pa.table({"place": table.column("place")[:1], "n": [sum(table.column("n").to_pylist())], "payload": [total.astype("<i8").tobytes()]})


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([w.ravel() for w in net._weights().values()]).astype(np.float64)


def _proceed(net: Network, rows: DataFrame, n_docs: int, n_bytes: int) -> Network:
    """``net`` after all labelled documents: its weights move by the mean of what they move in the shards, thresholds are from all scores."""
    found = rows.filter("lang IS NOT NULL").select("lang", "raw").mapInArrow(_languages, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    net.langs = sorted({r.lang for r in found})
    counted, place = np.full((LANG_BUCKETS, max(1, len(net.langs))), 0.1), {x: i for i, x in enumerate(net.langs)}
    for r in found:
        counted[r.bucket, place[r.lang]] += r.n
    net.lang_logp = np.log(counted / counted.sum(0)).astype(np.float32)
    (z, y, own, buckets), net.crossed = net.crossed, None
    lang = np.array([net.lang_logp[buckets[w]].sum(0).argmax() for w in own], dtype=np.int64)
    shards = max(-(-n_docs // SHARD_DOCS), -(-n_bytes // SHARD_BYTES), 1)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)).cast("int")).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(FOLDS)).cast("int"))
    dealt = dealt.repartitionById(min(shards, TASKS), F.pmod("shard", F.lit(min(shards, TASKS)))).sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id", "bytes", "raw")
    learned = materialize(dealt.select("shard", "toxic", "half", "started", "raw").mapInArrow(_learner(rows.sparkSession.sparkContext.broadcast(net)), "kind int, place int, n long, payload binary"), "toxicity-learned")
    blocks = learned.filter("kind = 0").groupBy("place").applyInArrow(_summed_blocks, "place int, n long, payload binary").collect()  # one network's weights
    moved = _flat(net) * 0
    for r in blocks:
        part = np.frombuffer(r.payload, "<i8")
        moved[r.place : r.place + len(part)] = part / (FIXED * r.n)
    at = 0
    for w in net._weights().values():
        w += moved[at : at + w.size].reshape(w.shape).astype(w.dtype)
        at += w.size
    bins = learned.filter("kind > 0").groupBy("kind", "place").agg(F.sum("n").alias("n")).collect()  # a bounded number for each language
    kind = np.array([r.kind - 1 for r in bins], dtype=np.int64)
    z, y = np.r_[z, [r.place / BINS for r in bins]], np.r_[y, kind % 2]
    weight, lang = np.r_[np.ones(len(lang)), [float(r.n) for r in bins]], np.r_[lang, kind // 2]
    net.thresholds = calibrated(z, y, weight, lang, net.lang_logp.shape[1])
    return net


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Network:
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = materialize(known.filter(allowed), "toxicity-labels")
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = F.broadcast(sampled(known, "toxic", per_class))  # about 2 * per_class rows
    texts_ = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"), "lang").withColumn("bytes", F.length("raw"))
    rows = texts_.join(chosen, "doc_id").filter(F.col("bytes") <= class_bytes // 16)
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "bytes", "raw").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("bytes").over(order)).filter(F.col("upto") <= class_bytes)  # of the sample only
    sample = sorted(rows.select("raw", "toxic", "lang", "doc_id").collect(), key=lambda r: (r[3], bytes(r[0])))
    net = learn([(bytes(r[0]), r[1], r[2]) for r in sample], max(1.0, n.get(0, 0) / max(1, n.get(1, 0))))
    every = texts_.join(small(known), "doc_id")
    total = every.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if net.trained and total.n > len(sample):  # else all are learned from
        started = docs.sparkSession.createDataFrame([(i,) for i in sorted({r[3] for r in sample})], f"doc_id {dict(known.dtypes)['doc_id']}").withColumn("started", F.lit(True))
        every = every.join(F.broadcast(started), "doc_id", "left").withColumn("started", F.coalesce("started", F.lit(False)))
        net = _proceed(net, every, total.n, total.bytes)
    net.crossed, net.state = None, {}
    return net


def score(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labelled rows that are not held out.

    ``held_out`` is an expression of doc_id, which both tables have.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held_out, per_class))
    rows = docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    scored = rows.mapInArrow(_scorer(net, net._jbroadcast.id()), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not predicted toxic, columns unchanged."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, F.lit(True), per_class))
    return docs.filter(_acceptor(net, net._jbroadcast.id())(F.col("text")))
