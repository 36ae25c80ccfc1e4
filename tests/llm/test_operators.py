"""Each training-data operator on small inputs: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from closebook.llm import bitpack, decontam, htmltext, langid, mixing, neardup, quality, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, label int"


def docs(spark, texts, langs=None, sources=None, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["a"] * len(texts))[k], 0, "x", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Bit packing.


@pytest.mark.parametrize("width", [1, 3, 7, 8, 11, 16, 17, 24, 31, 32])
def test_pack_round_trip_and_random_access(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003, dtype=np.uint64)
    for n in (0, 1, 7, 8, 9, 1003):
        payload = bitpack.pack(ids[:n], width)
        assert len(payload) == -(-n // 8) * width
        assert (bitpack.unpack(payload, width, 0, n) == ids[:n]).all()
    assert (bitpack.unpack(bitpack.pack(ids, width), width, 13, 777) == ids[13:777]).all()


ODD = ["", None, "It's <|endoftext|> x", "<|ENDOFTEXT|>. <|", "x.. y!? (z) a.b, c.\n\nqux! é, ß; “q”. a—.", "a\x1cb c\xa0d.", "long " * 30_000, "same", "same", "ΑΣ İI ſ 'LL it'S?"]


def test_tokens_equal_the_tokenizer_and_read_back(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bitpack.default_vocabulary())
    path = bitpack.write_tokens(docs(spark, ODD, ids=[9, 8, 7, 6, 5, 4, 3, 2, 2, 1]), block_ids=50)
    got = bitpack.read_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    start = 0
    for r in got:
        want = [*tokenizer.encode(ODD[9 - r.doc_id if r.doc_id > 2 else 7 if r.doc_id == 2 else 9] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert bitpack.read_document(spark, path, 7)[0].tolist()[-1] == 2 and len(bitpack.read_document(spark, path, 2)) == 2
    assert bitpack.read_digests(spark, bitpack.write_tokens(docs(spark, ["a"]).limit(0))).count() == 0


# Near-duplicates.


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [len(s) for s in sets], label


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "One two", "one TWO", "a b c d e", " \n "]
    for n in (8, 60, 150, 700):
        base = words(rng, n, 5000).split()
        for _ in range(14):  # a family of edits about the threshold
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                copy[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    passage = words(rng, 60, 5000)
    texts += [f"{words(rng, 90, 9000)} {passage} {words(rng, 30, 9000)}" for _ in range(25)]
    sizes, label = brute_components(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == label
    assert all(got[i].kept == (label[i] == i) for i in range(len(texts)))


def test_near_duplicate_odd_rows(spark):
    table = docs(spark, ["a b c d e f", "a b c d e f", "z", None], ids=[3, 3, None, 5])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table).filter("doc_id is not null").collect()) == [(3, 3, True), (3, 3, True), (5, 5, True)]
    left = neardup.deduplicate(table)
    assert left.columns == table.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "5", "None"]
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_block_pairs_split_large_lists(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(9)
    base = words(rng, 150, 5000).split()
    texts = []
    for _ in range(24):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(24)] == brute_components(texts)[1]


def test_pairs_that_join_nothing_new_are_left_out():
    rng = np.random.default_rng(8)
    for _ in range(60):
        la, lb = rng.integers(0, 9, 12), rng.integers(0, 9, 10)
        good = (rng.random((12, 10)) < 0.25) & (la[:, None] != lb[None, :])
        sure = good & (rng.random(good.shape) < 0.5)
        i, j = neardup._needed(good, sure, la, lb)
        assert good[i, j].all()

        def joined(pairs):
            label = {x: x for x in range(9)}
            for a, b in pairs:
                old, new = label[la[a]], label[lb[b]]
                label = {k: new if v == old else v for k, v in label.items()}
            return sorted(sorted(k for k in label if label[k] == v) for v in set(label.values()))

        assert joined(zip(i, j, strict=True)) == joined(zip(*np.nonzero(good), strict=True))
        forest = sure[i, j]
        assert joined(zip(i[forest], j[forest], strict=True)) == joined(zip(*np.nonzero(sure), strict=True)) and forest.sum() <= 8


def test_least_shared_values_follow_the_threshold(spark):
    assert [neardup.shared_least(p) for p in (100, 85)] == [64, 36]
    rng = random.Random(12)
    texts, pairs = [], 60
    for _ in range(pairs):  # one contained in another of twice its size: similarity over 0.5
        base = words(rng, 400, 10**6).split()
        texts += [" ".join(base), " ".join(base[:204])]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, texts), percent=50).collect()}
    assert [got[2 * i + 1] for i in range(pairs)] == [2 * i for i in range(pairs)]


def test_pipeline_links_similarities_of_80_percent(spark):
    import corpus_pipeline

    base, far = [f"w{i}" for i in range(104)], [f"x{i}" for i in range(104)]
    texts = [" ".join(x) for x in (base, base[:86], far, far[:82])]  # 82 and 78 of 100 shingles
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "").collect())
    assert kept == [0, 2, 3]


# Decontamination.


def brute_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        q = cut(t)
        n = min(window, len(q))
        wins = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if q else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(2)
    items = [(i, words(rng, n, 60)) for i, n in enumerate((30, 12, 10, 4, 25))] + [(100, "Été über"), (101, ""), (102, None), (103, "?!")]
    texts = [None, "", "?!", "l'ÉTÉ Été  ÜBER été-über x", items[0][1].upper().replace(" ", ", "), f"{words(rng, 20)} {items[1][1]} {items[2][1]}", words(rng, 500, 60), items[0][1][:-1]] + [f"{words(rng, 50, 60)} {items[4][1]}"] * 2
    table, bench = docs(spark, texts), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(table, bench).collect()}
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert got == want
    clean = decontam.remove(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[4]}


def test_decontamination_spans_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = decontam.decontaminate(docs(spark, ["Say: ALPHA, beta -- Gamma!"]), bench)
    place = docs(spark, ["Say: ALPHA, beta -- Gamma!"]).join(found, "doc_id").select(decontam.spans("text", "begins", "ends").alias("s")).first().s
    assert [(x.begin, x.end) for x in place] == [(5, 25)]
    assert decontam.report(docs(spark, ["a"]), bench.limit(0)).first().contaminated is False
    assert decontam.report(docs(spark, ["a"]).limit(0), bench).count() == 0


def test_long_texts_are_read_whole(spark):
    """What stands at the very end of a long text counts like anything else."""
    rng = random.Random(19)
    item = words(rng, 14, 9000)
    long = words(rng, 150_000, 9000)
    table = docs(spark, [f"{long} {item}", f"{long} {item} {item}", long])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.report(table, bench).collect()}
    assert got == {0: (150_014, 14), 1: (150_028, 28), 2: (150_000, 0)}
    assert {r.component_id for r in neardup.near_duplicates(table).collect()} == {0}
    assert {r.doc_id: r.size for r in mixing.mix(table).collect()} == {0: 150_014, 1: 150_028, 2: 150_000}


# Exact search.


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 64)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(301)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(30)] + [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (100, [0.0] * 8)]
    table = spark.createDataFrame([(*v, 7) for v in vectors], "vec_id long, embedding array<float>, score int")
    ints = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    got = {}
    for r in topk.search(table, k=10, every=100).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    queries = {}
    for qid, q in ints:
        if qid % 100 == 0 and (qid not in queries or list(q) < list(queries[qid])):
            queries[qid] = q  # of rows with one id the first in order asks
    assert set(got) == set(queries) and 100 in queries
    for qid, q in queries.items():
        want = sorted(((-int(q @ v), i) for i, v in ints if i != qid))[:10]
        assert [got[qid][k + 1] for k in range(10)] == [(-s, i) for s, i in want]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(few).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.search(few.limit(0)).count() == 0


def test_topk_odd_vectors(spark, monkeypatch):
    """Unequal lengths, weights beyond 32 and scores beyond 64 bits, blocks cut by bytes."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64)
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0, 5.0]), (3, []), (4, [1e30, 0.0]), (5, [-1e30, 0.0]), (6, [1e300, 0.0]), (7, [3e6, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.search(table).orderBy("rank").collect()]
    most = 2**63 - 1
    want = [(4, most), (6, most), (7, 3_000_000 * 1024 * 1024), (2, 5 * 1024**2), (1, 1024**2), (3, 0), (5, -most - 1)]
    assert got == want


# Mixing.


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    sources = [random.Random(i).choice(["a", "b", "c", None]) if i % 3 else "hot" for i in range(400)]
    texts = [words(rng, rng.randrange(0, 60)) if i % 17 else None for i in range(400)]
    rows = mixing.mix(docs(spark, texts, sources=sources)).collect()
    assert rows == mixing.mix(docs(spark, texts, sources=sources)).collect() or sorted(rows, key=str) == sorted(mixing.mix(docs(spark, texts, sources=sources)).collect(), key=str)
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in set(sources)}
    taken, target = Counter(), {}
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == size[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        target[s] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    weights = dict(zip(["a", "b", "c", "hot", None], [3, 1, 2, 3, 1], strict=True))
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) < 1
    level = [target[s] / weights[s] for s in target if target[s] < 2 * size[s] - 1e-6]
    assert max(level) - min(level) < 1e-6
    assert all(target[s] / weights[s] <= min(level) + 1e-6 for s in target)


def test_mix_odd_rows(spark):
    table = docs(spark, ["a b", "a b", None, ""], ids=[1, 1, None, 4], sources=["s", "s", None, None])
    assert sorted((r.size, r.taken) for r in mixing.mix(table).collect()) == [(0, 0), (0, 0), (2, 2), (2, 4)]
    assert mixing.mix(table.limit(0)).count() == 0
    again = mixing.repeat(table)
    assert again.columns == table.columns and again.filter("text = 'a b'").count() == 3
    clash = table.withColumns({c: F.lit(c) for c in ("target", "whole", "extra", "n_docs", "left", "mix_key", "mix_row", "p_source", "col")})
    again = mixing.repeat(clash)
    assert again.columns == clash.columns and again.filter("target = 'target' AND text = 'a b'").count() == 3


def test_mix_spreads_rows_that_share_an_id(spark):
    table = docs(spark, [f"a b {i}" for i in range(400)], ids=[None] * 400, sources=["s"] * 200 + ["t"] * 200)
    sizes = mixing._keyed(table, 17)
    assert sizes.select("mix_key").distinct().count() == 400
    assert mixing.mix(table).agg(F.sum("taken")).first()[0] == 1800


# Classifiers.


def corpus(rng, lang, n, bad=()):
    syllables = {"en": "th er on an re he in ed nd ha", "de": "en er ch ei un ge sch te in be", "fr": "le de eau ou re en tion oi ai que"}[lang].split()
    made = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for b in bad:
        made[rng.randrange(n)] = b
    return " ".join(made)


def test_language_mixtures(spark):
    rng = random.Random(1)
    langs = [("en", "de", "fr")[i % 3] for i in range(300)]
    texts = [corpus(rng, x, rng.randrange(5, 200)) for x in langs]
    texts += [None, "", "123 !?", "é", corpus(rng, "en", 300) + " " + corpus(rng, "fr", 100)]
    table = docs(spark, texts, langs + [None] * 5)
    got = {r.doc_id: r for r in langid.identify(table, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(got[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[300].score == 0
    mixed = got[304]
    assert mixed.languages == ["en", "fr"] and mixed.lang_pred == "en" and 0.6 < mixed.score < 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(table.limit(0), F.lit(False)).count() == 0
    assert langid.identify(docs(spark, ["abc"], [None]), F.lit(False)).first().lang_pred == "und"


def test_mixture_equals_plain_expectation_maximisation():
    """Proportions by EM written out, and the language set that the penalised likelihood picks among all nested ones."""
    rng = np.random.default_rng(6)
    langs, buckets = ["a", "b", "c"], np.arange(300)
    n = rng.integers(0, 200, (3, 300)) * (rng.random((3, 300)) < 0.4)
    at = np.nonzero(n)
    model = langid.Model(langs, at[0], at[1], n[at])
    p = (n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * langid.BUCKETS)
    for trial in range(20):
        share = rng.dirichlet([0.4] * 3)
        drawn = rng.choice(300, 400, p=(share @ (n / n.sum(1, keepdims=True))))
        found, times = np.unique(drawn, return_counts=True)
        rows = (p / p.max(0))[:, found].T

        def plain(columns):
            pi = [1 / len(columns)] * len(columns)
            for _ in range(30):
                new = [0.0] * len(columns)
                for row, t in zip(rows.tolist(), times.tolist(), strict=True):
                    whole = sum(q * row[c] for q, c in zip(pi, columns, strict=True))
                    for k, c in enumerate(columns):
                        new[k] += t * pi[k] * row[c] / whole
                new = [x / times.sum() for x in new]
                done, pi = max(abs(x - y) for x, y in zip(new, pi, strict=True)) < 1e-3, new
                if done:
                    break
            pi = [x / sum(pi) for x in pi]
            return pi, sum(t * np.log(sum(q * row[c] for q, c in zip(pi, columns, strict=True))) for row, t in zip(rows.tolist(), times.tolist(), strict=True))

        assert np.allclose(model.rows(found), rows)
        pi, _ = langid.proportions(model.rows(found), times)
        assert np.allclose(pi, plain([0, 1, 2])[0])
        order = sorted(range(3), key=lambda c: -pi[c])
        value = {k: plain(order[:k])[1] / 3 - (k - 1) * 0.5 * np.log(400) for k in (1, 2, 3)}
        best = max(value, key=lambda k: (value[k], -k))
        chosen, parts = _mixture_of(drawn, model)
        assert sorted(chosen) == sorted(order[:best]) and np.allclose(sorted(parts), sorted(plain(order[:best])[0]))


def _mixture_of(drawn, model):
    """``mixture`` for given trigram buckets."""
    kept = langid.grams
    langid.grams = lambda raw: drawn
    try:
        return langid.mixture(b"x", model)
    finally:
        langid.grams = kept


def test_language_of_long_and_repeated_texts(spark):
    rng = random.Random(16)
    texts = [corpus(rng, x, 80) for x in ("en", "de", "fr") * 20] + ["Straße über " * 40_000, "a" * 500_000]
    langs = ["en", "de", "fr"] * 20 + [None, None]
    table = docs(spark, texts + texts[:4], langs + [None] * 4, ids=[*range(62), *range(4)])
    rows = langid.identify(table, F.lit(False)).collect()
    assert len(rows) == 66
    for i in range(4):
        assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == i}) == 1
    tie = langid.Model(["a", "b"], np.array([0, 1]), np.array([5, 5]), np.array([9, 9]))
    kept = langid.proportions(tie.rows(np.array([5, 7])), np.array([3, 1]))[0]
    assert kept[0] == kept[1] and _mixture_of(np.array([5, 5, 7]), tie)[0] == [0]


def test_every_language_is_learned(spark):
    rng = random.Random(14)
    names = [f"l{i:02}" for i in range(80)]
    syllables = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(5)] for x in names}
    langs = [x for x in names for _ in range(6)]
    texts = [" ".join(rng.choice(syllables[x]) for _ in range(40)) for x in langs]
    held = F.col("doc_id") % 6 == 5
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, texts, langs), held).collect()}
    assert [got[i] for i in range(len(langs))] == langs


def test_toxicity_learns_stems(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        texts.append(corpus(rng, ("en", "de")[i % 2], rng.randrange(20, 120), [f"zork{rng.choice(['ing', 'ed', 'er', 'ly'])}"] * 2 if toxic else ()))
        labels.append((i, 1, int(toxic), "x"))
    texts += [None, ""]
    table = docs(spark, texts, [("en", "de")[i % 2] for i in range(502)])
    marks = spark.createDataFrame(labels + [labels[0], (7, 0, None, "x"), (None, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = {r.doc_id: r for r in toxicity.score(table, marks, held).collect()}
    out = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][2] for i in out) >= 0.93 * len(out)
    assert got[500].score == got[501].score and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    left = toxicity.reject(table, marks)
    assert left.columns == table.columns and left.filter("doc_id % 5 <> 0").count() >= 0.95 * 401
    assert toxicity.score(table, marks.limit(0), held).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(table.limit(0), marks, held).count() == 0


def test_toxicity_network_equals_plain_convolution_and_its_gradients():
    net = toxicity.Network(3)
    for k, w in net._weights().items():
        setattr(net, k, w.astype(float)) if k in ("table", "out", "bias") else None
    net.filters, net.biases = [f.astype(float) for f in net.filters], [b + 0.05 for b in map(np.float64, net.biases)]
    flat, counts = toxicity.features([b"alpha", b"beta", b"gamma", b"of", b"\xc3\xa9t\xc3\xa9"])
    assert counts.tolist() == [1 + 4, 1 + 3, 1 + 4, 1 + 1, 1 + 4]
    texts = [np.array(t, dtype=np.int64) for t in ([0, 1, 2, 3, 4, 1], [2], [], [4, 4])]
    y, offs = np.array([1.0, 0.0, 1.0, 0.0]), np.cumsum(counts) - counts

    def plain(words):
        """Every filter at every place of the padded text, the largest answer of each, a weighted sum."""
        rows = [np.mean([net.table[i] for i in flat[offs[w] : offs[w] + counts[w]]], axis=0) for w in words]
        rows += [np.zeros(toxicity.DIMS)] * toxicity.PAD
        out = []
        for f, b in zip(net.filters, net.biases, strict=True):
            padded = rows + [np.zeros(toxicity.DIMS)] * toxicity.PAD
            for k in range(toxicity.FILTERS):
                out.append(max(0.0, *(sum(padded[i + j] @ f[j][:, k] for j in range(len(f))) + b[k] for i in range(len(rows)))))
        return np.dot(out, net.out) + net.bias[0]

    vectors = net.vectors(flat, counts)
    z = net.raw_scores(vectors[np.concatenate(texts)], np.array([len(t) for t in texts]))
    assert np.allclose(z, [plain(t) for t in texts], atol=1e-5)
    loss = lambda: float(np.mean([np.log1p(np.exp(-(2 * a - 1) * plain(t))) for a, t in zip(y, texts, strict=True)]))
    grads, (rows, g) = net.gradients(texts, y, flat, offs, counts)
    rng = np.random.default_rng(0)
    for weights, gradient in [(w, grads[k]) for k, w in net._weights().items() if k != "table"] + [(net.table, (rows, g))]:
        for _ in range(6):
            if isinstance(gradient, tuple):
                i = rng.integers(len(rows))
                at, want = (rows[i], rng.integers(toxicity.DIMS)), None
                want = gradient[1][i][at[1]]
            else:
                at = tuple(rng.integers(n) for n in weights.shape)
                want = gradient[at]
            kept, step = weights[at], 1e-5
            weights[at] = kept + step
            up = loss()
            weights[at] = kept - step
            down = loss()
            weights[at] = kept
            assert abs((up - down) / (2 * step) - want) < 1e-5


def test_toxicity_thresholds_are_drawn_together():
    rng = np.random.default_rng(2)
    lang, y = rng.integers(0, 3, 900), (rng.random(900) < 0.3).astype(float)
    z = rng.normal(0, 1, 900) + 6 * y - 3 + np.array([0.0, 2.0, -1.0])[lang]
    lang[:3], few = 3, toxicity.calibrated(z, y, np.ones(900), lang, 4)
    assert few[1] > few[0] + 1 and few[2] < few[0] - 0.3 and abs(few[3] - few[:3].mean()) < 1.5
    assert np.abs(toxicity.calibrated(z[:4], y[:4], np.ones(4), lang[:4], 4)).max() < 1.5


def test_toxicity_bounds_its_sample_and_takes_odd_rows(spark):
    rng = random.Random(15)
    texts = [corpus(rng, "en", 30, ["zorking"] * 2 if i % 2 else ()) for i in range(60)]
    texts[0] = "zorking " * 60_000  # longer than any text that is learned from
    table = docs(spark, texts + texts[:5], ids=[*range(60), *range(5)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, toxic int")
    net = toxicity.fit(table, marks, F.lit(True), class_bytes=8000)
    assert net.trained
    again = [r.score for r in toxicity.score(table, marks, F.lit(False)).orderBy("doc_id").collect()]
    assert len(again) == 65 and all(again[2 * i] == again[2 * i + 1] for i in range(5))


def test_toxicity_scores_do_not_depend_on_the_batch():
    rng = random.Random(16)
    rows = [(corpus(rng, ("en", "de")[i % 2], rng.randrange(5, 60), ["zorking"] * 2 if i % 3 == 0 else ()).encode(), int(i % 3 == 0), ("en", "de")[i % 2]) for i in range(120)]
    net = toxicity.learn(rows, 2.0)
    texts = [r[0] for r in rows] + [b"", "\u00e9 x".encode(), rows[0][0] * 50]
    alone = [toxicity._scores(net, toxicity._index(net, ("alone", i)), [t])[0] for i, t in enumerate(texts)]
    for k in range(20):
        order = rng.sample(range(len(texts)), len(texts))
        index, step = toxicity._index(net, ("batch", k)), rng.choice([1, 3, 17, 64, 200])
        got = [s for i in range(0, len(order), step) for s in toxicity._scores(net, index, [texts[j] for j in order[i : i + step]])]
        assert got == [alone[j] for j in order]


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(6)
    texts, sources, labels = [], [], []
    for i in range(600):
        site = "big" if i % 3 else ("junk" if i % 2 else "small")
        good = site != "junk" if i % 20 else site == "junk"
        t = corpus(rng, "en", 60)
        texts.append(t if good else " ".join(w + "***" for w in t.split()))
        sources.append(site)
        if i < 450:
            labels.append((i, int(good), 0))
    texts += [None, "", corpus(rng, "en", 60)]
    sources += ["big", None, "new"]
    table = docs(spark, texts, sources=sources)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(table, marks, F.lit(True), F.col("source"), F.col("lang")).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].keep == ("***" not in texts[i]) for i in range(450, 600)) >= 145
    rate = {sources[i]: got[i].path_rate for i in range(603)}
    assert rate["junk"] < rate["new"] and rate["junk"] < rate["big"]
    assert quality.classify(table.limit(0), marks, F.lit(True), F.col("source"), F.col("lang")).count() == 0
    assert quality.classify(table, marks.limit(0), F.lit(True), F.col("source"), F.col("lang")).first().score == 0.5


def _plain_quality(table, marks, rows):
    """The same classifier in plain Python; Spark only hashes."""
    import math
    from statistics import fmean

    import regex

    hashes = {}
    for r in table.select("doc_id", F.transform(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(quality.BUCKETS))).alias("b"),
                          F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("h")).collect():
        hashes[r.doc_id] = (sorted(set(r.b)), r.h)
    known = {}
    for i, q, _ in marks:
        if i is not None and q is not None:
            known[i] = max(known.get(i, 0), q)
    count = lambda p, t: len(regex.findall(p, t))
    step = lambda x, w: min(math.floor(x / w), 40)

    def bins(t, i):
        words, lines = [w for w in regex.split(r"\s+", t.lower()) if w], [x for x in t.split("\n") if x]
        n, length = max(1, len(words)), float(max(1, len(t)))
        own, half = hashes[i]
        ratios = []
        good = [g for j, g in known.items() if j in hashes and hashes[j][1] != half]
        for b in own:
            with_b = [g for j, g in known.items() if j in hashes and hashes[j][1] != half and b in hashes[j][0]]
            ratios.append(math.log((sum(with_b) + 1) / (sum(good) + 2) * (len(good) - sum(good) + 2) / (len(with_b) - sum(with_b) + 1)) if with_b else 0.0)
        return (
            step(count(r"[^\p{L}\p{N}\s]", t) / n, 0.1), step(count(r"[^\p{L}\p{N}\s]{2,}", t) / n, 0.05), step(count(r"\p{N}", t) / length, 0.02), step(count(r"\p{Lu}", t) / n, 0.05),
            step(length / n, 0.5), math.floor(math.log2(n)), step(len(set(words)) / n, 0.05), step(len(set(lines)) / max(1, len(lines)), 0.1),
            max(-100, min(100, math.floor(sum(ratios) / max(1, len(own)) / 0.02))),
        )

    binned = {i: bins(t or "", i) for i, t, _, _ in rows}
    total = [known[i] for i in binned if i in known]
    n, good = len(total), sum(total)
    rate = (good + 1) / (n + 2)
    evidence = dict.fromkeys(binned, 0.0)
    for k in range(9):
        cells = {}
        for i, b in binned.items():
            if i in known:
                cells.setdefault(b[k], []).append(known[i])
        width = len(cells) + 1
        for i, b in binned.items():
            c = cells.get(b[k])
            if c:
                evidence[i] += quality.TEMPER * math.log((sum(c) + 1) / (good + width) / ((len(c) - sum(c) + 1) / (n - good + width)))
    logit, sigmoid = lambda p: math.log(p / (1 - p)), lambda x: 1 / (1 + math.exp(-x))
    p = {i: float(known[i]) if i in known else sigmoid(evidence[i] + logit(rate)) for i in binned}
    sites = {}
    for i, _, h, path in rows:
        sites.setdefault(h, {}).setdefault(path, []).append(p[i])
    overall = fmean(p.values())

    def weight(groups):
        """``groups``: (n, sum, mean it is held against)."""
        ss, k = sum(m * (g / m - mean) ** 2 for m, g, mean in groups), len(groups)
        m, nn, within = sum(x[0] for x in groups), sum(x[0] ** 2 for x in groups), fmean(x[2] * (1 - x[2]) for x in groups)
        return min(max(within / max((ss - (k - 1) * within) / max(m - nn / m, 1.0), 1e-6) - 1, 1.0), 1e6)

    whole = {h: [x for own in paths.values() for x in own] for h, paths in sites.items()}
    w = weight([(len(x), sum(x), overall) for x in whole.values()])
    host = {h: (sum(x) + w * overall) / (len(x) + w) for h, x in whole.items()}
    w = weight([(len(x), sum(x), host[h]) for h, paths in sites.items() for x in paths.values()])
    path = {(h, q): (sum(x) + w * host[h]) / (len(x) + w) for h, paths in sites.items() for q, x in paths.items()}
    return {i: (evidence[i], host[h], path[h, q], sigmoid(evidence[i] + logit(min(max(path[h, q], 1e-6), 1 - 1e-6)))) for i, _, h, q in rows}


def test_quality_equals_plain_counting(spark):
    rng = random.Random(41)
    vocabulary = {1: "calm river stone field letter garden window".split(), 0: "click win offer bonus !!! $$$ 100% free".split()}
    rows, marks = [], []
    for i in range(140):
        good, h = int(rng.random() < 0.6), rng.choice(["a", "b", "c", None])
        text = " ".join(rng.choice(vocabulary[good if rng.random() < 0.8 else 1 - good]) for _ in range(rng.randrange(1, 40))) + rng.choice(["", "\nfooter\nfooter", " ÉTÉ 12"])
        rows.append((i, text, h, rng.choice(["en", "de", None])))
        if i % 3:
            marks.append((i, good, 0))
    rows += [(140, None, "d", "en"), (141, "", None, None), (142, "offer " * 20_000, "a", "en")]
    marks += [marks[0], (None, 1, 0), (5, None, 0)]
    table = docs(spark, [r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.doc_evidence, r.host_rate, r.path_rate, r.score) for r in quality.classify(table, labels, F.lit(True), F.col("source"), F.col("lang")).collect()}
    want = _plain_quality(table, marks, rows)
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert np.allclose(got[i], x, atol=1e-9), (i, got[i], x)


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A{n}</a></li></ul></nav><div class="cookie-notice">We use cookies {n}</div>
<div class="ad">Buy {n}</div><div id=sidebar>Side {n}</div><article><h1>Title {n}</h1><p><b>Bold{n}.<br><p>First &amp; second&nbsp;{n} a<b>b</b>c</p>
<p>Follow us for more</p><form>Name <input></form><ul><li>item {n}</li><li>more {m}</li></ul></article>
<section class="comments"><p>Nice {n}</p></section><footer>&copy; {n}</footer></body></html>"""


def test_wrappers_keep_content_and_drop_template(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(n=i, m=i * i), "x") for i in range(8)]
    pages += [(8, "http://lone.example/", PAGE.format(n=50, m=51), "x"), (9, None, None, "x"), (10, "nohost", "", "x"), (11, "http://x.example", "<p>Just text", "x")]
    table = spark.createDataFrame(pages + [pages[0]], "page_id long, url string, html string, host string")
    got = htmltext.main_text(table).collect()
    assert len(got) == 13
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Title 3 Bold3. First & second 3 abc item 3 more 9"  # the constant line is template
    assert text[8] == "Title 50 Bold50. First & second 50 abc Follow us for more item 50 more 51"
    assert (text[9], text[10], text[11]) == ("", "", "Just text")
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.main_text(table.limit(0)).count() == 0


def _pages(spark, host, bodies):
    return spark.createDataFrame([(i, f"http://{host}/{i}", f"<article>{''.join(f'<p>{x}</p>' for x in b)}</article>") for i, b in enumerate(bodies)], "page_id long, url string, html string")


def test_constants_are_counted_over_all_pages(spark):
    """A paragraph that is equal on the sampled pages is kept where it differs, and on those pages if few have it."""
    rng = random.Random(8)
    body = lambda i: [f"{words(rng, 9)} {i}", f"{words(rng, 12)} {i}"]
    chosen = {r.page_id for r in spark.range(200).select(F.col("id").alias("page_id"), F.xxhash64("id", F.lit(3)).alias("d")).orderBy("d").limit(htmltext.PER_HOST).collect()}
    bodies = [[("same lead" if i in chosen else f"lead {i}"), *body(i), "Follow us"] for i in range(200)]
    got = {r.page_id: r.text for r in htmltext.main_text(_pages(spark, "h.example", bodies)).collect()}
    assert all(got[i] == " ".join(b[:3]) for i, b in enumerate(bodies))


def test_links_between_paragraphs_are_the_articles_own(spark):
    """Lists and tables of links stay where paragraphs stand before and after them, and go at the ends."""
    links = lambda i, of: "".join(of.format(f'<a href="/{i}/{k}">source {i} {k}</a>') for k in range(4))
    page = "<ul>{}</ul><article><ul>{}</ul><p>first {n} words</p><ul>{}</ul><p>second {n} words</p><table>{}</table><p>third {n} words</p><ul>{}</ul></article>"
    item, row = "<li>{}</li>", "<tr><td>{}</td></tr>"
    made = [page.format(links(f"a{i}", item), links(f"b{i}", item), links(f"c{i}", item), links(f"d{i}", row), links(f"e{i}", item), n=i) for i in range(9)]
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame([(i, f"http://r.example/{i}", x) for i, x in enumerate(made)], "page_id long, url string, html string")).collect()}
    named = lambda k, i: " ".join(f"source {k}{i} {j}" for j in range(4))
    assert all(got[i] == f"first {i} words {named('c', i)} second {i} words {named('d', i)} third {i} words" for i in range(9))


def test_near_copies_of_one_article_keep_their_text(spark):
    base = [words(random.Random(k), 10 + k) for k in range(5)]
    bodies = [[f"changed {i} {i * i}" if k == i % 5 else x for k, x in enumerate(base)] for i in (2, 7, 12, 17, 22, 27)]
    got = {r.page_id: r.text for r in htmltext.main_text(_pages(spark, "n.example", bodies)).collect()}
    assert all(got[i] == " ".join(b) for i, b in enumerate(bodies))


def _most(a, b):
    """Simple tree matching by trying everything."""
    if not a or not b:
        return 0
    (x, *more_a), (y, *more_b) = a, b
    best = max(_most(more_a, b), _most(a, more_b))
    return max(best, 1 + _most(x.kids, y.kids) + _most(more_a, more_b)) if x.label == y.label else best


def _random_tree(rng, depth=3):
    return "".join(f"<{t}>{_random_tree(rng, depth - 1) if depth else ''}</{t}>" for t in (rng.choice(["div", "section", "main"]) for _ in range(rng.randrange(0, 4))))


def test_simple_tree_matching_is_largest(monkeypatch):
    monkeypatch.setattr(htmltext, "CELLS", 2)  # always in halves
    rng = random.Random(21)
    for _ in range(150):
        a, b = htmltext.parse(_random_tree(rng)), htmltext.parse(_random_tree(rng))
        pairs = htmltext.aligned(a, b)
        assert len(pairs) == 1 + _most(a.kids, b.kids)
        place_a, place_b = ({id(n): i for i, n in enumerate(htmltext.below(t))} for t in (a, b))
        up = {id(k): n for t in (a, b) for n in htmltext.below(t) for k in n.kids}
        met = {id(x): y for x, y in pairs}
        assert all(x.label == y.label and (x is a or met[id(up[id(x)])] is up[id(y)]) for x, y in pairs)
        order = sorted(pairs, key=lambda p: place_a[id(p[0])])
        for (x, y), (v, w) in zip(order, order[1:], strict=False):
            assert up.get(id(x)) is not up.get(id(v)) or place_b[id(y)] < place_b[id(w)]


def test_wrappers_survive_storage_and_size():
    rng = random.Random(22)
    for _ in range(20):
        wrapper = htmltext.as_wrapper(htmltext.parse(_random_tree(rng)))
        stored = htmltext.unpacked(htmltext.packed(wrapper))
        assert [(n.label, len(n.kids)) for n in htmltext.below(stored)] == [(n.label, len(n.kids)) for n in htmltext.below(wrapper)]
    assert htmltext.extract("<div>" * 5000 + "x", None) == "x"
    long = [f"<article>{''.join(f'<p>{i}</p>' if i % k else f'<h2>{i}</h2>' for i in range(6000))}</article>" for k in (5, 7)]
    assert len(htmltext.extract(long[0], htmltext.unpacked(htmltext.packed(htmltext.induce(long)))).split()) == 6000


@pytest.mark.parametrize("around", ['<article class="post no-comments">', '<article class="story share-enabled">', '<article class="post-header-image">', '<div class="layout with-sidebar">', '<div id="content" class="search-results">', '<main class="page no-sidebar">', '<div class="widget">'])
def test_names_do_not_take_the_article(around):
    tag = around[1:].split()[0]
    page = f'<nav>Menu</nav>{around}<p class="share-price">First real paragraph.</p><p>Second one.</p><div class="related-posts"><p>See</p></div></{tag}><div class="cookie-notice">We</div><div class="ad-box">Buy</div><footer>f</footer>'
    assert htmltext.extract(page, None) == "First real paragraph. Second one."


def test_varying_slots_decide_where_the_content_is():
    """Without names to go by, what pages of a host have in common is told from what varies; one page alone can't tell."""
    rng = random.Random(23)
    intro, legal = words(rng, 40), words(rng, 60)
    page = lambda i: f"<div><div><div>{intro}</div></div><div><h1>Title {i}</h1><p>{words(rng, 20)} {i}</p><p>{words(rng, 25)} {i}</p></div><div><div>{legal}</div></div></div>"
    pages = [page(i) for i in range(6)]
    wrapper = htmltext.unpacked(htmltext.packed(htmltext.induce(pages[:5])))
    text = re.sub(r" +", " ", re.sub(r"<[^>]*>", " ", re.search(r"<h1>.*</p>", pages[5])[0])).strip()
    assert htmltext.extract(pages[5], wrapper) == text
    assert intro in htmltext.extract(pages[5], None) and legal in htmltext.extract(pages[5], None)


URLS = ["http://a.com/en/1", "https://EXAMPLE.com/en/7x?q=/", "http://www.example.net/de/8", "http://b.net/de/", "http://b.org/es/#t", "http://xcom/en/", "http://cheappills.example.com/x",
        "http://citylibrary.example.org/fr/", None, "no scheme", "a://b://c/d", "http://free-bets.io", "http://x.example.net/de/8/" + "q" * 3000]


def test_url_rules_and_words(spark):
    table = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(6, URLS[6], "h")], "page_id long, url string, host string")
    rows = urlfilter.judge(table).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(URLS) + 1 and len({(r.verdict, r.log_odds) for r in rows if r.page_id == 6}) == 1
    assert [got[i].rule for i in range(6)] == ["com/en/", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None]
    assert [got[i].verdict for i in range(5)] == ["block", "allow", "block", "allow", "block"] and got[12].rule == "example.net/de/8"
    assert (got[1].host, got[1].path, got[10].host, got[10].path) == ("example.com", "/en/7x", "b:", "//c/d")
    assert got[6].words.startswith("cheap pills") and got[6].verdict == "block" and got[11].verdict == "block"
    assert got[7].verdict == "allow" and (got[8].host, got[8].path, got[8].verdict) == ("", "", "allow") and got[9].host == ""
    assert urlfilter.judge(table.limit(0)).count() == 0


def _plain_rule(url):
    """Host, path and rule, read character by character."""
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [r for _, r in urlfilter.RULES if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def _every_split(name):
    return [[name]] + [[name[:i], *rest] for i in range(1, len(name)) for rest in _every_split(name[i:])]


def test_url_model_equals_brute_force(spark):
    """Rules, the likeliest segmentation of all, and naive Bayes by plain counting; a word of 30 letters is one word."""
    rng = random.Random(31)
    long, stems = "pneumonoultramicroscopicsilico", ["red", "fox", "foxy", "run", "den", "sun"]
    urls = list(URLS[:12]) + [f"http://{''.join(rng.sample(stems, 2))}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(stems)}-{rng.choice(stems)}" for _ in range(60)]
    urls += [f"http://{long}.org/x", f"http://red{long}.org/es/{long}"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(table).collect()}
    ruled = {w for _, r in urlfilter.RULES for w in re.split("[^a-z]+", r) if w}
    action = {r: a for a, r in urlfilter.RULES}
    names = lambda h, p: [n for n in re.split("[^a-z]+", h + "/" + p.lower()) if n]
    lexicon, prior, counts = Counter(), Counter(), {}
    for a, line in urlfilter.EXAMPLES:
        for w in line.split():
            prior[w] += 1
            counts.setdefault(w, {"block": 0.0, "allow": 0.0})[a] += urlfilter.PRIOR
    plain = [_plain_rule(u) for u in urls]
    for host, path, _ in plain:
        lexicon.update(n for label in host.split(".") if "-" in label for n in re.split("[^a-z]+", label) if n)
        lexicon.update(n for n in re.split("[^a-z]+", path.lower()) if n)
    base = 1 + sum(lexicon.values()) / 1000
    for w, n in prior.items():
        lexicon[w] += n * base
    total = sum(lexicon.values())
    log, unknown = {w: np.log(n / total) for w, n in lexicon.items()}, np.log(1 / total)
    value = lambda words: sum(log[w] if w in log else unknown - 2.3 * len(w) for w in words)
    for i, (host, path, rule) in enumerate(plain):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        at = 0
        words_ = got[i].words.split()
        for name in names(host, path):
            own = []
            while len("".join(own)) < len(name):
                own.append(words_[at])
                at += 1
            assert "".join(own) == name
            if len(name) <= 12:
                assert value(own) >= max(map(value, _every_split(name))) - 1e-9
            if rule and name not in ruled:
                for w in own:
                    counts.setdefault(w, {"block": 0.0, "allow": 0.0})[action[rule]] += 1
    sums = {a: sum(c[a] for c in counts.values()) + urlfilter.SMOOTHING * len(counts) for a in ("block", "allow")}
    odds = {w: np.log((c["block"] + urlfilter.SMOOTHING) / sums["block"]) - np.log((c["allow"] + urlfilter.SMOOTHING) / sums["allow"]) for w, c in counts.items()}
    for i, (host, path, rule) in enumerate(plain):
        pieces = {n: urlfilter.split_name(n, log, unknown) for n in names(host, path) if n not in ruled}
        want = np.log(urlfilter.PRIOR_BLOCK / (1 - urlfilter.PRIOR_BLOCK)) + sum(odds.get(w, 0.0) for n in names(host, path) if n not in ruled for w in pieces[n])
        assert abs(got[i].log_odds - want) < 1e-9 and got[i].verdict == (action[rule] if rule else "block" if want > 0 else "allow")
    assert got[len(urls) - 2].words.startswith(long) and got[len(urls) - 1].words.split()[:2] == ["red", long]
