"""Near-duplicates: bottom-k sketches from one hash function, inverted lists, exact verification.

A document's set is its distinct five-word shingles (words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z;
fewer words form one shingle, none form no set). Two documents are linked if their Jaccard similarity
reaches ``threshold``; a component is what links connect.

1. One 64-bit hash function gives each document's sketch, its ``INDEX_K`` smallest shingle hashes, and a
   finer sketch of ``ESTIMATE_K`` for estimates. Documents with equal sets form a class; only the class's
   smallest doc_id goes on, so a group of copies is never expanded.
2. Retained values are inverted. Two documents at the threshold share fewer retained values than
   ``shared_least`` in at most ``LOST`` of such pairs, by the binomial tail (at 0.85 about 54 of 64, seldom
   fewer than 36; sets of up to 54 shingles are retained whole: there the bound is certain). So they meet in
   a list of one of each other's rarest ``INDEX_K - shared_least + 1`` values, and a document is listed
   under these alone: a passage that many documents quote is common and leads nowhere unless it makes up
   most of a document.
3. In each list every member is held against the smallest one. Links that are confirmed merge members.
4. In lists whose members are still apart, those outside the list's commonest component are held against
   all members, in blocks of bounded size: the union-sketch estimate of each pair with different labels
   filters, and what passes goes to step 5. Members of one component never meet again, so a family of
   copies costs its stragglers times its size. Sketches that hold whole sets leave no doubt: of such pairs a
   block passes on only as many as join its components, and none that those join already. Nothing is capped.
5. Candidates are confirmed on the full sets. The side that many pairs have in common is joined last, so its
   set is sent once for each task, not for each pair.

Components come from alternating large-star and small-star rounds on the link table.

Both losses are parameters. A link at the threshold is missed by the lists in one of 1 / ``lost`` cases and by
the estimates, which pass what is less than ``sigmas`` deviations below the threshold, in about one of 10^9;
links above the threshold less often. ``lost=0`` lists documents under every retained value, and
``sigmas=None`` confirms every pair that shares a list without an estimate.

Null or empty texts have an empty set and are linked with nothing, as are rows whose doc_id is null.
Rows with the same doc_id count as one document. Empty input gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WordIndex, ascii_words, materialize, passing, remembered, shared_dir, small, texts

SHINGLE, INDEX_K, ESTIMATE_K, LOST, SIGMAS, BITS = 5, 64, 512, 1e-8, 6.0, 0.01
BLOCK = 1000
_SKETCH = "doc_id long, n_shingles long, set_id binary, retained array<long>, sketch binary"


def _hash_words(words: list[bytes]) -> list[np.ndarray]:
    import xxhash

    return [np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    index = remembered("shingle words", lambda: WordIndex(_hash_words))
    words, marks = [], [0]
    for raw in raws:
        words += ascii_words(raw)
        marks.append(len(words))
    if not words:
        return [np.zeros(0, np.uint64) for _ in raws]
    at = index(words)
    h = index.columns[0][at]
    factor = np.uint64(0x9E3779B97F4A7C15)

    def fold(begin: int, count: int, length: int) -> np.ndarray:
        acc = np.full(count, length, dtype=np.uint64)
        for j in range(length):
            acc = acc * factor + h[begin + j : begin + j + count]
        return _mix(acc)

    every = fold(0, len(h) - SHINGLE + 1, SHINGLE) if len(h) >= SHINGLE else None
    out = []
    for a, b in zip(marks, marks[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]))
        else:
            out.append(fold(a, 1, b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _sketches(batches):
    for batch in batches:
        for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
            sets = shingle_sets(texts(part))
            kept = [s[:INDEX_K].view(np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept))),
                pa.array([(s[:ESTIMATE_K] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
            ], names=["doc_id", "n_shingles", "set_id", "retained", "sketch"])


def shared_least(percent: int, lost: float = LOST) -> int:
    """Retained values of ``INDEX_K`` that two documents at the threshold share but for one of 1 / ``lost`` pairs."""
    p, tail = percent / 100, 0.0
    for least in range(INDEX_K):
        tail += math.comb(INDEX_K, least) * p**least * (1 - p) ** (INDEX_K - least)
        if tail > lost:
            return max(1, least)
    return INDEX_K


def _share(percent: int, lost: float):
    """Least number of retained values that two linked documents share, as a column of the set's size."""
    whole = math.floor(INDEX_K * percent / 100)
    size = F.least(F.col("n_shingles"), F.lit(INDEX_K))
    return F.when(F.col("n_shingles") <= whole, F.ceil(F.col("n_shingles") * percent / 100)).otherwise(F.least(size, F.lit(shared_least(percent, lost))))


def _lists(reps: DataFrame, percent: int, lost: float) -> DataFrame:
    """(value, rep, n_shingles): each class under its rarest retained values that others retain too."""
    values = reps.select("rep", "n_shingles", F.explode("retained").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("n_docs")).filter("n_docs > 1")
    met = values.join(often, "value")
    own = Window.partitionBy("rep")
    alone = F.least(F.col("n_shingles"), F.lit(INDEX_K)) - F.count(F.lit(1)).over(own)
    prefix = F.least(F.col("n_shingles"), F.lit(INDEX_K)) - _share(percent, lost) + 1
    return (
        met.withColumns({"alone": alone, "place": F.row_number().over(own.orderBy("n_docs", "value"))})
        .filter(F.col("place") <= prefix - F.col("alone"))
        .select("value", "rep", "n_shingles")
    )


def _near(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimates(ska: list[bytes], skb: list[bytes]) -> np.ndarray:
    """Similarity in the union of two sketches, up to the largest value that both are known to."""
    out = np.zeros(len(ska))
    for i, (a, b) in enumerate(zip(ska, skb, strict=True)):
        a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        upto = min((s[-1] for s in (a, b) if len(s) >= ESTIMATE_K), default=np.uint32(0xFFFFFFFF))
        a, b = a[: np.searchsorted(a, upto, "right")], b[: np.searchsorted(b, upto, "right")]
        both = len(np.intersect1d(a, b))
        out[i] = both / max(1, len(a) + len(b) - both)
    return out


def _cut(threshold: float, sigmas: float | None) -> float:
    """The least estimate that goes on: ``sigmas`` standard deviations below the threshold, or nothing."""
    return threshold - sigmas * math.sqrt(threshold * (1 - threshold) / ESTIMATE_K) if sigmas is not None else -1.0


def _estimate_filter(cut: float):
    def run(batches):
        for batch in batches:
            keep = _estimates(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist()) >= cut
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def _full_sets(batches):
    for batch in batches:
        for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts(part))], pa.binary())], names=["doc_id", "set"])


def _both_sides(pairs: DataFrame, side: DataFrame, what: str) -> DataFrame:
    """``what`` of both ends; ``a``, which many pairs may share, comes last and is not shuffled again."""
    for c in ("b", "a"):
        pairs = pairs.join(side.select(F.col("doc_id").alias(c), F.col(what).alias(f"{c}_{what}")), c)
    return pairs


def _confirmed(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, percent: int, cut: float | None) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; estimates over ``cut`` come first where one is given."""
    ends = lambda p: materialize(p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "dup-ids")
    if cut is not None and cut > 0:
        some = sketches.select("doc_id", "sketch").join(small(ends(pairs)), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        pairs = materialize(_both_sides(pairs, some, "sketch").mapInArrow(_estimate_filter(cut), "a long, b long"), "dup-pairs")
    some = docs.join(small(ends(pairs)), "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, set binary")
    return materialize(_both_sides(pairs, some, "set").mapInArrow(_verify(percent), "a long, b long").distinct(), "dup-links")


def _block_pairs(percent: int, cut: float):
    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("rep")
        own = key[1] == key[2]
        left = frame if own else frame[frame["part"] == key[1]]
        right = frame if own else frame[frame["part"] == key[2]]
        sides = []
        for f in (left,) if own else (left, right):
            sk = [np.frombuffer(x, np.uint32) for x in f["sketch"]]
            upto = np.array([s[-1] if len(s) >= ESTIMATE_K else 0xFFFFFFFF for s in sk], dtype=np.uint32)
            sides.append((f["rep"].to_numpy(), f["label"].to_numpy(), f["n_shingles"].to_numpy(), sk, upto))
        (ra, la, na, ska, ua), (rb, lb, nb, skb, ub) = sides[0], sides[-1]
        shared = _overlaps(ska, skb)
        in_a = np.stack([np.searchsorted(s, ub, "right").astype(np.int16) for s in ska]) if len(ska) else np.zeros((0, len(skb)), np.int16)
        in_b = np.stack([np.searchsorted(s, ua, "right").astype(np.int16) for s in skb]).T if len(skb) else np.zeros((len(ska), 0), np.int16)
        both = (in_a + in_b - shared).astype(np.float32)
        good = shared >= np.float32(cut) * both
        # Sketches that hold their whole sets need no margin but for values that agree in 32 bits.
        whole = np.array([len(s) < ESTIMATE_K for s in ska], bool)[:, None] & np.array([len(s) < ESTIMATE_K for s in skb], bool)[None, :]
        good &= ~whole | (shared >= np.float32(max(cut, percent / 100 - BITS)) * both)
        good &= la[:, None] != lb[None, :]
        good &= 100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :])
        sure = good & whole & (shared >= np.float32(percent / 100 + BITS) * both)
        i, j = _needed(good, sure, la, lb)
        a, b = np.minimum(ra[i], rb[j]), np.maximum(ra[i], rb[j])
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return run


def _needed(good: np.ndarray, sure: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs between members with labels ``la`` and ``lb`` those that can still join anything.

    Pairs that are sure join labels; of those only a spanning forest is needed, and no other pair within it.
    """
    labels, codes = np.unique(np.concatenate([la, lb]), return_inverse=True)
    ca, cb, n = codes[: len(la)], codes[len(la) :], len(labels)
    i, j = np.nonzero(sure)
    key, first = np.unique(np.minimum(ca[i], cb[j]) * n + np.maximum(ca[i], cb[j]), return_index=True)
    near = np.zeros((n, n), bool)
    near[key // n, key % n] = near[key % n, key // n] = True
    group, tree = np.full(n, -1), []
    for start in range(n):
        if group[start] >= 0:
            continue
        group[start], reached = start, [start]
        while len(reached):
            fresh = np.flatnonzero(near[reached].any(0) & (group < 0))
            group[fresh] = start
            tree += [(min(u, v), max(u, v)) for v in fresh for u in [reached[int(near[reached, v].argmax())]]]
            reached = fresh
    kept = first[np.searchsorted(key, [u * n + v for u, v in tree])] if tree else np.zeros(0, np.int64)
    open_i, open_j = np.nonzero(good & ~sure & (group[ca][:, None] != group[cb][None, :]))
    return np.concatenate([i[kept], open_i]), np.concatenate([j[kept], open_j])


def _overlaps(ska: list[np.ndarray], skb: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Common values of each pair of sketches, by products of incidence matrices a few columns at a time."""
    va, vb = np.concatenate(ska or [np.zeros(0, np.uint32)]), np.concatenate(skb or [np.zeros(0, np.uint32)])
    ia, ib = np.repeat(np.arange(len(ska)), [len(s) for s in ska]), np.repeat(np.arange(len(skb)), [len(s) for s in skb])
    if ska is skb:  # a value of one member only is in no pair
        common, held = np.unique(va, return_counts=True)
        common = common[held > 1]
    else:
        common = np.intersect1d(va, vb)
    pa_, pb_ = np.searchsorted(common, va), np.searchsorted(common, vb)
    oka = (pa_ < len(common)) & (common[np.minimum(pa_, len(common) - 1)] == va) if len(common) else np.zeros(len(va), bool)
    okb = (pb_ < len(common)) & (common[np.minimum(pb_, len(common) - 1)] == vb) if len(common) else np.zeros(len(vb), bool)
    ia, pa_, ib, pb_ = ia[oka], pa_[oka], ib[okb], pb_[okb]
    out = np.zeros((len(ska), len(skb)), dtype=np.float32)
    for begin in range(0, len(common), width):
        sa, sb = (pa_ >= begin) & (pa_ < begin + width), (pb_ >= begin) & (pb_ < begin + width)
        ma, mb = np.zeros((len(ska), width), np.float32), np.zeros((len(skb), width), np.float32)
        ma[ia[sa], pa_[sa] - begin] = 1
        mb[ib[sb], pb_[sb] - begin] = 1
        out += ma @ mb.T
    return out


def _others(lists: DataFrame, links: DataFrame, sketches: DataFrame, percent: int, cut: float) -> DataFrame:
    """Candidate pairs of list members that the smallest member has not brought together."""
    labels = components(links)
    named = lists.join(labels, lists["rep"] == labels["node"], "left").withColumn("label", F.coalesce("component", "rep"))
    named = materialize(named.select("value", "rep", "n_shingles", "label"), "dup-named")
    first = named.groupBy("value").agg(F.min("rep").alias("pivot"))
    rest = named.join(first, "value").filter("rep <> pivot")
    # The commonest label of each list, and the lists that have another.
    per_label = rest.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"))
    apart = per_label.groupBy("value").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("label")).alias("least"))).alias("top"), F.count(F.lit(1)).alias("labels")
    ).filter("labels > 1")
    minor = F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int")
    members = materialize(
        rest.join(apart.select("value", (-F.col("top.least")).alias("top"), minor.alias("minor"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("major")), "value").select(
            "value", "rep", "n_shingles", "label", "minor", "major",
            F.when(F.col("label") == F.col("top"), F.col("minor") + F.expr("int(pmod(hash(rep), major))")).otherwise(F.expr("int(pmod(hash(rep), minor))")).alias("part"),
        ),
        "dup-members",
    )
    ids = materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "dup-ids")
    some = sketches.select("doc_id", "sketch").join(small(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    # A part of the others meets every part; a part of the commonest label only those of the others.
    meets = F.when(F.col("part") < F.col("minor"), F.col("minor") + F.col("major")).otherwise(F.col("minor"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    keyed = dealt.join(some.withColumnRenamed("doc_id", "rep"), "rep").select(
        "value", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "n_shingles", "label", "sketch"
    )
    found = keyed.groupBy("value", "lo", "hi").applyInPandas(_block_pairs(percent, cut), "a long, b long")
    return materialize(found.distinct(), "dup-pairs")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): alternating star rounds until nothing changes."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(down.union(least).distinct(), "cc")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first()
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now


def _found(narrow: DataFrame, percent: int, lost: float, sigmas: float | None) -> DataFrame:
    sketches = materialize(narrow.mapInArrow(_sketches, _SKETCH), "dup-sketches")
    able = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(able.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "dup-classes")
    firsts = able.join(classes.withColumnRenamed("rep", "doc_id"), ["set_id", "doc_id"], "left_semi")
    reps = firsts.select(F.col("doc_id").alias("rep"), "n_shingles", "retained")
    lists = materialize(_lists(reps, percent, lost), "dup-lists")
    first = lists.groupBy("value").agg(F.min(F.struct("rep", "n_shingles")).alias("p"))
    pairs = lists.join(first, "value").filter(F.col("rep") != F.col("p.rep")).filter(_near("n_shingles", "p.n_shingles", percent))
    pairs = materialize(pairs.select(F.col("p.rep").alias("a"), F.col("rep").alias("b")).distinct(), "dup-pairs")
    cut = _cut(percent / 100, sigmas)
    links = _confirmed(pairs, narrow, firsts, percent, cut)
    more = _confirmed(_others(lists, links, firsts, percent, cut), narrow, firsts, percent, None)
    found = components(links.unionByName(more))
    whole = sketches.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    whole = whole.join(found, whole["rep"] == found["node"], "left")
    named = whole.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return named.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def near_duplicates(docs: DataFrame, percent: int = 85, lost: float = LOST, sigmas: float | None = SIGMAS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document; ``percent`` is the least similarity.

    The result is a table in the shared folder; what led to it is removed.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, out = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/dup-found-{uuid.uuid4().hex}"
    with passing(spark):
        found = _found(narrow, percent, lost, sigmas)
        found.write.parquet(out)
    return spark.read.schema(found.schema).parquet(out)


def deduplicate(docs: DataFrame, percent: int = 85, lost: float = LOST, sigmas: float | None = SIGMAS) -> DataFrame:
    """One document of each component, columns unchanged; of rows with one doc_id, one stays."""
    found = near_duplicates(docs, percent, lost, sigmas)
    gone = materialize(found.filter(~F.col("kept")).select("doc_id").distinct(), "dup-gone")
    twice = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = materialize(twice, "dup-twice")
    stay = docs.join(small(gone), "doc_id", "left_anti")
    if not twice.isEmpty():
        again = stay.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        stay = stay.join(small(twice), "doc_id", "left_anti").unionByName(again)
    return stay.select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""
