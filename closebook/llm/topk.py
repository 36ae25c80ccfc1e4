"""Exact top-k search: term-at-a-time accumulation over blocks, partition selection, merge.

Every vector is turned into integer weights, a term for each component. Candidates are packed, where they
lie, into blocks whose postings are term-major; queries into blocks of sparse rows. Blocks are bounded in
rows and in bytes. Query blocks are sent to every candidate block, which stays whole and is sent once: for
each term the query rows that have it scatter weight times postings into a dense score array, and the k
best of each row are selected by partition. The partial lists of a query are merged by rank. Nothing is
broadcast and no block grows with the data.

Vectors that are null or hold null or non-finite components take no part. Rows that share a vec_id are
candidates of their own, but one query: the one whose weights come first in order. A query never meets rows
with its own vec_id; ties go to the smaller vec_id. Vectors of other lengths than the query's share its
leading terms. Scores are exact; beyond 64 bits they stop at the largest or smallest long. Queries with fewer
than k candidates return what there is; empty input returns no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

QUERY_ROWS, CANDIDATE_ROWS, BLOCK_BYTES = 2048, 16384, 16 << 20
_BLOCK = "block string, n int, dims int, ids binary, weights binary"
_TYPES = pa.schema([("block", pa.string()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary())])


def _stored(w: np.ndarray) -> bytes:
    """Weights as 32-bit integers where they fit, else as doubles, which hold them exactly too."""
    fits = not w.size or np.abs(w).max() < 2**31
    return (b"i" if fits else b"d") + w.astype(np.int32 if fits else np.float64).tobytes()


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if raw[:1] == b"i" else np.float64, offset=1)


def _packer(rows: int, room: int):
    """Blocks of at most ``rows`` vectors and about ``room`` bytes: ids ascending, weights term-major."""

    def pack(batches):
        from pyspark import TaskContext

        part, made, held, widest = TaskContext.get().partitionId(), 0, [], 0

        def block():
            nonlocal made, held, widest
            held.sort(key=lambda x: x[0])
            w = np.zeros((widest, len(held)))
            for i, (_, v) in enumerate(held):
                w[: len(v), i] = v
            made += 1
            ids = np.array([x for x, _ in held], dtype=np.int64)
            out = {"block": f"{part}-{made}", "n": len(ids), "dims": widest, "ids": ids.tobytes(), "weights": _stored(w)}
            held, widest = [], 0
            return pa.RecordBatch.from_pylist([out], schema=_TYPES)

        for batch in batches:
            for lists, ids in ((batch.column("weights").slice(i, 1024), batch.column("vec_id").slice(i, 1024)) for i in range(0, batch.num_rows, 1024)):
                values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                for vec, begin, end in zip(ids.to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    if held and (len(held) == rows or (len(held) + 1) * max(widest, end - begin) * 4 > room):
                        yield block()
                    held.append((vec, values[begin:end]))
                    widest = max(widest, end - begin)
        if held:
            yield block()

    return pack


def accumulate(query: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of each query row with each candidate; ``query`` rows x terms, ``postings`` terms x candidates."""
    terms = min(query.shape[1], len(postings))
    most = float(np.abs(query).max(initial=0)) * float(np.abs(postings).max(initial=0)) * max(1, terms)
    if most >= 2.0**62:  # integers of any size
        query, postings = (np.array([[int(x) for x in row] for row in side], dtype=object).reshape(side.shape) for side in (query, postings))
        scores = np.zeros((len(query), postings.shape[1]), dtype=object)
    else:
        query, scores = query.astype(np.int64), np.zeros((len(query), postings.shape[1]), dtype=np.int64)
    for term in range(terms):
        rows = np.flatnonzero(query[:, term] != 0)
        weights = postings[term] if most >= 2.0**62 else postings[term].astype(np.int64)
        if len(rows) == len(query):
            scores += query[:, term, None] * weights
        elif len(rows):
            scores[rows] += query[rows, term, None] * weights
    return scores if most < 2.0**62 else np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of one row; ids are ascending, so the first of equals is the smallest."""
    if (own == ids).any():
        scores, ids = scores[ids != own], ids[ids != own]
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x grows, for every long
    return ids[order], scores[order]


def _searcher(k: int, chunk: int = 64):
    def search(batches):
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                qid, cid = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                q = np.ascontiguousarray(_read(r["q_weights"]).reshape(r["q_dims"], r["q_n"]).T)
                postings = _read(r["c_weights"]).reshape(r["c_dims"], r["c_n"])
                out = [[], [], []]
                for begin in range(0, len(qid), chunk):
                    scores = accumulate(q[begin : begin + chunk], postings)
                    for own, row in zip(qid[begin : begin + chunk], scores, strict=True):
                        ids, values = best(row, cid, own, k)
                        for column, x in zip(out, (np.full(len(ids), own), ids, values), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for the queries vec_id % every = 0 against all rows."""
    there = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & there)
    # Products with 1024 are exact, as are whole numbers of any size in doubles, which a long might not hold.
    whole = lambda x: F.when(F.abs(x) < 2.0**43, F.floor(x * 1024).cast("double")).when(F.abs(x) < 2.0**1000, x * 1024).otherwise(F.signum(x) * 2.0**1010)
    rows = rows.select("vec_id", F.transform("embedding", whole).alias("weights"))
    side = lambda frame, n, room, to: materialize(frame.mapInArrow(_packer(n, room), _BLOCK).toDF(*(f"{to}_{c}" for c in ("block", "n", "dims", "ids", "weights"))), f"topk-{to}")
    asked = materialize(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("weights").alias("weights")), "topk-asked")
    queries = side(asked.repartition(1 + asked.count() // QUERY_ROWS), QUERY_ROWS, BLOCK_BYTES // 8, "q")
    candidates = side(rows, CANDIDATE_ROWS, BLOCK_BYTES, "c")
    # Each candidate block is a key of its own, so no key is hot.
    number = F.row_number().over(Window.orderBy("c_block")) - 1
    numbered = candidates.join(candidates.select("c_block", number.alias("c_no")), "c_block")
    sent = queries.withColumn("c_no", F.explode(F.sequence(F.lit(0), F.lit(max(candidates.count(), 1) - 1))))
    found = sent.join(numbered, "c_no").mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e) = 1),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
