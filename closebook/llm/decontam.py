"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows, each text scanned once.

Texts and items are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window
is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The
automaton holds every distinct window, framed by spaces, and runs over the text's words joined by single
spaces; a hit's place is counted back to word numbers and from there to offsets in the original text.

The items are a stated, small set. They are read through Spark and cut into blocks of at most ``BLOCK_BYTES``
of window text, which bounds the automaton (about 50 bytes a byte, 100 MB) in each Python worker; one block is
the usual case, and more blocks mean more scans, not more memory. A block's automaton replaces the one before.

Null text has no words. Items without words have no windows. Repeated items with one id count once; an item
without an id marks words but is not counted. Empty tables give no rows or no hits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain_words, remembered, texts, union_all

BLOCK_BYTES = 2_000_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_REPORT = "row long, doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>"


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


def _blocks(items: DataFrame, window: int) -> Iterator[dict]:
    """{window: item ids} in blocks of bounded size, streamed to the driver partition by partition."""
    block, size = {}, 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        for w in windows_of(plain_words((row[1] or "").encode()), window):
            if w not in block:
                if size + len(w) > BLOCK_BYTES and block:
                    yield block
                    block, size = {}, 0
                size += len(w)
            block.setdefault(w, set()).add(row[0])
    if block:
        yield block


def automaton(block: dict):
    """Of one block's windows; None for none."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w, items in block.items():
        machine.add_word(w.decode("latin-1"), (w.count(b" ") - 1, items))
    machine.make_automaton()
    return machine if len(machine) else None


def _joined(words: list[bytes]) -> str:
    return " " + b" ".join(words).decode("latin-1") + " "


class _Shared:
    """A broadcast block with a key that stays the same in all workers."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.key = broadcast, key

    def machine(self):
        return remembered(("windows", self.key), lambda: automaton(self.broadcast.value))


def scan(machine, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Hit word ranges [begin, end), merged and in order, and the items hit; no automaton, no hits."""
    ranges: list[tuple[int, int]] = []
    items: set = set()
    if machine is None or not words:
        return ranges, items
    joined, seen, upto = _joined(words), 0, 0
    for end, (n, ids) in machine.iter(joined):
        seen, upto = seen + joined.count(" ", upto, end), end
        begin, stop = seen - n, seen
        items |= ids
        while ranges and ranges[-1][1] >= begin:
            a, b = ranges.pop()
            begin, stop = min(begin, a), max(stop, b)
        ranges.append((begin, stop))
    return ranges, items


def _scanner(shared: _Shared, only_hits: bool):
    def run(batches):
        machine = shared.machine()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            rows = batch.column("row").to_pylist() if "row" in batch.schema.names else [None] * batch.num_rows
            for row, doc, raw in zip(rows, batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = plain_words(raw)
                ranges, items = scan(machine, words)
                if ranges or not only_hits:
                    found = sorted(x for x in items if x is not None)
                    for column, value in zip(out, (row, doc, len(words), [a for a, _ in ranges], [b for _, b in ranges], found), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row", "doc_id", "n_words", "begins", "ends", "items"])

    return run


def _original(text: str | None, ranges: list) -> list[tuple[int, int]]:
    """Word ranges as character offsets in the text as it was."""
    at = [m.span() for m in _WORD.finditer((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def spans(text, begins, ends):
    """Character spans of hit word ranges in the original text, as a column; meant for rows with hits only."""
    place = lambda t, a, b: _original(t, list(zip(a, b, strict=True))) if a else []
    return F.udf(place, "array<struct<begin:int,end:int>>")(text, begins, ends)


def _shared_blocks(sc, items: DataFrame, window: int) -> Iterator[_Shared]:
    for block in _blocks(items, window):
        key = hashlib.sha256()
        for w, ids in block.items():
            key.update(w + b"\n" + ",".join(sorted(map(str, ids))).encode() + b"\n")
        yield _Shared(sc.broadcast(block), key.hexdigest())


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, begins and ends (hit word ranges, end exclusive), items (sorted ids) of each document.

    Ranges of one block are merged and in order; ranges of several blocks may overlap.
    """
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = _shared_blocks(sc, items, window)
    first = next(blocks, None) or _Shared(sc.broadcast({}), "none")
    second = next(blocks, None)
    if second is None:
        return narrow.mapInArrow(_scanner(first, False), _REPORT).drop("row")
    numbered = materialize(narrow.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    parts = [numbered.mapInArrow(_scanner(first, False), _REPORT), numbered.mapInArrow(_scanner(second, True), _REPORT)]
    parts += [materialize(numbered.mapInArrow(_scanner(shared, True), _REPORT), "decontam-hits") for shared in blocks]
    merged = union_all(parts).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.drop("row")


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(docs, items, window)
    ranges = F.array_sort(F.arrays_zip(F.col("begins"), F.col("ends")))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("hit"))
    step = lambda acc, r: F.struct(
        F.greatest(acc["upto"], r["ends"]).alias("upto"), (acc["hit"] + F.greatest(F.lit(0).cast("long"), r["ends"] - F.greatest(acc["upto"], r["begins"]))).alias("hit")
    )
    return found.select(
        "doc_id", "n_words", F.aggregate(ranges, start, step, lambda acc: acc["hit"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("begins") > 0).alias("contaminated"),
    )


def _clean(shared: _Shared):
    """Which texts have no hit. Only the texts go through Python; other columns stay in Spark."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = shared.machine()
        for column in columns:
            raws = column.cast(pa.binary())
            parts = (raws.slice(i, 64).to_pylist() for i in range(0, len(raws), 64))
            yield pa.array([machine is None or next(machine.iter(_joined(plain_words(raw or b""))), None) is None for part in parts for raw in part], pa.bool_())

    return F.arrow_udf(run, "boolean")


def remove(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, columns unchanged."""
    for i, shared in enumerate(_shared_blocks(docs.sparkSession.sparkContext, items, window)):
        if i:  # one automaton at a time
            docs = materialize(docs, "decontam-left")
        docs = docs.filter(_clean(shared)(F.col("text")))
    return docs


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dg.doc_id, dg.n, dg.i, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
