"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their tokens overlap.

Every text, with a space before it, is encoded by ``A`` (a byte-level vocabulary file of the tokenizers library) and by ``B``
(a sentencepiece model, which adds the space itself). Special tokens' strings are plain text. The documents of a block
are laid end to end: the ends of all A and of all B tokens are counted by byte once, a cut is where both occur, and
prefix sums over the boundaries, taken at the documents' ends, give each document's tokens, groups and links. A link is a pair of tokens whose
bytes overlap: each stretch between neighbouring boundaries of either is one.

How many documents hold a pair of ids linked is a count over the corpus. A block holds each of its pairs once, with
its number of documents; these rows are summed by pair, joined back by pair, and gathered by block, where the
documents' own lists of pairs wait. So no key has more rows than there are blocks, whatever the texts, and a block's
pairs are bounded by its size (``BLOCK_BYTES``, or one longer document).

Documents whose text is null or empty, or whose A or B bytes differ from the text's (as those of U+2581 do), have no
tokens: all counts are 0 and the groups empty. Repeated rows each count as a document. A null doc_id is kept. Empty tables give no rows;
extra columns are ignored. Stretches of text that neither tokenizer can join to the next are encoded once and
remembered; with vocabularies for which that is not sure, whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, materialize, remembered

BLOCK_BYTES, CHUNK, DESCRIBED = 2 << 20, 1 << 19, 1 << 14
SPACE = "▁"
# Unicode's white space, and how a vocabulary must split texts to be encoded stretch by stretch.
_WHITE = "\\t-\\r\\x85\\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: From a space after something else than white space to before the next such space.
_STRETCH = re.compile(rf" [ {_WHITE}]*[^ {_WHITE}]*(?:[{_WHITE}][ {_WHITE}]*[^ {_WHITE}]*)*")
_PROBE = "  a\tb ﬁ é\n  "

_DOCS = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>"
BLOCKS = f"block long, {_DOCS}, pairs array<long>, documents array<long>, listed array<long>, at binary, times binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    hexed = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(hexed[1], 16)]) if hexed else piece.replace(SPACE, " ").encode()


class Both:
    """Texts to the ids of both tokenizers, and the bytes of each id."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        known = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.blank = self.b.piece_to_id(SPACE)
        made = json.loads(self.a.to_str())
        self.by_stretch = (
            made["normalizer"] is None and made["pre_tokenizer"] == _SPLIT and all(x["special"] for x in made["added_tokens"])
            and not any(SPACE in p.lstrip(SPACE) for p in pieces) and pieces[self.blank] == SPACE and self.b.normalize(_PROBE) == (" " + _PROBE).replace(" ", SPACE)
        )
        self.raw, self.starts, self.sizes = {}, {}, {}
        for name, known in (("a", self.a_bytes), ("b", self.b_bytes)):
            self.raw[name] = np.frombuffer(b"".join(known), dtype=np.uint8)
            self.sizes[name] = np.fromiter(map(len, known), np.int32, len(known))
            self.starts[name] = np.cumsum(self.sizes[name]) - self.sizes[name]
        widest = max(len(self.a_bytes), len(self.b_bytes))
        self.width = len(str(widest - 1))
        self.digits = np.array([[ord(c) for c in str(i).rjust(self.width)] for i in range(widest)], dtype=np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(widest)], dtype=np.int64)
        self.index = WordIndex(self._describe, limit=160 << 20)
        self.flat: dict[str, np.ndarray] = {}

    def _describe(self, words: list[str]) -> list[np.ndarray]:
        """Per stretch: where its A and B ids begin and how many there are, its bytes, and whether its bytes come back."""
        if self.index.columns is None:
            self.flat = {"a": np.zeros(0, np.int32), "b": np.zeros(0, np.int32)}
        parts = [self._described(words[i : i + DESCRIBED]) for i in range(0, len(words), DESCRIBED)]
        return [np.concatenate(c) for c in zip(*parts, strict=True)]

    def _described(self, words: list[str]) -> list[np.ndarray]:
        a = [x.ids for x in self.a.encode_batch_fast(words, add_special_tokens=False)]
        b = self.b.encode([w[1:] for w in words], num_threads=1)
        if self.by_stretch:
            b = [ids or [self.blank] for ids in b]  # a space alone
        raw = [w.encode() for w in words]
        joined, sizes = np.frombuffer(b"".join(raw), dtype=np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        out, same = [], np.ones(len(words), dtype=bool)
        for name, found in (("a", a), ("b", b)):
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, counts.sum())
            out += [len(self.flat[name]) + np.cumsum(counts) - counts, counts]
            self.flat[name] = np.concatenate([self.flat[name], ids])
            same &= self._comes_back(name, ids, counts, joined, sizes)
        return [*out, sizes, same]

    def _comes_back(self, name: str, ids: np.ndarray, counts: np.ndarray, joined: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each stretch, whether its ids' bytes are its own."""
        own = self.sizes[name][ids]
        upto = np.r_[0, np.cumsum(own, dtype=np.int64)]
        spelt = self.raw[name][np.repeat(self.starts[name][ids] - upto[:-1], own) + np.arange(upto[-1])]
        begins = upto[np.cumsum(counts) - counts]
        same = upto[np.cumsum(counts)] - begins == sizes
        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(joined))
        unlike = spelt[np.minimum(at, len(spelt) - 1)] != joined if len(spelt) else np.ones(len(joined), dtype=bool)
        wrong = np.r_[0, np.cumsum(unlike)]
        return same & (wrong[np.cumsum(sizes)] == wrong[np.cumsum(sizes) - sizes])

    def stretches(self, text: str) -> list[str]:
        """Of a text that begins with a space."""
        return _STRETCH.findall(text) if self.by_stretch else [text]

    def __call__(self, texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The ids of all texts in order with their bytes, and each text's bytes: 0 without tokens."""
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self.stretches(" " + text)
                counts[i] = len(found)
                words += found
        at = self.index(words)
        if not words:
            return {k: np.zeros(0, np.int64) for k in ("a", "a_size", "b", "b_size")}, counts
        a0, n_a, b0, n_b, sizes, same = (c[at] for c in self.index.columns)
        owner = np.repeat(np.arange(len(texts)), counts)
        odd = np.unique(owner[~same])
        good = ~np.isin(owner, odd)
        lengths = np.bincount(owner[good], weights=sizes[good], minlength=len(texts)).astype(np.int64)
        ids = {}
        for name, starts, n in (("a", a0[good], n_a[good]), ("b", b0[good], n_b[good])):
            ends = np.cumsum(n)
            place = np.repeat(starts - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            ids[name] = self.flat[name][place]
            ids[f"{name}_size"] = self.sizes[name][ids[name]]
        if not self.by_stretch:
            self.index.clear()
        return ids, lengths


def _hashes(both: Both, ids: np.ndarray, marks: np.ndarray, ends: np.ndarray, keep: bool) -> list[str]:
    """Each document's decimal ids with the mark behind each, hashed (or as they are); ``ends``: documents' ends among the ids."""
    out: list[str] = []
    hashed, parts, d, begin = hashlib.sha256(), [], 0, 0

    def close(empty: bool) -> None:
        nonlocal hashed, parts
        out.append(b"".join(parts).decode() if keep else "" if empty else hashed.hexdigest())
        hashed, parts = hashlib.sha256(), []

    for first in range(0, len(ids), CHUNK):
        own, mark = ids[first : first + CHUNK], marks[first : first + CHUNK]
        table = np.empty((len(own), both.width + 1), dtype=np.uint8)
        table[:, :-1], table[:, -1] = both.digits[own], mark
        seen = np.empty(table.shape, dtype=bool)
        seen[:, :-1] = np.arange(both.width) >= (both.width - both.n_digits[own])[:, None]
        seen[:, -1] = mark > 0
        told = memoryview(table[seen].tobytes())
        upto = np.cumsum(seen.sum(1))
        while d < len(ends):
            stop = min(int(ends[d]), first + len(own))
            if stop > max(begin, first):
                piece = told[int(upto[max(begin, first) - first - 1]) if max(begin, first) > first else 0 : int(upto[stop - first - 1])]
                hashed.update(piece)
                if keep:
                    parts.append(bytes(piece))
            if stop < ends[d]:
                break
            close(int(ends[d]) == begin)
            begin, d = int(ends[d]), d + 1
            if begin == first + len(own):
                break
    while d < len(ends):
        close(True)
        d += 1
    return out


def block_of(both: Both, docs: list, texts: list, keep: bool = False) -> dict:
    """One block: per document its numbers and groups (hashed, or as they are if ``keep``), and the pairs linked in it."""
    ids, sizes = both(texts)
    doc_ends = np.cumsum(sizes)
    total = int(doc_ends[-1]) if len(doc_ends) else 0
    a_at = np.bincount(np.cumsum(ids["a_size"], dtype=np.int64), minlength=total + 1).astype(bool)
    b_at = np.bincount(np.cumsum(ids["b_size"], dtype=np.int64), minlength=total + 1).astype(bool)
    bounds = np.flatnonzero(a_at | b_at)
    is_a, is_b = a_at[bounds], b_at[bounds]
    del a_at, b_at
    cut = is_a & is_b
    last = np.searchsorted(bounds, doc_ends, side="right")  # boundaries up to each document's end
    n_a, n_b, n_cut = (np.r_[0, np.cumsum(x)] for x in (is_a, is_b, cut))
    per_doc = lambda sums: np.diff(sums[np.r_[0, last]])
    links = np.diff(np.r_[0, last])
    # Groups: A ids, then B ids, of each stretch between cuts.
    cuts = np.flatnonzero(cut)
    a_group, b_group = n_cut[:-1][is_a], n_cut[:-1][is_b]
    b_before, a_upto = np.r_[0, n_b[1:][cuts]], n_a[1:][cuts]
    order, mark = np.empty(n_a[-1] + n_b[-1], dtype=np.int32), np.empty(n_a[-1] + n_b[-1], dtype=np.uint8)
    a_place, b_place = np.arange(n_a[-1]) + b_before[a_group], np.arange(n_b[-1]) + a_upto[b_group]
    order[a_place], order[b_place] = ids["a"], ids["b"]
    mark[a_place], mark[b_place] = np.where(cut[is_a], ord("|"), ord(",")), np.where(cut[is_b], ord(";"), ord(","))
    ends = n_a[last] + n_b[last]
    mark[ends[per_doc(n_b) > 0] - 1] = 0
    groups = _hashes(both, order, mark, ends, keep)
    del order, mark, a_place, b_place, a_group, b_group
    # Links: one for each boundary, of the tokens that hold the byte before it.
    pair = (ids["a"][n_a[:-1]].astype(np.int64) << 32) | ids["b"][n_b[:-1]] if len(bounds) else np.zeros(0, np.int64)
    pairs, number = np.unique(pair, return_inverse=True)
    key, times = np.unique(np.repeat(np.arange(len(docs)), links) * max(1, len(pairs)) + number, return_counts=True)
    holder, at = np.divmod(key, max(1, len(pairs)))
    return {
        "doc_id": docs, "n_a": per_doc(n_a), "n_b": per_doc(n_b), "n_groups": per_doc(n_cut), "n_links": links, "groups": groups,
        "pairs": pairs, "documents": np.bincount(at, minlength=len(pairs)), "listed": np.bincount(holder, minlength=len(docs)), "at": at.astype("<u4").tobytes(), "times": times.astype("<u4").tobytes(),
    }


def _both(a: str, b: str) -> Both:
    return remembered(("both", a, b), lambda: Both(a, b))


def _cut_blocks(batches, block_bytes: int):
    """(doc_ids, texts) of at least ``block_bytes`` bytes, the last of fewer."""
    docs, texts, held = [], [], 0
    for batch in batches:
        for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_pylist()
            for doc, text, size in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), sizes, strict=True):
                docs.append(doc)
                texts.append(text)
                held += size
                if held >= block_bytes:
                    yield docs, texts
                    docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


_LONGS, _STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())
_BLOCK_TYPES = {"block": pa.int64(), "doc_id": _LONGS, "n_a": _LONGS, "n_b": _LONGS, "n_groups": _LONGS, "n_links": _LONGS, "groups": _STRINGS, "pairs": _LONGS, "documents": _LONGS, "listed": _LONGS, "at": pa.binary(), "times": pa.binary()}


def _make_blocks(batches, a: str, b: str, block_bytes: int):
    both, base = _both(a, b), TaskContext.get().partitionId() << 32
    for k, (docs, texts) in enumerate(_cut_blocks(batches, block_bytes)):
        row = {"block": base + k} | block_of(both, docs, texts)
        yield pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in _BLOCK_TYPES.items()], names=list(_BLOCK_TYPES))


def _tell_groups(batches, a: str, b: str, block_bytes: int):
    both = _both(a, b)
    for docs, texts in _cut_blocks(batches, block_bytes):
        row = block_of(both, docs, texts, keep=True)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
        yield pa.RecordBatch.from_arrays([pa.array(row[c], _BLOCK_TYPES[c].value_type) for c in names], names=names)


def groups(docs: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) of each document."""
    own_a, own_b = default_vocabularies()
    run = partial(_tell_groups, a=a or own_a, b=b or own_b, block_bytes=block_bytes)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


def blocks(docs: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written table of blocks; all else is read from it, so that each text is encoded once."""
    own_a, own_b = default_vocabularies()
    run = partial(_make_blocks, a=a or own_a, b=b or own_b, block_bytes=block_bytes)
    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS), "alignment-blocks")


def _held(made: DataFrame) -> DataFrame:
    """(block, at, pair, documents): a row for each pair of a block."""
    return made.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "held")).select("block", "at", F.col("held.pairs").alias("pair"), F.col("held.documents").alias("documents"))


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, a, b, documents, best): in how many documents of all blocks a pair is linked, and whether no pair of its A id is in more."""
    total = materialize(_held(made).groupBy("pair").agg(F.sum("documents").alias("documents")), "alignment-pairs")
    parts = total.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "documents")
    most = parts.groupBy("a").agg(F.max("documents").alias("most"))
    return parts.join(most, "a").select("pair", "a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _weigh(block: pa.Table, weights: pa.Table) -> pa.Table:
    """The documents of one block with their pairs' counts over the corpus."""
    row = {c: block.column(c)[0].as_py() if c != "at" and c != "times" else block.column(c)[0].as_buffer() for c in block.column_names}
    n = len(weights)
    place = weights.column("at").to_numpy()
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count[place], best[place] = weights.column("documents").to_numpy(), weights.column("best").to_numpy().astype(np.int64)
    at, times = np.frombuffer(row["at"], "<u4").astype(np.int64), np.frombuffer(row["times"], "<u4").astype(np.int64)
    ends = np.cumsum(row["listed"])
    summed = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])
    out = {c: row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": summed(times * best[at]), "count_sum": summed(times * count[at]), "groups_sha256": row["groups"]}
    return pa.table({c: pa.array(x, pa.string() if c == "groups_sha256" else pa.int64()) for c, x in out.items()})


def align(docs: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    made = blocks(docs, a, b, block_bytes)
    counts = pair_counts(made).select("pair", F.col("documents").alias("count"), "best")
    weights = _held(made).select("block", "at", "pair").join(counts, "pair").select(F.col("block").alias("of"), "at", F.col("count").alias("documents"), "best")
    return made.drop("pairs", "documents").groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(lambda x, y: _weigh(x, y), _RESULT)
