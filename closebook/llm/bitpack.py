"""Token-ID output: fixed-width bit packing, with block offsets for numpy unpacking and random access.

The format. Documents in ascending doc_id order (null first; equal ids by text, null first) are cut into
shards, one for each range partition, and a shard into blocks. A block holds whole documents, at least
``BLOCK_IDS`` ids unless it is a shard's last:

    shard, block        place in the order
    first, n_ids        the block's offset: ids of the shard before it; ids in it
    width               bits of each id: the fewest that hold the vocabulary
    least, most         smallest and largest doc_id in it, by which a reader passes over blocks
    doc_ids, ends       its documents and where each ends, in ids from the block's start
    payload             the ids, ``width`` bits each, least significant bit first

The id at place i of a block is in the bits from i * width on, so any document is read without its
neighbours, and a whole block is unpacked by a few vector operations. Blocks are the rows of a Parquet
table, since on a cluster only Spark's own writers reach the shared store.

Null text is an empty text and has only the end id. Repeated rows are written as often as they occur; rows
that share a doc_id are dealt by the beginnings of their texts, so only rows alike in both stay together.
Empty input gives files without rows. Extra columns are ignored. Any vocabulary file of the tokenizers
library will do; what cannot be encoded word by word is encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _ASCII_LOWER, WordIndex, remembered, shared_dir, texts

BLOCK_IDS = 1 << 14
#: Words encoded by one call; what the library returns for a word is some hundred times its size.
AT_ONCE = 1 << 11
#: Words in one text of such a call, and the mark between them.
TOGETHER, BETWEEN = 16, b"\x01"
SCHEMA = "shard int, block int, first long, n_ids long, width int, least long, most long, doc_ids array<long>, ends array<long>, payload binary"
_SPECIAL = b"<|"
#: Bytes told apart: white space, ASCII marks, all others.
_SPACE, _MARK, _OTHER = 0, 1, 2
_KINDS = bytes(_SPACE if c == 32 or 9 <= c <= 13 else _MARK if 33 <= c < 127 and not chr(c).isalnum() else _OTHER for c in range(256))
#: Letters that are lower-case and composed already (a-z, U+00DF-U+00FF), and words of nothing else.
_LETTERS = "".join(chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7)
_OF_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
# How a vocabulary must split texts to be encoded word by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Eight ids fill ``width`` bytes; each byte is put together from the ids that reach into it."""
    rows = -(-len(ids) // 8)
    padded = np.zeros(rows * 8, dtype=np.uint64)
    padded[: len(ids)] = ids
    eight = padded.reshape(rows, 8)
    out = np.zeros((rows, width), dtype=np.uint8)
    for j in range(8):
        for b in range(j * width // 8, (j * width + width - 1) // 8 + 1):
            shift = 8 * b - j * width
            part = eight[:, j] >> np.uint64(shift) if shift >= 0 else eight[:, j] << np.uint64(-shift)
            out[:, b] |= (part & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The ids at the places start .. stop - 1, reading only the bytes that hold them."""
    g0, g1 = start // 8, -(-stop // 8)
    rows = np.frombuffer(payload, dtype=np.uint8, count=(g1 - g0) * width, offset=g0 * width).reshape(g1 - g0, width)
    out = np.zeros((g1 - g0, 8), dtype=np.uint64)
    for j in range(8):
        for b in range(j * width // 8, (j * width + width - 1) // 8 + 1):
            shift, byte = 8 * b - j * width, rows[:, b].astype(np.uint64)
            out[:, j] |= byte << np.uint64(shift) if shift >= 0 else byte >> np.uint64(-shift)
    out &= np.uint64((1 << width) - 1)
    return out.reshape(-1)[start - 8 * g0 : stop - 8 * g0].astype(np.uint32)


def words_of(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and how many of them stand before each text's end.

    A-Z are lower-cased, and marks between a letter and white space or the end are a word of their own; a text that
    may spell a special token is cut at white space only and keeps its letters.
    """
    ends = np.cumsum([len(r) + 1 for r in raws], dtype=np.int64)
    odd = np.array([_SPECIAL in r for r in raws], dtype=bool)
    lower = b"\n".join([b"", *(r if o else r.translate(_ASCII_LOWER) for r, o in zip(raws, odd.tolist(), strict=True)), b""])
    data, kinds = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(_KINDS), np.uint8)
    filled = kinds != _SPACE
    edges = np.flatnonzero(filled[1:] != filled[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    # Where the marks that end a word begin, if a letter (a-z, or one of U+00DF-U+00FF) is before them.
    marks = kinds == _MARK
    runs = np.flatnonzero(marks[1:] & ~marks[:-1]) + 1
    at = runs[np.searchsorted(runs, stops[marks[stops - 1]]) - 1] if len(runs) else runs
    last = data[at - 1]
    letter = (last >= 97) & (last <= 122) | (last >= 0x9F) & (last <= 0xBF) & (last != 0xB7) & (data[at - 2] == 0xC3)
    at = at[letter & ~odd[np.searchsorted(ends, at)]]
    starts, stops = (np.sort(np.concatenate([x, at]), kind="stable") for x in (starts, stops))
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[filled])])
    return words, np.searchsorted(starts, ends)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to ids, each distinct word encoded once and remembered.

    A vocabulary that lower-cases, drops white space, and never lets a piece cross white space or pass from a
    letter to marks that end a word is used word by word: words are told apart after lower-casing A-Z and with
    closing marks split off; texts that may spell a special token are cut at white space only. Words of small
    letters go to the library's model straight. With any other vocabulary whole texts are encoded.
    """

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core, and each thread would hold memory of its own
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(vocabulary), end_id
        self.width = width_of(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.flat, self.index = np.zeros(0, np.uint32), WordIndex(self._describe, limit=64 << 20)
        made = json.loads(self.tokenizer.to_str())
        split = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = (
            made["normalizer"] == _NORMALIZER and split[0].get("pattern") == {"Regex": _SPLIT} and split[0].get("invert") is True
            and [x.get("type") for x in split] == ["Split", "ByteLevel"] and all(_SPECIAL.decode() in x["content"] for x in made["added_tokens"])
        )
        # The mark stands between spaces, where no piece crosses, so its one id tells where a word's ids end.
        mark = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids if self.by_word else []
        self.mark = mark[0] if len(mark) == 1 else None
        self.closing = self._closing(made["model"].get("end_of_word_suffix")) if self.by_word else None

    def _closing(self, suffix: str | None) -> np.ndarray | None:
        """For each id, whether it ends a word; with it, words of letters go to the same model past normalizing and splitting, which leave them whole."""
        from tokenizers import Tokenizer, pre_tokenizers

        if not suffix:
            return None
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {ord(c): bytewise.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        closing = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        closing[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        return closing

    def _of_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, of words of ``_LETTERS`` only."""
        joined = [b" ".join(words[i : i + TOGETHER]).decode().translate(self.spelled) for i in range(0, len(words), TOGETHER)]
        ids: list[int] = []
        for x in self.model.encode_batch_fast(joined, add_special_tokens=False):
            ids += x.ids
        ids = np.array(ids, dtype=np.uint32)
        counts = np.diff(np.flatnonzero(self.closing[ids]), prepend=-1)
        return (ids, counts) if len(counts) == len(words) else self._encoded(words)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in order, and how many each has."""
        whole = b" ".join(words)
        if self.mark is None or BETWEEN in whole or _SPECIAL in whole:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)
        gap = b" " + BETWEEN + b" "
        joined = [(gap.join(words[i : i + TOGETHER]) + gap).decode() for i in range(0, len(words), TOGETHER)]
        ids: list[int] = []
        for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids += x.ids
        ids = np.array(ids, dtype=np.uint32)
        at = np.flatnonzero(ids == self.mark)
        return np.delete(ids, at), np.diff(at, prepend=-1) - 1

    def _describe(self, words: list[bytes]) -> list[np.ndarray]:
        if not self.index.columns:
            self.flat = np.zeros(0, np.uint32)
        counts, starts, ids, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [self.flat], len(self.flat)
        letters = [self.closing is not None and _OF_LETTERS(w) is not None for w in words]
        kinds = (self._of_letters, [i for i, x in enumerate(letters) if x]), (self._encoded, [i for i, x in enumerate(letters) if not x and words[i] != b" "])
        for encoded, places in kinds:
            for i in range(0, len(places), AT_ONCE):
                at = places[i : i + AT_ONCE]
                found, counts[at] = encoded([words[k] for k in at])
                starts[at] = held + np.cumsum(counts[at]) - counts[at]
                ids.append(found)
                held += len(found)
        if b" " in words:
            at = words.index(b" ")
            starts[at], counts[at] = held, 1
            ids.append(np.array([self.end_id], dtype=np.uint32))
        self.flat = np.concatenate(ids)
        return [starts, counts]

    def __call__(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text's followed by the end id, and where each text ends."""
        if not self.by_word:
            found = [[*x.ids, self.end_id] for x in self.tokenizer.encode_batch_fast([r.decode() for r in raws], add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64)
        if not raws:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words, before = words_of(raws)
        coded = words.dictionary_encode()  # each word of these texts is looked up once
        numbers = self.index([*coded.dictionary.to_numpy(zero_copy_only=False), b" "])
        marks = before + np.arange(len(raws))
        at = np.insert(numbers[coded.indices.to_numpy()], before, numbers[-1])
        starts, counts = (c[at] for c in self.index.columns)
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1])]
        return ids, ends[marks]


def _encoder(vocabulary: str | None, end_id: int) -> Encoder:
    path = vocabulary or default_vocabulary()
    return remembered(("encoder", path, end_id), lambda: Encoder(path, end_id))


def _writer(vocabulary: str | None, end_id: int, block_ids: int):
    def write(batches):
        encode, shard, first, block = _encoder(vocabulary, end_id), TaskContext.get().partitionId(), 0, 0
        ids_of, docs, held = [], [], 0

        def cut():
            nonlocal first, block, ids_of, docs, held
            ids, ends = np.concatenate(ids_of), np.cumsum([n for _, n in docs])
            known = [d for d, _ in docs if d is not None]
            row = {
                "shard": shard, "block": block, "first": first, "n_ids": len(ids), "width": encode.width, "least": min(known, default=None), "most": max(known, default=None),
                "doc_ids": [d for d, _ in docs], "ends": ends.tolist(), "payload": pack(ids, encode.width),
            }
            first, block, ids_of, docs, held = first + len(ids), block + 1, [], [], 0
            return row

        rows = []
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids, ends = encode(texts(part))
                begin = 0
                for doc, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    ids_of.append(ids[begin:end])
                    docs.append((doc, end - begin))
                    held, begin = held + end - begin, end
                    if held >= block_ids:
                        rows.append(cut())
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if docs:
            rows.append(cut())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return write


_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("least", pa.int64()), ("most", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> str:
    """Encode and write ``docs``; returns the folder of the files."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    ordered.mapInArrow(_writer(vocabulary, end_id, block_ids), SCHEMA).write.parquet(path)
    return path


def _digests(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("shard", "first", "n_ids", "width", "doc_ids", "ends", "payload")]
        out = [[], [], [], [], []]
        for shard, first, n, width, doc_ids, ends, payload in zip(*cols, strict=True):
            raw, begin = memoryview(unpack(payload, width, 0, n).astype("<u4").tobytes()), 0
            for doc, end in zip(doc_ids, ends, strict=True):
                for column, value in zip(out, (shard, doc, first + begin, end - begin, zlib.crc32(raw[4 * begin : 4 * end])), strict=True):
                    column.append(value)
                begin = end
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])


def shard_starts(blocks: DataFrame) -> DataFrame:
    """ids of all shards before each: a row for each shard."""
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    return per_shard.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every written document, unpacked from the files."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    docs = blocks.mapInArrow(_digests, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(shard_starts(blocks.select("shard", "n_ids")))  # a row for each written file
    return docs.join(starts, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of each document with this doc_id."""
    rows = spark.read.schema(SCHEMA).parquet(path).filter((F.col("least") <= doc_id) & (F.col("most") >= doc_id) & F.array_contains("doc_ids", doc_id)).collect()
    out = []
    for r in rows:
        for i, d in enumerate(r.doc_ids):
            if d == doc_id:
                out.append(unpack(bytes(r.payload), r.width, r.ends[i - 1] if i else 0, r.ends[i]))
    return out
