"""What the training-data operators share: tables, the shared folder, word indexes."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..storage import materialize, passing, shared_dir, small, table, union_all

__all__ = ["WordIndex", "ascii_words", "frugal", "letter_words", "materialize", "passing", "plain_words", "remembered", "shared_dir", "small", "table", "texts", "union_all"]

#: Bytes of words and their columns that a Python worker remembers.
WORD_BYTES = 32 << 20

_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LETTER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


_held: dict = {}


#: Blocks from this size on are mapped on their own. The arrays of one batch are smaller: mapping each anew costs a fault for every page of it.
OWN_BLOCK = 4 << 20

#: glibc's names for what ``mallopt`` sets: when to give memory back, which blocks are mapped on their own, how many arenas.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _ARENA_MAX = -1, -3, -8


@functools.cache
def frugal() -> None:
    """For the rest of a Python worker's life, freed arrays and Arrow buffers go back to the system at once, where the C library can."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except AttributeError:
        return
    for what, value in ((_ARENA_MAX, 1), (_MMAP_THRESHOLD, OWN_BLOCK), (_TRIM_THRESHOLD, OWN_BLOCK)):
        mallopt(what, value)
    pa.set_memory_pool(pa.system_memory_pool())


def remembered(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time; that of another stage goes first."""
    frugal()
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def ascii_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return raw.translate(_ASCII_LOWER).split()


def plain_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return raw.translate(_WORD_BYTES).split()


def letter_words(raw: bytes) -> list[bytes]:
    """Runs of a-z and non-ASCII bytes after lower-casing A-Z."""
    return raw.translate(_LETTER_BYTES).split()


def texts(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a batch's string column; null reads as empty."""
    return [x or b"" for x in batch.column(name).cast("binary").to_pylist()]


class _Numbers(dict):
    """Word -> number, the next one for a word not met before; ``fresh`` lists those."""

    def __init__(self):
        self.fresh: list = []

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordIndex:
    """Word -> dense number, remembered within one Python worker and cleared when it outgrows ``limit`` bytes.

    ``describe(words)`` gives the attribute arrays of new words, one row for each word.
    """

    def __init__(self, describe, limit: int = WORD_BYTES):
        self.describe, self.limit = describe, limit
        self.clear()

    def clear(self) -> None:
        self.ids = _Numbers()
        self.columns: list[np.ndarray] | None = None
        self.bytes = 0

    def __call__(self, words: list) -> np.ndarray:
        if self.bytes > self.limit:
            self.clear()
            trim()
        at = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))  # each word is looked up once
        if fresh := self.ids.fresh:
            self.ids.fresh = []
            rows = self.describe(fresh)
            self.columns = list(rows) if self.columns is None else [self._grow(i, r) for i, r in enumerate(rows)]
            self.bytes += sum(map(len, fresh)) + 280 * len(fresh) + sum(r.nbytes for r in rows)
        return at

    def _grow(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Columns have spare room, so that many small additions stay cheap."""
        old, used = self.columns[i], len(self.ids) - len(rows)
        if len(old) < len(self.ids):
            new = np.zeros((max(3 * len(old) // 2, len(self.ids)), *old.shape[1:]), dtype=old.dtype)
            new[:used] = old[:used]
            old = new
        old[used : len(self.ids)] = rows
        return old
