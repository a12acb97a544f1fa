"""What the operators share inside a task: pieces of Arrow batches of bounded size, word hashes, folds.

Words are maximal runs of bytes outside a set of ASCII separators, so UTF-8 text is cut without decoding
it. A batch is handled in pieces of about ``PIECE`` bytes; a longer text is a piece of its own."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
SPACE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_M = np.uint64(0x9E3779B97F4A7C15)


def docs_only(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; others may have any name and never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold_is(mod: int, rest: int) -> Column:
    """Whether crc32 of the decimal doc_id leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about PIECE bytes of text, and their texts as UTF-8."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary())
        lengths = np.cumsum([len(t) if (t := x.as_buffer()) is not None else 0 for x in texts]) if len(batch) else np.zeros(0)
        at = 0
        while at < len(batch):
            before = lengths[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(lengths, before + PIECE, side="right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Word hashes of many texts at once: a polynomial hash over each word's bytes from running sums.

    ``hashes`` has one 64-bit value per word, ``first`` the index of each text's first word (one more
    entry than texts)."""

    def __init__(self, separators: bytes = SPACE, lower: bool = False):
        self.lower = lower
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _M)
        self.value[~self.is_word] = 0
        if lower:
            self.value = self.value[np.frombuffer(LOWER, np.uint8)]
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0xD6E8FEB86659FD93
            size = max(n, PIECE + 4096)
            for name, b in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        joined = b" ".join(t or b"" for t in texts)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        word = self.is_word[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        start, stop = edge[0::2], edge[1::2]
        self._powers(len(data) + 1)
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=running[1:])
        hashes = mix((running[stop] - running[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * _M)
        first = np.concatenate(([0], np.searchsorted(start, ends)))
        return hashes, first


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive word hashes of one text; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed) + np.uint64(k), np.uint64)
    factor = 0x2545F4914F6CDD1D
    # The sum of hashes[i + j] * factor ** (j + 1) over j < k, put together from sums over 1, 2, 4, ... words.
    part, width, done = hashes * np.uint64(factor), 1, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                out += part[done : done + n] * np.uint64(pow(factor, done, 1 << 64))
                done += width
            if done == k:
                return mix(out)
            part = part[:-width] + part[width:] * np.uint64(pow(factor, width, 1 << 64))
            width *= 2


def window_owner(first: np.ndarray, k: int) -> np.ndarray:
    """For windows over the joined word list: the text that holds the whole window, or -1."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(owner) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.where(owner[:n] == owner[k - 1 :], owner[:n], -1)
