"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

An element is a stretch of text with its tokens. Two neighbours are joined by encoding a window around
their border again. The window grows from the border until it ends, on both sides, at a place where the
tokens outside can't change: a white-space character right after a character that is none. No match of the
splitting pattern reaches across such a place from either side (white space only begins a match, or is the
whole of it), and merges stay inside a match, so both sides' tokens can be cut there. The tree gives the
tokens of the whole text, whatever the leaf size.

Nulls and empty texts have no tokens. Rows are independent: ties, repeats and null ids pass through."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from pitspark.llm.batches import docs_only, pieces

LEAF = 2048
FIRST_WINDOW = 32
_CUT = re.compile(r"\S(?=[ \n\t])")


def load_ranks(path: str) -> bytes:
    """The rank file's content: a vocabulary of fixed size (under 1 MB), shipped with the plan."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class Codec:
    def __init__(self, content: bytes, pattern: str, leaf: int = LEAF):
        ranks = parse_ranks(content)
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.width = np.array([len(t) for t in self.token], np.int64)
        self.leaf = max(1, leaf)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _flat(self, text: str) -> np.ndarray:
        return np.array(self.base.encode_ordinary(text), np.int32)

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._flat(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = self._stable_before(text, lo, mid), self._stable_after(text, mid, hi)
        keep = len(left) - self._tokens_in(left[::-1], len(text[a:mid].encode()))
        skip = self._tokens_in(right, len(text[mid:b].encode()))
        return np.concatenate((left[:keep], self._flat(text[a:b]), right[skip:]))

    def _stable_before(self, text: str, lo: int, mid: int) -> int:
        size = FIRST_WINDOW
        while True:
            at = max(lo, mid - size)
            # The last character is left out: what follows it is the other side's.
            last = None
            for last in _CUT.finditer(text, at, mid):
                pass
            if last:
                return last.end()
            if at == lo:
                return lo
            size *= 2

    def _stable_after(self, text: str, mid: int, hi: int) -> int:
        size = FIRST_WINDOW
        while True:
            to = min(hi, mid + size)
            if found := _CUT.search(text, mid, to):
                return found.end()
            if to == hi:
                return hi
            size *= 2

    def _tokens_in(self, tokens: np.ndarray, n_bytes: int) -> int:
        """How many tokens from the start make up this many bytes."""
        if not n_bytes:
            return 0
        size = FIRST_WINDOW
        while True:
            reach = np.cumsum(self.width[tokens[:size]])
            if reach[-1] >= n_bytes or size >= len(tokens):
                return int(np.searchsorted(reach, n_bytes)) + 1
            size *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.token[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every document."""
    content = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content.value, pattern, leaf)
        for part, texts in pieces(batches):
            ids = [codec.encode((t or b"").decode()) for t in texts]
            decoded = pa.array([codec.decode(x) for x in ids], pa.binary())
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoded], schema=ENCODED)

    return docs_only(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
