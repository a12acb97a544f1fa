"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q, of max(``LEAST``, 2 q) words or more, that no
neighbouring word extends keeping the period. Words q apart are equal over at least half of it, so at the dyadic
scale with 2 L - 1 <= q the run holds a whole block of L words (blocks start at multiples of L) whose copy lies q
words further on.

1. **Blocks.** At each scale L = 2, 4, 8, ... every block is laid over the window of words that follows it, at
   all distances 2 L - 1 to 4 L - 2 (at L = 2 from 1: with 12 words there is room for it). The sum of squared
   differences at every distance is two prefix sums and one cross-correlation, which number-theoretic transforms
   modulo P give exactly. Words enter as small numbers, so that no sum reaches P: a sum of zero is zero mismatches.
   From scale ``CAP`` on the first CAP words of a block stand for it, and its window is taken in sections.
   Left out before the transforms are blocks that cannot have a seed: those with a word that does not occur again
   within 4 L - 2 words, and those all of whose copies would lie in a known run (see 2).
2. **Seeds.** A distance without mismatches is a seed, unless block and copy lie in a known run of a period of at
   most L / 2: the distance is a multiple of that period then, and leads to the same stretch.
3. **Extension.** A seed is extended to both sides by binary search over prefix hashes. What is long enough is
   compared word by word (and extended so where a hash was wrong). Of stretches with the same ends the smallest
   distance is the period.

Transforms are products with dense matrices of up to 128 x 128, in two steps for longer windows; a task holds
``CELLS`` numbers of them at a time, so memory is a few numbers per word of the longest text, and work is about
n log n for n words, periodic texts included.

Words are what spaces and the controls 0x09-0x0D separate, compared unchanged. Null and empty texts have no words
and no runs. Rows are independent: repeated rows, ties and null ids need nothing special, other columns may have
any names, and an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitspark.llm.batches import SPACE, Words, docs_only, mix, pieces

LEAST = 12
CAP = 4096
CELLS = 1 << 19
P = 7 * 2**20 + 1  # a prime with roots of unity of every order up to 2^20; 128 products of residues fit in 53 bits
GENERATOR = 3
SIDE = 128
_TO_SPACE = bytes(0x20 if b in SPACE else b for b in range(256))


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues of smallest size, in place."""
    x -= np.rint(x * (1.0 / P)) * P
    return x


def _powers(root: int, rows: int, columns: int) -> np.ndarray:
    """root ** (i * j), as residues of smallest size."""
    table = np.ones(rows * columns, np.int64)
    steps = np.array([pow(root, int(k), P) for k in range(rows)], np.int64)
    out = table.reshape(rows, columns)
    for j in range(1, columns):
        out[:, j] = out[:, j - 1] * steps % P
    return _mod(out.astype(np.float64))


class Transform:
    """Number-theoretic transforms of rows of ``size`` numbers (a power of two, at most SIDE squared)."""

    def __init__(self, size: int):
        self.inner = min(size, SIDE)
        self.outer = size // self.inner
        root = pow(GENERATOR, (P - 1) // size, P)
        self.there = self._tables(root, 1)
        self.back = self._tables(pow(root, -1, P), pow(size, -1, P))

    def _tables(self, root: int, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        twist = _powers(root, self.outer, self.inner)
        across = _powers(pow(root, self.inner, P), self.outer, self.outer)
        along = _mod(_powers(pow(root, self.outer, P), self.inner, self.inner) * factor)
        return across, twist, along

    def forward(self, x: np.ndarray) -> np.ndarray:
        """The transform of each row; its numbers stand in an order of their own."""
        across, twist, along = self.there
        x = x.reshape(len(x), self.outer, self.inner)
        if self.outer > 1:
            x = _mod(_mod(np.matmul(across, x)) * twist)
        return _mod(x.reshape(-1, self.inner) @ along).reshape(x.shape)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        across, twist, along = self.back
        x = _mod(y.reshape(-1, self.inner) @ along).reshape(y.shape)
        if self.outer > 1:
            x = _mod(np.matmul(across, _mod(x * twist)))
        return x.reshape(len(x), -1)


@cache
def _transform(size: int) -> Transform:
    return Transform(size)


def zero_mismatches(numbers: np.ndarray, blocks: np.ndarray, length: int, nearest: int, distances: int) -> tuple[np.ndarray, np.ndarray]:
    """(which block, distance) for every block start and distance from ``nearest`` at which the ``length``
    numbers of the block occur again, as far as their remainders tell: of a division by the largest number for which
    squared differences over ``length`` places sum to less than P. Reading past the end repeats the last number;
    such distances are the caller's to leave out."""
    size = 4 * length
    window = distances + length - 1
    turn, last, divisor = _transform(size), len(numbers) - 1, isqrt((P - 1) // length)
    which, at = [], []
    step = max(1, CELLS // size)
    for k in range(0, len(blocks), step):
        x = blocks[k : k + step, None]
        own = np.zeros((len(x), size))
        own[:, :length] = numbers[x + np.arange(length - 1, -1, -1)] % divisor
        following = np.zeros((len(x), size))
        following[:, :window] = numbers[np.minimum(x + nearest + np.arange(window), last)] % divisor
        both = turn.inverse(_mod(turn.forward(own) * turn.forward(following)))[:, length - 1 : length - 1 + distances]
        squares = np.zeros((len(x), window + 1))
        np.cumsum(following[:, :window] ** 2, axis=1, out=squares[:, 1:])
        sums = (own**2).sum(1, keepdims=True) + squares[:, length:] - squares[:, :distances]
        row, column = np.nonzero(_mod(sums - 2 * both) == 0)
        which.append(row + k)
        at.append(column + nearest)
    return np.concatenate(which), np.concatenate(at)


def recurrence(words: np.ndarray) -> np.ndarray:
    """How many words further on each word occurs again, at the least: words count as equal if their last 16 bits
    are, which sort faster. A number past the end if it does not."""
    bits = words.astype(np.uint16)
    order = np.argsort(bits, kind="stable")
    again = bits[order[1:]] == bits[order[:-1]]
    distance = np.full(len(words), len(words), np.int64)
    distance[order[:-1][again]] = np.diff(order)[again]
    return distance


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, and where each of them comes first."""
    order = np.lexsort(rows.T[::-1])
    first = order[np.r_[True, (np.diff(rows[order], axis=0) != 0).any(1)][: len(rows)]]
    return rows[first], first


class Stretches:
    """Longest equal stretches of two places of a sequence, by binary search over prefix hashes."""

    BASE = np.uint64(0x9E6C63D0876A9A63)

    def __init__(self, values: np.ndarray):
        self.values = values
        self.power = np.ones(len(values) + 1, np.uint64)
        self.power[1:] = self.BASE
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values) * self.power[:-1], out=self.sums[1:])

    def _equal(self, x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[x + n] - s[x]) * self.power[q] == s[x + q + n] - s[x + q]

    def around(self, x: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends (a, b) of the longest stretch over x, inside [low, high), of words that equal the one q
        further on."""
        right, left = np.zeros_like(x), np.zeros_like(x)
        room_right, room_left = high - q - x, x - low
        step = 1 << int(max(room_right.max(), room_left.max(), 1)).bit_length()
        while step := step >> 1:
            for reached, room, where in ((right, room_right, lambda n: x), (left, room_left, lambda n: x - n)):
                n = reached + step
                fits = np.flatnonzero(n <= room)
                grown = fits[self._equal(where(n)[fits], q[fits], n[fits])]
                reached[grown] += step
        return x - left, x + right

    def exactly(self, x: int, q: int, low: int, high: int) -> tuple[int, int]:
        """The same, word by word."""
        apart = np.flatnonzero(self.values[low : high - q] != self.values[low + q : high]) + low
        k = int(np.searchsorted(apart, x))
        return (int(apart[k - 1]) + 1 if k else low), (int(apart[k]) if k < len(apart) else high - q)


def runs_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs in several texts at once: rows (text, start, length, period), by text, start and period. ``words``:
    64-bit values, equal for equal words; ``first``: index of each text's first word, and the end."""
    texts = np.flatnonzero(np.diff(first) >= LEAST)
    low, high = first[texts].astype(np.int64), first[texts + 1].astype(np.int64)
    known = np.zeros((0, 3), np.int64)
    stretches = Stretches(words) if len(texts) else None
    distance, scrambled = recurrence(words), mix(words)
    scale = 2
    while len(texts):
        nearest = 2 * scale - 1 if scale > 2 else 1
        fits = high - low >= max(LEAST, 2 * nearest)
        if not fits.any():
            break
        # Blocks whose nearest copy still lies in their text.
        counts = (high[fits] - low[fits] - nearest) // scale
        of = np.repeat(np.arange(len(counts)), counts)
        blocks = low[fits][of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * scale
        # A word that does not occur again within the window leaves its block without a copy there.
        far = np.concatenate(([0], np.cumsum(distance > 4 * scale - 2)))
        recurs = far[blocks + scale] == far[blocks]
        of, blocks = of[recurs], blocks[recurs]
        top = high[fits][of]
        # Where the known runs of a small period end that start at a block or before; no distance is left if its
        # last copy ends there too.
        small = known[known[:, 2] * 2 <= scale]
        inside = np.r_[-1, np.maximum.accumulate(small[:, 1])][np.searchsorted(small[:, 0], blocks, side="right")]
        left = np.minimum(blocks + 5 * scale - 2, top) > inside
        of, blocks, top, inside = of[left], blocks[left], top[left], inside[left]
        length = min(scale, CAP)
        found = []
        for section in range(nearest, 4 * scale - 1, 2 * length):
            distances = min(2 * length, 4 * scale - 1 - section)
            open_ = np.flatnonzero(blocks + section + scale <= top)
            which, q = zero_mismatches(scrambled, blocks[open_], length, section, distances) if len(open_) else (open_, open_)
            which = open_[which]
            seed = (blocks[which] + q + scale <= top[which]) & (blocks[which] + q + scale > inside[which])
            which, q = which[seed], q[seed]
            for k in range(0, len(q), CELLS):
                w, d = which[k : k + CELLS], q[k : k + CELLS]
                a, b = stretches.around(blocks[w], d, low[fits][of[w]], top[w])
                long = np.flatnonzero((b - a >= d) & (b - a + d >= LEAST))
                ends, one = distinct(np.stack((a[long], b[long], d[long]), 1))
                for (a_, b_, d_), i in zip(ends.tolist(), long[one].tolist(), strict=True):
                    if not (words[a_:b_] == words[a_ + d_ : b_ + d_]).all():
                        a_, b_ = stretches.exactly(int(blocks[w[i]]), d_, int(low[fits][of[w[i]]]), int(top[w[i]]))
                    if b_ - a_ >= d_ and b_ - a_ + d_ >= LEAST:
                        found.append((a_, b_ + d_, d_))
        known, _ = distinct(np.concatenate((known, np.array(found, np.int64).reshape(-1, 3))))
        scale *= 2
    # The known runs are in order of start, end and period.
    smallest = np.r_[True, (known[1:, :2] != known[:-1, :2]).any(1)] if len(known) else np.zeros(0, bool)
    runs = known[smallest]
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    out = np.stack((owner, runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]), 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def single_spaced(text: bytes) -> bytes:
    """The words of a text joined by one space."""
    text = text.translate(_TO_SPACE).strip(b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def confirmed_runs(runs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """The (start, length, period) rows of one text, if they hold for the words themselves; else runs found
    anew with numbers for the words, in case two words have the same hash."""
    if all(words[s : s + n - p] == words[s + p : s + n] for s, n, p in runs.tolist()):
        return runs
    number: dict[bytes, int] = {}
    return runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.uint64), np.array([0, len(words)]))[:, 1:]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs as (start, length, period) by start, then period,
    starts counted in words from 0; collapsed is the text without the words that come after the first period
    of a run they are in, joined by one space ("" for null)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for part, texts in pieces(batches):
            hashes, first = hashed(texts)
            runs = runs_of(hashes, first)
            cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            n_words, lists, collapsed = np.diff(first), [], []
            for k, text in enumerate(texts):
                if cut[k] == cut[k + 1]:
                    lists.append([])
                    collapsed.append(single_spaced(text or b"").decode())
                    continue
                words = text.split()
                own = confirmed_runs(runs[cut[k] : cut[k + 1], 1:], words).tolist()
                kept = np.ones(len(words), bool)
                for start, length, period in own:
                    kept[start + period : start + length] = False
                lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                collapsed.append(b" ".join([words[i] for i in np.flatnonzero(kept).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(lists, pa.list_(_RUN)), pa.array(collapsed, pa.string())], schema=schema)

    return docs_only(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
