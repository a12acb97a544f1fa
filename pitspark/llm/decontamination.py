"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are cut into words (A-Z lower-cased; letters, digits and everything outside ASCII). The patterns are
the windows of 10 consecutive words of the benchmark items; an item with fewer words is one window. For
each pattern length m a table of shifts says how far the search may jump when it meets a block of two
words: up to m - 1 words when the block is in no pattern. A block that ends patterns leads to the bucket of
the test strings with that suffix, and a direct comparison confirms an occurrence.

The benchmark is the query set: it is compiled in blocks of at most ``ITEMS_PER_BLOCK`` items, and every
document is searched for every block. Only one block is on the driver or in a task at a time.

Null and empty texts have no words and no hits; repeated benchmark items each count; repeated documents
are separate rows; an empty benchmark hits nothing."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import docs_only, pieces
from pitspark.session import materialize

WINDOW = 10
ITEMS_PER_BLOCK = 20_000

_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_AS_WORDS).split()


class WuManber:
    """Search tables for patterns (tuples of words) of any lengths."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for p in set(patterns):
            if p:
                by_length[len(p)].append(p)
        self.tables = [self._compile(m, ps) for m, ps in sorted(by_length.items())]

    @staticmethod
    def _compile(m: int, patterns: list[tuple[bytes, ...]]):
        block = min(2, m)
        shift: dict[tuple[bytes, ...], int] = {}
        bucket: dict[tuple[bytes, ...], set[tuple[bytes, ...]]] = defaultdict(set)
        for p in patterns:
            for end in range(block, m + 1):
                b = p[end - block : end]
                shift[b] = min(shift.get(b, m), m - end)
            bucket[p[m - block :]].add(p)
        return m, block, shift, bucket

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        n = len(words)
        for m, block, shift, bucket in self.tables:
            jump = m - block + 1
            get = shift.get
            at = m
            while at <= n:
                suffix = tuple(words[at - block : at])
                step = get(suffix, jump)
                if step:
                    at += step
                    continue
                here = tuple(words[at - m : at])
                if here in bucket[suffix]:
                    yield at - m, here
                at += 1


def item_windows(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _owners(items: list[tuple[str, bytes]], size: int) -> dict[tuple[bytes, ...], list[str]]:
    """The items of each window."""
    of_window: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for item, text in items:
        for w in item_windows(words_of(text), size):
            of_window[w].append(item)
    return dict(of_window)


def _blocks(benchmark: DataFrame, items_per_block: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's (item_id, text) in blocks, one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = max(1, -(-items.count() // items_per_block))
    for k in range(blocks):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def _search_block(found: DataFrame, items: list[tuple[str, bytes]], size: int) -> DataFrame:
    """Adds one block's hits and items to those of earlier blocks; the text goes on with them."""
    shared = found.sparkSession.sparkContext.broadcast(_owners(items, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = shared.value
        tables = WuManber(owners)
        for part, texts in pieces(batches):
            n_words, hits, found = [], [], []
            before = zip(part.column("hits").to_pylist(), part.column("items").to_pylist(), strict=True)
            for text, (old_hits, old_items) in zip(texts, before, strict=True):
                words = words_of(text)
                covered, names = set(old_hits or ()), set(old_items or ())
                for start, window in tables.search(words):
                    covered.update(range(start, start + len(window)))
                    names.update(owners[window])
                n_words.append(len(words))
                hits.append(np.array(sorted(covered), np.int32))
                found.append(sorted(names))
            columns = [part.column("doc_id"), part.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, schema=FOUND)

    return found.mapInArrow(run, "doc_id long, text string, n_words long, hits array<int>, items array<string>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, text, n_words, hits, items) per document: the positions of hit words, and the ids (as
    sorted strings, null ids as "null") of items with an occurring window. With several blocks, what one
    block found is written to the shared folder before the next is searched."""
    empty = {"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    found = docs_only(docs).withColumns(empty)
    for k, items in enumerate(_blocks(benchmark, items_per_block)):
        found = _search_block(materialize(found, "hits") if k else found, items, size)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of the benchmark."""
    for k, items in enumerate(_blocks(benchmark, items_per_block)):
        shared = docs.sparkSession.sparkContext.broadcast(_owners(items, size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables = WuManber(shared.value)
            for part, texts in pieces(batches):
                yield part.filter(pa.array([next(tables.search(words_of(t)), None) is None for t in texts]))

        docs = (materialize(docs, "clean") if k else docs).mapInArrow(run, docs.schema)
    return docs
