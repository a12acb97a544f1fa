"""Removal of repeated passages with Aho-Corasick automata.

A window is 20 consecutive words of one document. A word goes if a window over it also starts earlier: in a
document with a smaller doc_id, or further up in the same one.

1. **Anchors.** Every window is represented by the smallest hash of its 6-word stretches, so equal windows
   have equal anchors, and a text has about one anchor per eight words. Anchors of one doc_id only rule out
   their windows; only the others' windows are looked at again.
2. **Confirmed passages.** The remaining windows are compared over all documents. In the first document of
   each window of several ids, runs of neighbouring recurring windows are merged into passages: the first copies
   of everything that recurs.
3. **Automata.** Documents are dealt into shards of bounded size. A shard gets the passages that share a
   window with one of its documents (a window belongs to one passage, so routes are linear in the windows), cuts them
   into blocks of 10 words (every 20-word match holds a whole block) and compiles these into one automaton over word
   symbols. All documents of the shard are streamed
   through it; a hit lays its passage along the document, and where the two agree in a stretch of 20 words or more and the
   passage has a smaller doc_id, the stretch is removed. The hits of a piece of documents are laid out and compared together.

What a document repeats of itself is found in the document, by sorting its windows.

Whole copies are settled first by a hash of their words: all but the first are removed whole, if they have
20 words. A passage that a third of all documents share is one row per shard; counting is aggregated in part
before each shuffle, windows to distinct shards before they meet their passage.

Words are what spaces and the controls 0x09-0x0D separate, compared unchanged through 64-bit hashes. Null
texts have no words and become "". Rows with the same id and text are the same document; other texts under
one id, told apart by a 64-bit hash, don't precede each other. Rows without an id
neither take words from other rows nor lose any to them, only what they repeat themselves. An empty table gives an empty one."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import Words, docs_only, mix, pieces, windows
from pitspark.session import discard, materialize

WINDOW = 20
STRETCH = 6
BLOCK = 10
SHARD_BYTES = 2 << 20
LAID = 1 << 19
LETTERS, VALUES = 3, 102


def _content(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a word sequence."""
    with np.errstate(over="ignore"):
        places = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
        return int(mix(np.array([(hashes * (places | np.uint64(1))).sum() + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def window_anchors(hashes: np.ndarray, size: int = WINDOW, stretch: int = STRETCH) -> np.ndarray:
    """The smallest stretch hash of every window of a text."""
    span = size - stretch + 1
    low, width = windows(hashes, stretch), 1
    while 2 * width <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    return np.minimum(low[: len(low) - (span - width)], low[span - width :]) if len(hashes) >= size else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _text): the columns that are read, and the hash that tells texts under one id apart."""
    return docs_only(docs).withColumn("_text", F.xxhash64("text"))


def _texts(docs: DataFrame) -> DataFrame:
    return _hashed(docs).where("doc_id is not null and text is not null")


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, _text, whole): the anchors of every document of 20 words or more; and one row that is
    ``whole``, whose anchor is the hash of all words."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("_text", pa.int64()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part, texts in pieces(batches):
            hashes, first = words(texts)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for doc, own_text, a, b in zip(part.column("doc_id").to_pylist(), part.column("_text").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= WINDOW:
                    own = np.unique(window_anchors(hashes[a:b]))
                    marks = np.append(_signed(own), np.int64(_content(hashes[a:b])))
                    for column, value in zip(out, (marks, np.full(len(marks), doc), np.full(len(marks), own_text), np.arange(len(marks)) == len(own)), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return _texts(docs).mapInArrow(run, "anchor long, doc_id long, _text long, whole boolean")


def _chosen(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Starts of the windows whose anchor is in ``known`` (sorted)."""
    own = window_anchors(hashes)
    if not len(known) or not len(own):
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Sorted unsigned arrays of an array<long> column."""
    return [np.sort(x.values.to_numpy().view(np.uint64)) if x.is_valid else np.zeros(0, np.uint64) for x in column]


def candidate_windows(staged: DataFrame) -> DataFrame:
    """(window, doc_id, _text) of the windows with a recurring anchor, once per document."""
    schema = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("_text", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part, texts in pieces(batches):
            hashes, first = words(texts)
            out: list[list[np.ndarray]] = [[], [], []]
            for doc, own_text, known, a, b in zip(part.column("doc_id").to_pylist(), part.column("_text").to_pylist(), _lists(part.column("anchors")), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.unique(windows(hashes[a:b], WINDOW)[_chosen(hashes[a:b], known)])
                for column, value in zip(out, (_signed(own), np.full(len(own), doc), np.full(len(own), own_text)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=schema)

    return staged.select("doc_id", "text", "_text", "anchors").mapInArrow(run, "window long, doc_id long, _text long")


PASSAGE = pa.schema([("passage", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("windows", pa.list_(pa.int64()))])


def first_passages(firsts: DataFrame) -> DataFrame:
    """(passage, doc_id, start, words, windows): runs of neighbouring windows of ``windows`` in the documents
    that hold them first, with each window's hash. ``firsts``: (doc_id, text, _text, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part, texts in pieces(batches):
            hashes, first = words(texts)
            rows: list[tuple] = []
            for doc, text, own_text, known, a, b in zip(part.column("doc_id").to_pylist(), texts, part.column("_text").to_pylist(), _lists(part.column("windows")), first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = windows(hashes[a:b], WINDOW)
                if not len(own) or not len(known):
                    continue
                starts = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
                # Of a window that the document itself repeats only the first copy; periodic texts stay short.
                starts = np.sort(starts[np.unique(own[starts], return_index=True)[1]])
                split = text.split()
                for run_ in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                    if len(run_):
                        s, e = int(run_[0]), int(run_[-1]) + WINDOW
                        name = mix(mix(np.array([own_text], np.int64).view(np.uint64)) + np.array([doc], np.int64).view(np.uint64) * np.uint64(31) + np.uint64(s))
                        rows.append((int(_signed(name)[0]), doc, s, b" ".join(split[s:e]), _signed(own[run_])))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(PASSAGE)], schema=PASSAGE)

    return firsts.select("doc_id", "text", "_text", "windows").mapInArrow(run, "passage long, doc_id long, start int, words binary, windows array<long>")


def _symbols(hashes: np.ndarray) -> str:
    """LETTERS characters per word; different words may share them. The automaton looks through a node's children one by
    one, so each character has few values; those of another place in the word are others, so matches begin with a word."""
    rest, code = hashes % np.uint64(VALUES**LETTERS), np.empty((len(hashes), LETTERS), np.uint32)
    for i in range(LETTERS):
        code[:, i] = rest % np.uint64(VALUES) + np.uint64(1 + VALUES * i)
        rest //= np.uint64(VALUES)
    return code.astype("<u4").tobytes().decode("utf-32-le")


def _covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Mask of the n words that lie in a stretch."""
    edges = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def _cuts(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` in sum, or one entry."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows."""
    order = np.lexsort(columns)
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


def repeated_within(hashes: np.ndarray) -> np.ndarray:
    """Mask of the words under windows that also start further up in the same text."""
    gone = np.zeros(len(hashes), bool)
    own = windows(hashes, WINDOW)
    _, first_at, which = np.unique(own, return_index=True, return_inverse=True)
    source = first_at[which]
    again = np.flatnonzero(source < np.arange(len(own)))
    if len(again):
        for j in range(WINDOW):
            again = again[hashes[again + j] == hashes[source[again] + j]]
        gone = _covered(len(hashes), again, again + WINDOW)
    return gone


class Phrases:
    """An automaton over the blocks of passages: (doc_id, word hashes)."""

    def __init__(self, passages: list[tuple[int, np.ndarray]]):
        self.source = np.array([d for d, _ in passages], np.int64)
        self.size = np.array([len(x) for _, x in passages], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.words = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in passages]])
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, hashes) in enumerate(passages):
            text = _symbols(hashes)
            for q in {*range(0, len(hashes) - BLOCK + 1, BLOCK), len(hashes) - BLOCK}:
                places[text[q * LETTERS : (q + BLOCK) * LETTERS]].append((k, q))
        for i, block in enumerate(places):
            self.automaton.add_word(block, i)
        if places:
            self.automaton.make_automaton()
        #: Passage and place of each block's occurrences, block after block.
        self.place = np.array([x for where in places.values() for x in where], np.int64).reshape(-1, 2)
        self.count = np.array([len(where) for where in places.values()], np.int64)
        self.first = np.cumsum(self.count) - self.count

    def _laid(self, docs: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct (passage, shift, text) of the hits: the passage's word 0 meets word ``shift``."""
        found = np.array(list(self.automaton.iter(_symbols(hashes))), np.int64).reshape(-1, 2)
        end, block = found[:, 0] // LETTERS, found[:, 1]
        text = np.searchsorted(first, end, side="right") - 1
        inside = end - BLOCK + 1 >= first[text]
        end, block, text = end[inside], block[inside], text[inside]
        laid = [np.zeros((3, 0), np.int64)]
        for cut in _cuts(self.count[block], LAID):
            n = self.count[block[cut]]
            k, q = self.place[_ranges(self.first[block[cut]], n)].T
            to = np.repeat(text[cut], n)
            earlier = self.source[k] < docs[to]
            laid.append(np.stack(_distinct(k[earlier], (np.repeat(end[cut] - BLOCK + 1, n) - q)[earlier], to[earlier])))
        return _distinct(*np.concatenate(laid, 1))

    def removed(self, docs: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mask of the words of several texts that a passage of a document with a smaller doc_id covers. Text i has the
        words ``first[i]`` to ``first[i + 1]``."""
        if not len(self.automaton):
            return np.zeros(len(hashes), bool)
        k, shift, text = self._laid(docs, hashes, first)
        low, high = np.maximum(shift, first[text]), np.minimum(shift + self.size[k], first[text + 1])
        starts, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cut in _cuts(high - low, LAID):
            n = high[cut] - low[cut]
            at = _ranges(low[cut], n)
            same = hashes[at] == self.words[at + np.repeat(self.begin[k[cut]] - shift[cut], n)]
            # Where words differ or another passage begins, a stretch ends.
            fresh = np.zeros(len(at) + 1, bool)
            fresh[np.cumsum(n) - n] = fresh[-1] = True
            fresh[1:-1] |= same[1:] != same[:-1]
            edge = np.flatnonzero(fresh)
            whole = same[edge[:-1]] & (np.diff(edge) >= WINDOW)
            starts.append(at[edge[:-1][whole]])
            stops.append(at[edge[1:][whole] - 1] + 1)
        return _covered(len(hashes), np.concatenate(starts), np.concatenate(stops))


KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _stream(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard: its documents through the automaton of its passages."""
    words = Words()
    passages = []
    for batch, raw in pieces(right.to_batches(), "words"):
        hashes, first = words(raw)
        passages += [(d, hashes[a:b]) for d, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
    phrases = Phrases(passages)
    rows = []
    for batch, raw in pieces(left.to_batches()):
        hashes, first = words(raw)
        docs = batch.column("doc_id").to_pylist()
        covered = phrases.removed(np.array(docs, np.int64), hashes, first)
        for doc, text, a, b in zip(docs, raw, first[:-1].tolist(), first[1:].tolist(), strict=True):
            gone = covered[a:b] | repeated_within(hashes[a:b])
            split = text.split()
            kept = [w for w, g in zip(split, gone.tolist(), strict=True) if not g] if gone.any() else split
            rows.append((doc, b" ".join(kept).decode(), b - a, int(gone.sum())))
    return pa.table([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(KEPT)], schema=KEPT)


def _untouched(staged: DataFrame) -> DataFrame:
    """Documents without candidates: their words joined by one space, without what they repeat themselves;
    copies lose all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part, texts in pieces(batches):
            hashes, first = words(texts)
            rows = []
            for doc, text, copy, a, b in zip(part.column("doc_id").to_pylist(), texts, part.column("copy").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                split = (text or b"").split()
                gone = np.full(b - a, True) if copy else repeated_within(hashes[a:b])
                kept = [w for w, g in zip(split, gone.tolist(), strict=True) if not g] if gone.any() else split
                rows.append((doc, b" ".join(kept).decode(), b - a, int(gone.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(KEPT)], schema=KEPT)

    return staged.select("doc_id", "text", "copy").mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def _routes(passages: DataFrame, seen: DataFrame, shard: Column) -> DataFrame:
    """(passage, shard): where a document holds a window of the passage. A window that very many documents hold is
    one row per shard, and has one passage."""
    parts = passages.select("passage", F.explode("windows").alias("window"))
    return parts.join(seen.select("window", shard).distinct(), "window").select("passage", "shard").distinct()


def remove_repeated_passages(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row; text is the kept words joined by one space.
    Intermediate tables go to the shared folder."""
    document = ["doc_id", "_text"]
    marks = materialize(anchors(docs), "anchors")
    same = marks.where("whole").select(F.col("anchor").alias("content"), *document)
    copies = same.join(same.groupBy("content").agg(F.min("doc_id").alias("first")), "content").where("doc_id > first").select(*document).distinct().withColumn("copy", F.lit(True))
    found = marks.where("not whole")
    recurring = found.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    of_doc = found.select("anchor", *document).join(recurring, "anchor").groupBy(*document).agg(F.collect_set("anchor").alias("anchors"))
    info = of_doc.join(copies, document, "full").select(*document, "copy", F.when(F.col("copy").isNull(), F.col("anchors")).alias("anchors"))
    staged = materialize(_hashed(docs).join(info, document, "left").select(*document, "text", F.coalesce("copy", F.lit(False)).alias("copy"), "anchors"), "staged")
    discard(marks)
    candidates = staged.where("anchors is not null and text is not null")

    # Of the texts under a window's smallest id one is enough: none of them precedes the others.
    seen = materialize(candidate_windows(candidates), "windows")
    held = seen.groupBy("window").agg(F.min(F.struct(*document)).alias("first"), F.max("doc_id").alias("last"))
    listed = held.where("first.doc_id < last").groupBy("first.doc_id", "first._text").agg(F.collect_list("window").alias("windows"))
    passages = materialize(first_passages(candidates.select(*document, "text").join(listed, document)), "passages")

    size = candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    shard = F.pmod(F.xxhash64(*document), F.lit(shards)).cast("int").alias("shard")
    needed = materialize(_routes(passages, seen, shard), "routes")
    discard(seen)
    routed = passages.select("passage", "doc_id", "words").join(needed, "passage")
    left = candidates.select("doc_id", "text", shard).groupBy("shard")
    right = routed.select("doc_id", "words", "shard").groupBy("shard")
    touched = left.cogroup(right).applyInArrow(_stream, "doc_id long, text string, n_words long, n_removed long")
    return touched.unionByName(_untouched(staged.where("anchors is null or text is null")))
