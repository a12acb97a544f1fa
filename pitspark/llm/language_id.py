"""Language identification of words and texts by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and whether it is in a language's lexicon (the
frequent words of that language's training texts), hashed into a fixed number of buckets; transitions between
the languages of neighbouring words are learned with them. Training sequences are made of stretches from
texts of different languages, so the field sees switches. Forward-backward gives each word's probability of
each language; a text's language is the one with the largest expected number of words, and its score the
share of that number.

Forward-backward runs over many texts at once: the words of a batch are one chain, in which a text's first
word forgets what came before. The chain is cut into equal blocks; their transfer matrices are multiplied
side by side, one short scan joins the blocks, and the words inside are filled in side by side.

A run of more than ``LONGEST`` letters, as in scripts without spaces, counts as several words: consecutive
stretches of that many letters, each with its own affixes.

A null text, and one without a letter, is "und" with score 0. Rows are independent; an empty table gives an
empty one; with no labelled text every row is "und". The model is fitted on a sample of at most about
``ROWS_PER_LANGUAGE`` documents of each language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import docs_only, mix, pieces
from pitspark.llm.sampling import thinned

ROWS_PER_LANGUAGE = 250
LEXICON = 400
BUCKETS = 1 << 15
BLOCK = 64
CACHE = 300_000
LONGEST = 64
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; those of more than LONGEST are cut into consecutive stretches of that length."""
    words = _WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in words):
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


@dataclass
class Field:
    languages: list[str]
    lexicon: dict[str, list[int]]
    weights: np.ndarray  # (buckets, languages)
    moves: np.ndarray  # (languages, languages)
    start: np.ndarray


def features(words: list[str], lexicon: dict[str, list[int]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of many distinct words: (ids in word order, where each word's ids begin)."""
    framed = [f"^{w}$" for w in words]
    chars = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in framed])
    end = np.cumsum(size)
    begin, word = end - size, np.repeat(np.arange(len(words)), size)

    def named(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), np.uint64(kind))
        for x in parts:
            h = mix(h * np.uint64(31) + x)
        return (h % np.uint64(buckets)).astype(np.int64)

    def at(index: np.ndarray) -> np.ndarray:
        """Characters, 0 outside a word's own."""
        return np.where((index > begin) & (index < end - 1), chars[np.clip(index, 0, len(chars) - 1)], np.uint64(0))

    two, three = np.flatnonzero(word[:-1] == word[1:]), np.flatnonzero(word[:-2] == word[2:])
    ids = [named(2, chars[two], chars[two + 1]), named(3, chars[three], chars[three + 1], chars[three + 2])]
    owner = [word[two], word[three]]
    for n in (1, 2, 3):
        ids += [named(10 + n, *(at(begin + 1 + i) for i in range(n))), named(20 + n, *(at(end - 1 - n + i) for i in range(n)))]
        owner += [np.arange(len(words))] * 2
    listed = [(i, k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    if listed:
        ids.append(named(30, np.array([k for _, k in listed], np.uint64)))
        owner.append(np.array([i for i, _ in listed]))
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(ids)[order], np.searchsorted(owners[order], np.arange(len(words)))


def _marginals(emit: np.ndarray, moves: np.ndarray, start: np.ndarray, resets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """P(language of word) along one chain; ``emit`` are positive factors, ``resets`` marks first words."""
    n, k = emit.shape
    blocks = -(-n // block)
    pad = blocks * block - n
    e = np.concatenate((emit, np.full((pad, k), 1.0 / k))).reshape(blocks, block, k)
    r = np.concatenate((resets, np.ones(pad, bool))).reshape(blocks, block)
    firsts = [np.flatnonzero(r[:, t]) for t in range(block)]
    e, started = np.ascontiguousarray(e.transpose(1, 0, 2)), start / start.sum()

    def into(x: np.ndarray, t: int) -> np.ndarray:
        """Row vectors (or matrices) taken over the step into word t of each block. Factors are at least
        e^-30, so scaling on every eighth step keeps doubles in range."""
        went = (x.reshape(-1, k) @ moves).reshape(x.shape)
        if len(firsts[t]):
            went[firsts[t]] = x[firsts[t]].sum(-1, keepdims=True) * started
        went *= e[t] if x.ndim == 2 else e[t][:, None, :]
        return went if t % 8 else went / went.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

    transfer = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(block):
        transfer = into(transfer, t)
    transfer = transfer / transfer.sum((1, 2), keepdims=True)
    enter, leave = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1.0 / k)
    for b in range(blocks):
        enter[b] = v
        v = v @ transfer[b]
        v = v / v.sum()
    v = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        leave[b] = v
        v = transfer[b] @ v
        v = v / v.sum()
    ahead = np.empty((block, blocks, k))
    for t in range(block):
        enter = ahead[t] = into(enter, t)
    for t in range(block - 1, -1, -1):
        ahead[t] *= leave
        back = leave * e[t]
        leave = back @ moves.T
        if len(firsts[t]):
            leave[firsts[t]] = (back[firsts[t]] @ started)[:, None]
        if t % 8 == 0:
            leave = leave / leave.sum(1, keepdims=True)
    p = ahead.transpose(1, 0, 2).reshape(-1, k)[:n]
    return p / p.sum(1, keepdims=True)


class Tagger:
    """The field with its words' factors remembered, for up to CACHE words at a time."""

    def __init__(self, field: Field):
        self.field = field
        self.index: dict[str, int] = {}
        self.factors = np.empty((1024, len(field.languages)))

    def _learn(self, words: list[str]) -> None:
        """Factors of new words, all at once."""
        at = len(self.index)
        while at + len(words) > len(self.factors):
            self.factors = np.concatenate((self.factors, np.empty_like(self.factors)))
        ids, begins = features(words, self.field.lexicon, len(self.field.weights))
        score = np.add.reduceat(self.field.weights[ids], begins)
        self.factors[at : at + len(words)] = np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0))
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        """For the words of all texts, one after the other."""
        if len(self.index) > CACHE:
            self.index.clear()
        index = self.index
        if new := sorted({w for words in texts for w in words if w not in index}):
            self._learn(new)
        total = sum(map(len, texts))
        ids = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64, total)
        resets = np.zeros(total, bool)
        begins = np.cumsum([0, *map(len, texts)])[:-1]
        resets[begins[begins < total]] = True
        return _marginals(self.factors[ids], self.field.moves, self.field.start, resets) if total else np.zeros((0, len(self.field.languages)))


def train(rows: list[tuple[str, str]], seed: int = 5, length: int = 64, width: int = 32, steps: int = 250, rate: float = 0.15, buckets: int = BUCKETS) -> Field | None:
    """``rows``: (language, text). Each step takes ``width`` sequences of ``length`` words, cut together
    from stretches of 4 to 40 words, and follows the log-likelihood's gradient."""
    languages = sorted({lang for lang, _ in rows})
    words = {k: [w for w in (words_of(t) for lang, t in rows if lang == k) if w] for k in languages}
    languages = [k for k in languages if words[k]]
    if not languages:
        return None
    n = len(languages)
    lexicon: dict[str, list[int]] = {}
    for i, k in enumerate(languages):
        often = Counter(w for text in words[k] for w in text)
        for w, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    rng = np.random.default_rng(seed)
    weights, moves, start = np.zeros((buckets, n)), np.eye(n), np.zeros(n)
    seen = [np.full(x.shape, 1e-6) for x in (weights, moves, start)]
    every = sorted({w for texts in words.values() for text in texts for w in text})
    number = {w: i for i, w in enumerate(every)}
    flat, first_id = features(every, lexicon, buckets)
    n_ids = np.diff(np.append(first_id, len(flat)))
    for _ in range(steps):
        tokens, truth = [], np.empty((width, length), np.int64)
        for s in range(width):
            sequence: list[str] = []
            while len(sequence) < length:
                lang = int(rng.integers(n))
                text = words[languages[lang]][int(rng.integers(len(words[languages[lang]])))]
                size, at = int(rng.integers(4, 41)), int(rng.integers(len(text)))
                stretch = text[at : at + size][: length - len(sequence)]
                truth[s, len(sequence) : len(sequence) + len(stretch)] = lang
                sequence += stretch
            tokens += sequence
        which = np.array([number[w] for w in tokens])
        sizes = n_ids[which]
        begins = np.cumsum(sizes) - sizes
        ids = flat[np.arange(sizes.sum()) + np.repeat(first_id[which] - begins, sizes)]
        score = np.add.reduceat(weights[ids], begins).reshape(width, length, n)
        # Forward-backward with pair marginals, all sequences side by side.
        e, a, first = np.exp(score - score.max(2, keepdims=True)), np.exp(moves), np.exp(start)
        ahead, back = np.empty_like(e), np.ones_like(e)
        for t in range(length):
            x = (first if t == 0 else ahead[:, t - 1] @ a) * e[:, t]
            ahead[:, t] = x / x.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            x = (back[:, t + 1] * e[:, t + 1]) @ a.T
            back[:, t] = x / x.sum(1, keepdims=True)
        p = ahead * back
        p /= p.sum(2, keepdims=True)
        pair = ahead[:, :-1, :, None] * a * (back[:, 1:] * e[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        hit = np.eye(n)[truth]
        miss = (p - hit) / width
        grad_moves = (pair - hit[:, :-1, :, None] * hit[:, 1:, None, :]).sum((0, 1)) / width
        grads = [np.zeros_like(weights), grad_moves, miss[:, 0].sum(0)]
        each = np.repeat(miss.reshape(-1, n), sizes, axis=0)
        for i in range(n):
            grads[0][:, i] = np.bincount(ids, each[:, i], buckets)
        for x, s, g in zip((weights, moves, start), seen, grads, strict=True):
            s += g * g
            x -= rate * g / np.sqrt(s)
    return Field(languages, lexicon, weights, np.exp(moves - moves.max()), np.exp(start - start.max()))


def fit(docs: DataFrame, learn: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Field | None:
    """Learns from text and lang of the rows with ``learn``, a sample of each language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learn).where("text is not null and lang is not null and doc_id is not null")
    languages = [r.lang for r in known.select("lang").distinct().collect()]
    rows = thinned(known, "lang", dict.fromkeys(languages, rows_per_language), seed=5).toArrow()
    triples = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True))
    return train([(lang, text) for _, lang, text in triples])


def _texts(texts: list[bytes | None]) -> list[list[str]]:
    """Words of each text; none for a text without a letter."""
    decoded = [(t or b"").decode() for t in texts]
    return [words_of(t) if any(map(str.isalpha, t)) else [] for t in decoded]


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    docs = docs_only(docs)
    if field is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        names = shared.value.languages
        for part, raw in pieces(batches):
            texts = _texts(raw)
            p = tagger.marginals(texts)
            sums = np.concatenate((np.zeros((1, len(names))), np.cumsum(p, 0)))
            ends = np.cumsum([len(w) for w in texts])
            counts = sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
            best = counts.argmax(1)
            sizes = np.array([len(w) for w in texts])
            score = np.where(sizes > 0, np.clip(counts.max(1) / np.maximum(sizes, 1), 0, 1), 0.0)
            said = [names[b] if size else UNKNOWN for b, size in zip(best.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(said, pa.string()), pa.array(score)], schema=PREDICTED)

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, words, langs): every word of a text, lower-cased, with its most probable language."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        names = np.array(shared.value.languages, object)
        for part, raw in pieces(batches):
            texts = _texts(raw)
            said = names[tagger.marginals(texts).argmax(1)]
            ends = np.cumsum([len(w) for w in texts])
            langs = [said[e - len(w) : e].tolist() for w, e in zip(texts, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.list_(pa.string())), pa.array(langs, pa.list_(pa.string()))], schema=schema)

    return docs_only(docs).mapInArrow(run, "doc_id long, words array<string>, langs array<string>")
