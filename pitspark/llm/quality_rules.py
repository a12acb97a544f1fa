"""Quality rules as a short-circuit cascade.

A rule is a cheap or dear test of one text that says "reject". On a bounded sample every rule is run on
every text and timed. The cascade then applies the rules in the order of rejections per second, and a text
that one rule rejects meets no later rule. The order decides the cost only: the verdict is that of all
rules together, so it doesn't depend on the sample or the clock.

Null and empty texts have no words; the base rule rejects them. Rows are independent, so ties, repeats and
null ids need nothing special; an empty table gives an empty one."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import SPACE, docs_only, pieces

SAMPLE_ROWS = 2_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_NO_LETTER = bytes(b for b in range(128) if b not in SPACE and not chr(b).isalpha())


class Text:
    """One text with the counts that rules use, each computed when first asked for."""

    def __init__(self, text: bytes | None):
        self.raw = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, SPACE).decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(*(w[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) == len(grams):
            return 0
        times, covered, upto = Counter(grams), 0, 0
        for i, g in enumerate(grams):
            if times[g] > 1:
                covered += i + WINDOW - max(upto, i)
                upto = i + WINDOW
        return covered


Rule = tuple[str, Callable[[Text], bool]]


def too_few_words(t: Text) -> bool:
    return t.n_words < 10


def repeats_itself(t: Text) -> bool:
    return 100 * t.n_repeat_words > 20 * t.n_words


def many_symbols(t: Text) -> bool:
    return 10 * t.n_symbols > 3 * t.n_words


def many_exclamations(t: Text) -> bool:
    return 10 * t.raw.count(b"!") > 3 * t.n_words


def shouting(t: Text) -> bool:
    upper = len(t.raw) - len(t.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(t.raw) - len(t.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower


def repeated_lines(t: Text) -> bool:
    return 2 * t.n_dup_lines > len(t.lines)


def odd_word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 20 * t.n_words


def few_letters(t: Text) -> bool:
    """Fewer than half of the words have a letter A-Z, a-z or a character outside ASCII."""
    return 2 * len(t.raw.translate(None, _NO_LETTER).split()) < t.n_words


def stammering(t: Text) -> bool:
    """Every third word or more repeats the one before it."""
    return 3 * sum(a == b for a, b in zip(t.words, t.words[1:], strict=False)) > t.n_words


BASE: list[Rule] = [("too_few_words", too_few_words), ("repeats_itself", repeats_itself)]
RULES: list[Rule] = [
    ("many_symbols", many_symbols), ("many_exclamations", many_exclamations), ("shouting", shouting), ("repeated_lines", repeated_lines),
    ("odd_word_length", odd_word_length), ("few_letters", few_letters), ("stammering", stammering),
]


def measure(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds a text and share rejected of each rule, on a sample of about ``sample_rows`` documents
    picked by a hash of their id."""
    total = docs.count()
    rate = min(1.0, sample_rows / total) if total else 1.0
    picked = docs_only(docs).where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            for name, rule in rules:
                began, rejected = time.perf_counter(), 0
                for t in texts:
                    rejected += rule(Text(t))
                yield pa.RecordBatch.from_pydict({"rule": [name], "s": [time.perf_counter() - began], "n": [len(texts)], "rejected": [rejected]})

    rows = picked.mapInArrow(run, "rule string, s double, n long, rejected long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("rejected").alias("r"))
    return {x.rule: (x.s / x.n, x.r / x.n) for x in rows.collect() if x.n}


def order_rules(rules: Sequence[Rule], figures: dict[str, tuple[float, float]]) -> list[Rule]:
    """Most rejections per second first; rules without figures keep their place at the end."""

    def worth(rule: Rule) -> float:
        cost, rejects = figures.get(rule[0], (1.0, 0.0))
        return rejects / max(cost, 1e-9)

    return sorted(rules, key=worth, reverse=True)


def first_rejection(text: Text, rules: Sequence[Rule]) -> str | None:
    return next((name for name, rule in rules if rule(text)), None)


JUDGED = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("rejected_by", pa.string()), ("kept", pa.bool_()),
])


def judge(docs: DataFrame, rules: Sequence[Rule] = tuple(RULES), base: Sequence[Rule] = tuple(BASE), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base counts, whether a base rule failed, the first rule that rejected
    it in the cascade's order, and the verdict. The order of ``rejected_by`` follows measured cost."""
    cascade = order_rules(rules, measure(docs, rules, sample_rows))
    base = list(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            out: list[list] = [[] for _ in range(8)]
            for raw in texts:
                t = Text(raw)
                failed = first_rejection(t, base)
                by = failed or first_rejection(t, cascade)
                for column, value in zip(out, (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed is not None, by, by is None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(out, list(JUDGED)[1:], strict=True))], schema=JUDGED)

    return docs_only(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, rejected_by string, kept boolean")
