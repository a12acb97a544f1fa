"""What op11 leaves out before its transforms: blocks that cannot have a seed, a second scan, words of texts without runs."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pitspark.llm import periodic_runs, queries
from pitspark.llm.batches import mix
from tests.llm.test_periodic_runs import SF, brute_runs


def runs_and_blocks(monkeypatch, words):
    """The runs of a text of numbers as (start, length, period), and the blocks that transforms are made of, as
    (start, length)."""
    laid, plain = [], periodic_runs.zero_mismatches

    def noted(symbols, blocks, length, *rest):
        laid.extend((x, length) for x in blocks.tolist())
        return plain(symbols, blocks, length, *rest)

    monkeypatch.setattr(periodic_runs, "zero_mismatches", noted)
    found = periodic_runs.runs_of(mix(np.array(words, np.uint64)), np.array([0, len(words)]))
    monkeypatch.setattr(periodic_runs, "zero_mismatches", plain)
    return [tuple(r[1:]) for r in found.tolist()], laid


def test_only_blocks_of_recurring_words_are_transformed(monkeypatch):
    words = [*range(3000), *[3000 + i % 50 for i in range(200)], *range(4000, 6000)]
    runs, laid = runs_and_blocks(monkeypatch, words)
    assert runs == [(3000, 200, 50)] == brute_runs(words)
    assert 0 < len(laid) < 100 and all(2900 < x < 3200 for x, _ in laid)


@pytest.mark.parametrize(("period", "lengths"), [(1, {2}), (3, {2, 4})])
def test_blocks_of_a_known_run_are_not_transformed_again(monkeypatch, period, lengths):
    words = [i % period for i in range(4096)]
    runs, laid = runs_and_blocks(monkeypatch, words)
    assert runs == [(0, 4096, period)]
    assert {length for _, length in laid} == lengths


def test_windows_take_remainders_of_numbers_of_any_size():
    """Remainders are taken of the words in windows alone, so whole 64-bit hashes go in."""
    numbers = mix(np.arange(900, dtype=np.uint64) % 130)
    for length, nearest in ((2, 1), (8, 15), (64, 127)):
        blocks = np.arange(0, 500, length)
        got = set(zip(*(x.tolist() for x in periodic_runs.zero_mismatches(numbers, blocks, length, nearest, 2 * length)), strict=True))
        assert got == {(k, 130) for k in range(len(blocks)) if nearest <= 130 < nearest + 2 * length}


def test_recurrence_is_never_farther_than_the_next_occurrence():
    rng = random.Random(5)
    for high in (3, 40, 1 << 40):
        words = [rng.randrange(high) * rng.choice([1, 1 << 16]) for _ in range(400)]
        near = periodic_runs.recurrence(np.array(words, np.uint64))
        for i, w in enumerate(words):
            assert 0 < near[i] <= (words.index(w, i + 1) - i if w in words[i + 1 :] else len(words))


def test_distinct_rows_and_their_first_places():
    rows = np.array([[2, 0, 1], [1, 9, 9], [2, 0, 1], [1, 8, 9], [1, 9, 9]])
    ordered, first = periodic_runs.distinct(rows)
    assert ordered.tolist() == [[1, 8, 9], [1, 9, 9], [2, 0, 1]] and first.tolist() == [3, 1, 0]
    assert [len(x) for x in periodic_runs.distinct(np.zeros((0, 3), np.int64))] == [0, 0]


def test_single_spaced_texts_are_their_words():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("abé  \x1c\x85 \t\n\x0b\x0c\r  ") for _ in range(rng.randint(0, 30))).encode()
        assert periodic_runs.single_spaced(text) == b" ".join(text.split())


def test_documents_are_scanned_once(spark):
    plan = queries.QUERIES["op11_periodic_runs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_only_every_tenth_text_with_words_is_changed(spark):
    tenth = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    other = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    texts = [None, "", " \n ", "a  b\tc\n"]
    rows = [(doc, t) for doc in (tenth, other, None) for t in texts]
    got = [tuple(r) for r in queries._with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    (changed,) = set(got) - set(rows)
    assert changed[0] == tenth and len(changed[1].split(" ")) == 3 and set(changed[1].split(" ")) <= {"a", "b", "c"}
    assert sorted(set(got) - {changed}, key=str) == sorted(set(rows) - {(tenth, texts[3])}, key=str) and len(got) == len(rows)
