"""Periodic runs against the definition, the transforms against whole-number sums, the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from pitspark.llm import periodic_runs, queries
from pitspark.llm.batches import mix

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """(start, length, period) of maximal stretches, by comparing every word with the one q further on."""
    n, smallest = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                smallest.setdefault((i, j + q), q)
            i = max(i, j) + 1
    return sorted((a, e - a, q) for (a, e), q in smallest.items())


def some_words(rng):
    n, k, kind = rng.randint(0, rng.choice([15, 60, 250])), rng.choice([1, 2, 3, 6]), rng.random()
    words = [rng.randrange(k) for _ in range(n)]
    if kind < 0.4 and n > 4:
        unit = words[: rng.randint(1, max(1, n // 3))]
        return words[len(unit) : len(unit) + 5] + unit * rng.randint(2, 6) + unit[: rng.randint(0, len(unit))] + words[: rng.randint(0, 9)]
    if kind > 0.9:  # the word with most repetitions
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    return words


def runs_of_texts(texts):
    values = mix(np.array([x for t in texts for x in t], np.uint64) + np.uint64(9))
    found = periodic_runs.runs_of(values, np.cumsum([0] + [len(t) for t in texts]))
    return [[tuple(r[1:]) for r in found.tolist() if r[0] == i] for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(250):
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        assert runs_of_texts(texts) == [brute_runs(t) for t in texts]


def test_sections_of_large_windows(monkeypatch):
    """With a small CAP the first words of a block stand for it and windows come in sections."""
    monkeypatch.setattr(periodic_runs, "CAP", 4)
    rng = random.Random(8)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(3)]
        assert runs_of_texts(texts) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("size", [8, 64, 128, 256, 2048, 16384])
def test_transform_round_trip_and_products(size):
    turn, rng = periodic_runs.Transform(size), np.random.default_rng(size)
    a, b = rng.integers(0, 40, (2, size)), rng.integers(0, 40, (2, size))
    a[:, size // 4 :] = 0
    back = turn.inverse(turn.forward(a.astype(float)))
    assert np.array_equal(np.mod(back, periodic_runs.P), a)
    got = np.mod(turn.inverse(periodic_runs._mod(turn.forward(a.astype(float)) * turn.forward(b.astype(float)))), periodic_runs.P)
    want = [sum(int(a[0, j]) * int(b[0, (i - j) % size]) for j in range(size // 4)) for i in range(0, size, max(1, size // 16))]
    assert got[0, :: max(1, size // 16)].astype(int).tolist() == [w % periodic_runs.P for w in want]


def test_zero_mismatches_are_all_occurrences():
    rng = np.random.default_rng(3)
    for length in (2, 8, 64):
        symbols = rng.integers(0, 2 if length < 8 else 40, 900)
        symbols[300:600] = symbols[100:400]
        blocks = np.arange(0, 500, length)
        got = set(zip(*(x.tolist() for x in periodic_runs.zero_mismatches(symbols, blocks, length, 2 * length - 1, 2 * length)), strict=True))
        want = {(k, q) for k, x in enumerate(blocks) for q in range(2 * length - 1, 4 * length - 1) if (symbols[x : x + length] == symbols[x + q : x + q + length]).all()}
        assert got == want


def test_wrong_hashes_are_put_right():
    words = [b"a", b"b"] * 10 + [b"x"]
    false = np.array([[0, 21, 2]])  # as if x and a had the same hash
    assert periodic_runs.confirmed_runs(false, words).tolist() == [[0, 20, 2]]


def test_stretch_word_by_word():
    s = periodic_runs.Stretches(np.array([5, 1, 2, 1, 2, 1, 7], np.uint64))
    assert s.exactly(2, 2, 0, 7) == (1, 4)
    assert [int(x[0]) for x in s.around(np.array([2]), np.array([2]), np.array([0]), np.array([7]))] == [1, 4]


@pytest.mark.parametrize("make", [lambda i: 0, lambda i: i % 7, lambda i: bin(i).count("1") % 2, lambda i: i % 30_000])
def test_long_periodic_texts_stay_near_linear(make):
    values = mix(np.array([make(i) for i in range(120_000)], np.uint64))
    start = time.process_time()
    periodic_runs.runs_of(values, np.array([0, len(values)]))
    assert time.process_time() - start < 40


def digests(doc, text):
    words = (text or "").split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def as_tuples(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def test_query_matches_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r[0]: r for r in as_tuples(queries.QUERIES["op11_periodic_runs"](spark, SF))}
    short = [(d, t) for d, t in docs if len((t or "").split()) < 900]
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[d] == digests(d, t) for d, t in short)


def test_operator_on_odd_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a " * 40, "é ß é ß " * 9, "x" * 100_000, "one two three\n" * 3 + "end"] + [" ".join(f"w{x}" for x in some_words(rng)) for _ in range(40)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[3], "x", 1), (4, texts[4], "x", 1), (30, texts[5], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = queries._run_digests(periodic_runs.find_runs(queries._with_periods(docs)))
    assert as_tuples(got) == sorted((digests(d, t) for d, t, *_ in rows), key=str)
    kept = {r.doc_id: r.collapsed for r in periodic_runs.find_runs(docs).collect()}
    assert kept[0] == "" and kept[3] == "a" and kept[4] == "é ß"
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
