"""Phrases that many documents have: they make no candidates of the near-duplicate join, and no link is lost for that."""

import random

import numpy as np
import pytest

from pitspark.llm import ngram_join
from test_operators import DOCS, as_rows, brute_components


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("num", [90, 80, 60])
def test_similar_sets_share_a_signature_whatever_is_frequent(num, share):
    rng = np.random.default_rng(num)
    sign, frequent = ngram_join.PartEnum(num, 100), rng.random(1 << 10) < share
    for size in [1, 2, 3, 5, 9, 11, 20, 27, 40, 60, 150, 400]:
        for _ in range(8):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            out = rng.integers(0, size * (100 - num) // 100 + 1)
            y = np.unique(np.concatenate((x[out:], rng.integers(0, 2**63, rng.integers(0, 4 + size // 8), dtype=np.uint64))))
            common = len(np.intersect1d(x, y))
            if 100 * common >= num * (len(x) + len(y) - common) and not np.array_equal(x, y):
                signed, owner = sign.together([x, y], frequent=frequent)
                assert len(np.intersect1d(signed[owner == 0], signed[owner == 1])), (size, len(y), common)


def texts_with_phrases(n: int) -> list[tuple[int, str]]:
    """Texts of random words with two of three phrases each; every twentieth is a near copy of the one before."""
    rng = random.Random(n)
    phrases = [" ".join(f"p{k}_{i}" for i in range(8)) for k in range(3)]
    rows, words = [], []
    for i in range(n):
        if i % 20 != 19:
            words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
            for p in rng.sample(phrases, 2):
                words.insert(rng.randrange(len(words)), p)
        else:
            words = [*words[:-1], f"w{rng.randrange(10**6)}"]
        rows.append((i, " ".join(words)))
    return rows


def test_a_frequent_phrase_makes_no_candidates(spark, monkeypatch):
    compared, left_over = [], []
    true_verified, true_elements = ngram_join.verified, ngram_join.set_elements

    def elements(texts, n):
        left_over.append(texts.count())
        return true_elements(texts, n)

    monkeypatch.setattr(ngram_join, "verified", lambda x, *more: compared.append(x.count()) or true_verified(x, *more))
    monkeypatch.setattr(ngram_join, "set_elements", elements)
    rows = texts_with_phrases(800)
    got = ngram_join.link_documents(spark.createDataFrame(rows, DOCS), 5, 80, 100)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, 5, 80, 100)
    # 40 near copies; the last elements are those of the large groups that are compared across components.
    assert sum(compared) <= 60 and left_over[-1] <= 40


@pytest.mark.parametrize("share", [0.3, 0.9])
def test_texts_of_frequent_phrases_are_linked_as_brute_force_does(spark, share):
    rng = random.Random(6)
    phrases = [" ".join(f"p{k}_{i}" for i in range(rng.randrange(6, 12))) for k in range(12)]
    rows = [(i, " ".join(rng.choice(phrases) if rng.random() < share else f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 8, 9, 30])))) for i in range(200)]
    for i in range(200, 300):
        words = rows[rng.randrange(i)][1].split()
        words[rng.randrange(len(words))] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = ngram_join.link_documents(spark.createDataFrame(rows, DOCS), 3, 80, 100)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, 3, 80, 100)
