"""The labelled url table and the regression: unseen hosts, unseen words, and a plain loop over the same steps."""

from __future__ import annotations

import math
import zlib

import numpy as np

from pitspark.llm import url_filter as u


def p_block(model, url):
    weights, bias = model
    x = u.ngrams(*u._split(url))
    return 1 / (1 + math.exp(-(weights[x].sum() / math.sqrt(max(len(x), 1)) + bias)))


def shares(model, hosts):
    return np.mean([p_block(model, url) >= 0.5 for url in u.urls_of(hosts)])


def test_table_is_large_and_balanced():
    table = u.default_table()
    assert 400 <= len(table) <= 900 and 0.4 < np.mean([label for _, label in table]) < 0.6
    assert len({url for url, _ in table}) == len(table)


def test_unseen_names_of_known_words():
    """Pairs of words that the table doesn't pair."""
    model = u.train(u.default_table())
    pairs = lambda words: [f"{w}{words[(i + 31) % len(words)]}" for i, w in enumerate(words)]
    assert not {*pairs(u.UNWANTED_WORDS)} & {h.replace("-", "") for h in u.hosts_of(u.UNWANTED_WORDS)}
    assert shares(model, pairs(u.UNWANTED_WORDS)) > 0.97 and shares(model, pairs(u.ORDINARY_WORDS)) < 0.03


def test_names_with_one_unseen_word():
    """Every fifth word is left out of the table and then joined with a known one."""
    held = lambda words, k: [w for i, w in enumerate(words) if (i % 5 == k)]
    blocked, wrong = [], []
    for k in range(5):
        rows = [(url, label) for label, words in ((1, u.UNWANTED_WORDS), (0, u.ORDINARY_WORDS)) for url in u.urls_of(u.hosts_of([w for w in words if w not in held(words, k)]))]
        model = u.train(rows)
        mixed = lambda words, k=k: [f"{w}-{words[(i * 5 + 1 + k) % len(words)]}" for i, w in enumerate(held(words, k))]
        blocked.append(shares(model, mixed(u.UNWANTED_WORDS)))
        wrong.append(shares(model, mixed(u.ORDINARY_WORDS)))
    print("one unseen word: blocked", np.mean(blocked), "ordinary blocked", np.mean(wrong))
    assert np.mean(blocked) > 0.8 and np.mean(wrong) < 0.2


def test_training_matches_a_plain_loop():
    table, buckets = u.default_table()[::40], 512
    weights, bias = u.train(table, buckets, rounds=3)
    w, seen, b, seen_b = [0.0] * buckets, [1e-8] * buckets, 0.0, 1e-8
    rows = []
    for url, label in table:
        host, path = u._split(url)
        x = set()
        for space, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
            for k in (3, 4, 5):
                for i in range(len(part) - k + 1):
                    if len(part) > 2:
                        x.add(zlib.crc32((space + part[i : i + k]).encode()) % buckets)
        rows.append((sorted(x), label))
    for _ in range(3):
        for i in sorted(range(len(rows)), key=lambda i: zlib.crc32(str(i).encode())):
            x, label = rows[i]
            scale = 1 / math.sqrt(len(x))
            error = 1 / (1 + math.exp(-(sum(w[j] for j in x) * scale + b))) - label
            for j in x:
                g = error * scale + 1e-4 * w[j]
                seen[j] += g * g
                w[j] -= 0.5 * g / math.sqrt(seen[j])
            seen_b += error * error
            b -= 0.5 * error / math.sqrt(seen_b)
    assert np.allclose(weights, w) and math.isclose(bias, b, rel_tol=1e-9)
