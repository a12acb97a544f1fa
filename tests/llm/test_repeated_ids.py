"""Ids that several texts share."""

import random

import pytest

from pitspark.llm import substring_dedup
from test_operators import DOCS, as_rows, brute_passages


@pytest.mark.parametrize("shard_bytes", [300, 8 << 20])
def test_substring_dedup_of_ids_with_several_texts(spark, shard_bytes):
    rng = random.Random(4)
    some = [" ".join(f"w{rng.randrange(400)}" for _ in range(50)) for _ in range(12)]
    rows = [(1, some[0]), (2, some[0]), (2, some[1]), (2, f"{some[2]} {some[3]}"), (2, f"x {some[3]} {some[4]}"), (2, f"{some[4]} y {some[4]}")]
    rows += [(3, f"{some[3]} {some[5]}"), (3, f"z {some[5]} {some[4]}"), (3, f"{some[6]} {some[6]} q {some[6]}"), (3, some[1]), (3, some[1])]
    rows += [(4, f"{some[7]} {some[8]}"), (4, f"{some[8]} {some[7]}"), (4, "  ".join(some[7].split())), (4, some[7]), (5, f"{some[6]} {some[9]}")]
    for _ in range(40):
        rows.append((rng.randrange(6, 14), " ".join(rng.choice(some)[rng.randrange(60) :] for _ in range(rng.randint(1, 4)))))
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, DOCS), shard_bytes)
    assert as_rows(got, "doc_id", "text", "n_words", "n_removed") == brute_passages(rows)


def test_substring_dedup_inside_rows_without_id(spark):
    once, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(None, f"{once} {other} {once}"), (None, once), (1, other), (None, other), (2, f"{once} end")]
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, DOCS))
    want = [(None, f"{once} {other}", 90, 30), (None, once, 30, 0), (1, other, 30, 0), (None, other, 30, 0), (2, f"{once} end", 31, 0)]
    assert as_rows(got, "doc_id", "text", "n_words", "n_removed") == sorted(want, key=str)
