"""Source divergence against plain Python, with ties, zero cells, empty groups and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from pitspark.llm import source_divergence

SCHEMA = "text string, lang string, source string, n int, term string, value string"


def brute(rows, min_docs, top):
    total, docs, by_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        by_group[lang, source].update(words)
        total[lang].update(words)
        docs[lang].update(set(words))
    out = []
    for (lang, source), n in by_group.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        share = lambda counts, t, kept=kept: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept))
        found = {"pair": [(sum(abs(share(n, t) - share(m, t)) for t in kept), other) for (g, other), m in by_group.items() if g == lang and other != source]}
        found["term"] = [(share(n, t) - share(total[lang], t), t) for t in kept if n[t] and share(n, t) > share(total[lang], t)]
        for part, values in found.items():
            order = sorted(values, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(order, 1) if part == "pair" or rank <= top]
    return sorted(out)


def some_rows(seed):
    rng = random.Random(seed)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "xyzé日"] + ["The", "the", "É", "ß"]
    rows = []
    for _ in range(rng.randint(40, 160)):
        source = rng.choice(["big", "big", "big", "s1", "s2", "é", None])
        text = " ".join(rng.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=rng.randint(0, 30)))
        rows.append((text, rng.choice(["en", "de", None]), source, 1, "t", "v"))
    rows += [(None, "en", "null text"), ("", "en", "empty"), ("1 2 3", "xx", "no term"), ("1", "xx", "none either"), ("alone", "yy", "alone"), (("the quick " * 20_000), "en", "long")]
    rows = [(*r, 1, "t", "v") if len(r) == 3 else r for r in rows]
    return rows + rows[:5]


@pytest.mark.parametrize("seed, min_docs, top", [(1, 2, 50), (2, 5, 3), (3, 1, 4), (4, 10_000, 50), (5, 3, 1)])
def test_audit_matches_plain_python(spark, seed, min_docs, top):
    rows = some_rows(seed)
    got = source_divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs, top)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == brute(rows, min_docs, top)


def test_equal_values_are_in_utf8_order_and_cut_at_top(spark):
    rows = [(" ".join(f"t{c}" for c in "bédaxcz日"), "en", "one")] * 2 + [("zz " * 30, "en", "two")] * 2
    rows = [(*r, 1, "t", "v") for r in rows]
    got = source_divergence.audit(spark.createDataFrame(rows, SCHEMA), 2, 5).where("part = 'term' and source = 'one'").orderBy("rank").collect()
    assert [r.item for r in got] == ["ta", "tb", "tc", "td", "tx"] and len({r.value for r in got}) == 1


def test_counts_are_handed_on_whole(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD", 5)
    rows = some_rows(7)
    assert sorted(map(tuple, source_divergence.audit(spark.createDataFrame(rows, SCHEMA), 2, 50).collect())) == brute(rows, 2, 50)


def test_large_counts_stay_whole(spark):
    df = spark.createDataFrame([(10**15 + 7, 3 * 10**17 + 1, 10**6), (0, 0, 0)], "a long, t long, v long")
    got = [r[0] for r in df.select(source_divergence.share("a", "t", "v")).collect()]
    assert got == [1 + 10**9 * (10**15 + 12) // (3 * 10**17 + 1 + 5 * 10**6), None]


def test_empty_table(spark):
    assert source_divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
