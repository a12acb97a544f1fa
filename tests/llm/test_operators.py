"""Each operator on small tables: brute force, round trips, and rows with nulls, ties and odd texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitspark.llm import bpe, decontamination, language_id, line_dedup, ngram_join, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter
from pitspark.llm.batches import Words, fold_is, mix, windows

DOCS = "doc_id long, text string"
SPACE = r"[^\x20\x09-\x0D]+"


def odd_rows(seed: int = 3) -> list[tuple]:
    """Nulls, empty texts, a very long text, copies, repeated rows, ties of ids, and random texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "日本", "a", "B"]
    some = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 70))) for _ in range(25)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(45))
    rows = [(i, t) for i, t in enumerate(some)]
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, " ".join(rng.choice(vocabulary) for _ in range(30_000)))]
    rows += [(200 + i, f"{some[i]}\n{passage}\n{some[i + 1]}") for i in range(8)]
    rows += [(300, some[3]), (301, some[3]), (302, some[3].upper()), (303, f"{passage} {passage}")]
    rows += [(400, f"{some[5]} tail"), (400, f"{some[5]} tail"), (None, some[3]), (None, None), (-7, passage)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows with extra columns whose names the operators use inside."""
    extra = [(i, t, "x", 1, "k", None) for i, t in odd_rows()]
    return spark.createDataFrame(extra, f"{DOCS}, anchors string, class int, signature string, n_removed long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- shared


def test_word_hashes_tell_words_apart():
    texts = [b"a b a", None, b"", b"  b\ta ", "é ab".encode()]
    hashes, first = Words()(texts)
    assert first.tolist() == [0, 3, 3, 3, 5, 7]
    a, b = hashes[0], hashes[1]
    assert hashes[:5].tolist() == [a, b, a, b, a] and len(set(hashes.tolist())) == 4
    lowered, _ = Words(lower=True)([b"AbC abc"])
    assert lowered[0] == lowered[1]
    assert len(windows(hashes[:3], 2)) == 2 and len(windows(hashes[:1], 2)) == 0


def test_fold_of_null_id_is_false(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id long").select("doc_id", fold_is(5, 0).alias("f")).collect()
    assert rows[0].f is False


# --- 1 toxicity


def test_toxicity_learns_and_handles_odd_rows(spark, odd, empty):
    rng = random.Random(1)
    common = ["the", "river", "house", "garden", "window", "morning"]
    bad = ["worthless", "scumbag", "pathetic"]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(common) for _ in range(40)]
        if i % 3 == 0:
            for _ in range(6):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs, labelled = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labelled, ~fold_is(5, 0))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels]) > 0.97
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    for kind in (0, 1):
        one = toxicity.fit(docs, labelled.where(f"toxic = {kind}"), ~fold_is(5, 0))
        assert {r.score for r in toxicity.score(docs, one).collect()} == {float(kind)}


# --- 2 url filter


def test_url_parts_rules_and_verdicts(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.NET/EN/x", "http://a.example.net/en/", "http://example.com/de/1?x#y", "http://notexample.com/de/1", "https://x.org/fr/a#b",
        "http://x.net", "http://x.net?q", "a://b://c.net/d", "http://casino-bets.example.com/en/1", "https://www.quiet-river.example.com/en/" + "z" * 50_000, "http://x.net/a\nb?c",
    ]
    pages = spark.createDataFrame([(i, u, "p", "r") for i, u in enumerate(urls)] + [(None, urls[4], "p", "r")], "page_id long, url string, path string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert len(got) == len(urls) + 1

    def expected(url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1:] if fits else (None, None)

    for i, url in enumerate(urls):
        host, path, (rule, verdict) = expected(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or ("block" if got[i].p_block >= 0.5 else "allow"))
    assert got[12].verdict == "block" and got[13].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


# --- 3 line dedup


def brute_lines(rows):
    first = {}
    texts = sorted({r for r in rows if r[0] is not None and r[1] is not None})
    for doc, text in texts:
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            first[w] = min(first.get(w, (doc, i)), (doc, i))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines, gone, own = text.split("\n"), set(), {}
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(re.search(r"[^\x20\x09-\x0D]", x) for x in w):
                if w in own or (doc is not None and first[w][0] < doc):
                    gone.update((i, i + 1, i + 2))
                own.setdefault(w, i)
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i % 5]), "\n".join(rng.choice(["a", "b", "", "c c", " "]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    rows = list({r[0]: r for r in rows}.values()) + [(900, None), (901, ""), (902, "x\n" * 3000), (None, "a\nb\na\nb\na\nb"), rows[-1]]
    docs = spark.createDataFrame([(*r, "k", 5) for r in rows], f"{DOCS}, at string, lines int")
    assert as_rows(line_dedup.remove_repeated_lines(docs), "doc_id", "text", "n_lines", "n_removed") == brute_lines(rows)


def test_line_dedup_odd_rows(odd, empty):
    done = line_dedup.remove_repeated_lines(odd)
    assert done.count() == odd.count() and done.where("text is null").count() == odd.where("text is null").count()
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 4 decontamination


def brute_hits(text, items, size=10):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    words, hit, names = cut(text), set(), set()
    for item, item_text in items:
        w = cut(item_text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            p = w[i : i + size]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    names.add("null" if item is None else str(item))
    return len(words), sorted(hit), sorted(names)


@pytest.mark.parametrize("per_block", [2, 10_000])
def test_decontamination_matches_brute_force(spark, odd, per_block):
    rng = random.Random(5)
    source = odd_rows()[203 - 200 + 29][1]
    words = source.split()
    items = [(1, " ".join(words[5:22])), (2, words[0]), (3, " ".join(words[8:12]).upper()), (4, None), (5, ""), (6, "-- !"), (7, " ".join(words[5:22])), (None, "日本 w3"), (8, " ".join(rng.choice(words) for _ in range(12)))]
    benchmark = spark.createDataFrame([(*i, "h") for i in items], "item_id long, text string, hits string")
    got = decontamination.find_contamination(odd, benchmark, items_per_block=per_block)
    want = sorted(((i, *brute_hits(t, items)) for i, t in odd_rows()), key=str)
    assert as_rows(got, "doc_id", "n_words", "hits", "items") == want
    clean = sorted(((i, t) for i, t in odd_rows() if not brute_hits(t, items)[1]), key=str)
    assert as_rows(decontamination.keep_clean(odd, benchmark, items_per_block=per_block), "doc_id", "text") == clean


def test_decontamination_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(odd, none).where("size(hits) > 0").count() == 0
    assert decontamination.find_contamination(empty, none).count() == 0


# --- 5 language identification


def small_field():
    rng = random.Random(2)
    parts = {"aa": ["tha", "ing", "wer"], "bb": ["quo", "ció", "lla"], "cc": ["sch", "ung", "ßen"]}
    rows = [(k, " ".join("".join(rng.choice(p) for _ in range(rng.randint(1, 3))) for _ in range(60))) for k, p in parts.items() for _ in range(12)]
    return rows, language_id.train(rows, steps=60)


def test_language_of_texts_and_of_switched_words(spark, odd, empty):
    rows, field = small_field()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, field).collect()}
    assert all(got[i][0] == k and got[i][1] > 0.9 for i, (k, _) in enumerate(rows))
    mixed = spark.createDataFrame([(1, "thaing wertha ingwer schung ungßen schßen")], DOCS)
    assert language_id.label_words(mixed, field).first().langs == ["aa"] * 3 + ["cc"] * 3
    und = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, field).collect()}
    assert und[100] == und[101] == und[102] == ("und", 0.0) and und[103][0] != "und"
    assert language_id.predict(odd, field).where("score < 0 or score > 1 or score is null").count() == 0
    assert language_id.predict(empty, field).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34 ½ !")], DOCS)
    assert language_id.predict(digits, field).first().lang_pred == "und"


def test_language_fit_reads_learning_rows_only(spark):
    rows = [(i, "tha ing wer " * 5 if i % 2 else "quo ció lla " * 5, "aa" if i % 2 else "bb") for i in range(60)] + [(None, "x", "zz"), (61, None, "aa"), (62, "q", None)]
    field = language_id.fit(spark.createDataFrame(rows, f"{DOCS}, lang string"), ~fold_is(4, 2))
    assert field.languages == ["aa", "bb"]


@pytest.mark.parametrize("block", [3, 16, 200])
def test_blocked_marginals_are_those_of_forward_backward(block):
    rng = np.random.default_rng(block)
    e, m, s = rng.random((150, 4)) + 0.01, rng.random((4, 4)), rng.random(4)
    starts = [0, 40, 41, 100, 150]
    resets = np.zeros(150, bool)
    resets[starts[:-1]] = True
    got = language_id._marginals(e, m, s, resets, block)
    for a, b in zip(starts, starts[1:], strict=False):
        ahead, back = [s * e[a]], [np.ones(4)]
        for t in range(a + 1, b):
            ahead.append((ahead[-1] @ m) * e[t])
        for t in range(b - 1, a, -1):
            back.append(m @ (e[t] * back[-1]))
        p = np.array(ahead) * np.array(back[::-1])
        np.testing.assert_allclose(got[a:b], p / p.sum(1, keepdims=True), atol=1e-12)


# --- 6 substring dedup


def brute_passages(rows, size=20):
    first, out = {}, []
    texts = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    words = {r: re.findall(SPACE, r[1]) for r in texts}
    for d, t in texts:
        w = words[d, t]
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, (d, i)), (d, i))
    for d, t in rows:
        w = re.findall(SPACE, t or "")
        gone, own = [False] * len(w), {}
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if d is not None and (g in own or first[g][0] < d):
                gone[i : i + size] = [True] * size
            own.setdefault(g, i)
        out.append((d, " ".join(x for x, y in zip(w, gone, strict=True) if not y), len(w), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [300, 8 << 20])
def test_substring_dedup_matches_brute_force(spark, odd, shard_bytes):
    got = substring_dedup.remove_repeated_passages(odd, shard_bytes)
    assert as_rows(got, "doc_id", "text", "n_words", "n_removed") == brute_passages(odd_rows())


def test_substring_dedup_of_repeated_words(spark, empty):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(15, 90)))) for i in range(30)] + [(50, "of " * 100), (51, "of " * 37)]
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, DOCS), 200)
    assert as_rows(got, "doc_id", "text", "n_words", "n_removed") == brute_passages(rows)
    assert substring_dedup.remove_repeated_passages(empty).count() == 0


# --- 7 byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "'", "s", "'ll", "'re", " ", "  ", "\n", "\t", "é", "1", "23", "!", "\x1c", "\x85", "漢", "😀", "the ", "\u00a0"]), max_size=40).map("".join), st.sampled_from([1, 2, 3, 7, 16]))
def test_tree_gives_the_flat_tokens(codec, text, leaf):
    codec.leaf = leaf
    ids = codec.encode(text)
    assert ids.tolist() == codec.base.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_round_trip(spark, odd, empty, codec):
    got = bpe.encode_and_decode(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf=64)
    want = sorted(((i, codec.base.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_rows()), key=str)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got.collect()), key=str) == want
    assert bpe.encode_and_decode(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# --- 8 quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts_and_verdicts(spark, odd, empty):
    got = quality_rules.judge(odd)
    for r in got.collect():
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept) and r.kept == (r.rejected_by is None)
    want = sorted(((i, *brute_counts(t)) for i, t in odd_rows()), key=str)
    assert as_rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    assert quality_rules.judge(empty).count() == 0


def test_cascade_order_changes_cost_only(spark):
    figures = {"many_symbols": (2.0, 0.5), "shouting": (1.0, 0.5), "stammering": (1.0, 0.0)}
    ordered = [n for n, _ in quality_rules.order_rules(quality_rules.RULES, figures)]
    assert ordered[:2] == ["shouting", "many_symbols"]
    bad = quality_rules.Text(b"### *** $$$ %%% a b c d e f g h")
    assert {quality_rules.first_rejection(bad, r) is None for r in (quality_rules.RULES, quality_rules.RULES[::-1])} == {False}
    calls = []
    rules = [("first", lambda t: True), ("second", lambda t: calls.append(t) or True)]
    assert quality_rules.first_rejection(bad, rules) == "first" and not calls


# --- 9 quality classifier


def test_quality_classifier_from_positives_and_unlabelled(spark, odd, empty):
    rng = random.Random(4)
    words = ["the", "river", "house", "garden", "and", "window", "over", "morning"]
    rows, truth = [], {}
    for i in range(1200):
        good = rng.random() < 0.8
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) if good else " ".join(rng.choice(["$$$", "BUY!!", "###", "win"]) for _ in range(40))
        rows.append((i, text))
        truth[i] = good
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 if g else 0) for i, g in truth.items() if i % 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, ~fold_is(5, 0))
    assert 0.7 < model.prior < 0.9
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.3) == g for i, g in truth.items()]) > 0.97
    assert quality_classifier.keep(docs, model, 0.3).count() == sum(s >= 0.3 for s in got.values())
    scored = quality_classifier.score(odd, model)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.score(empty, model).count() == 0
    assert quality_classifier.fit(docs, labels.where("quality = 0"), ~fold_is(5, 0)) is None


# --- 10 n-gram join


def brute_components(rows, n, num, den):
    def grams(t):
        w = re.findall(SPACE, (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    known = [(d, grams(t)) for d, t in rows]
    top = {d: d for d, _ in known}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((root(a), root(b)))
                top[high] = low
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in known), key=str)


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_ngram_join_matches_brute_force(spark, odd, n, num, den):
    rng = random.Random(n)
    base = [f"v{rng.randrange(400)}" for _ in range(120)]
    rows = odd_rows()
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"s{(i // 4) + k}" for k in range(4 + i % 3))) for i in range(30)]
    docs = spark.createDataFrame([(*r, 0, "c") for r in rows], f"{DOCS}, component long, signature string")
    got = ngram_join.link_documents(docs, n, num, den)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, n, num, den)


def test_ngram_join_of_empty_table(empty):
    assert ngram_join.link_documents(empty, 3, 90, 100).count() == 0


@pytest.mark.parametrize("num", [90, 80, 60])
def test_similar_sets_share_a_signature(num):
    rng = np.random.default_rng(num)
    sign = ngram_join.PartEnum(num, 100)
    for size in [1, 2, 3, 5, 8, 9, 10, 11, 19, 20, 27, 40, 60, 150, 400]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            out = rng.integers(0, size * (100 - num) // 100 + 1)
            y = np.unique(np.concatenate((x[out:], rng.integers(0, 2**63, rng.integers(0, 4 + size // 8), dtype=np.uint64))))
            common = len(np.intersect1d(x, y))
            if 100 * common >= num * (len(x) + len(y) - common) and not np.array_equal(x, y):
                assert len(np.intersect1d(sign(x), sign(y))), (size, len(y), common)


# --- accuracy on held-out rows


def test_held_out_accuracy(spark):
    from pitspark.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = queries.toxicity_scores(spark, sf).where("held_out").join(labels, "doc_id").where("toxic is not null")
    right = toxic.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert right[0] > 0.95 and right[1] > 0.7
    good = queries.quality_scores(spark, sf).where("held_out").join(labels, "doc_id").where("quality is not null")
    right = good.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("predicted")))).first()
    assert right[0] > 0.93 and right[1] > 0.98
    said = queries.languages(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_long_residual_texts_carry_bounded_lists(spark):
    """Two texts of 100,000 words that are not quite similar enough, and a chain of near copies of them."""
    rng = random.Random(12)
    base = [f"v{rng.randrange(40_000)}" for _ in range(100_000)]

    def changed(share, seed):
        r = random.Random(seed)
        return " ".join(f"x{seed}_{i}" if r.random() < share else w for i, w in enumerate(base))

    rows = [(0, changed(0, 0)), (1, changed(0.002, 1)), (2, changed(0.035, 2)), (3, changed(0.05, 3)), (4, "short text of five words more")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(docs, 5, 80, 100).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 5, 80, 100)}
    left_over = spark.createDataFrame([(i, i, t) for i, t in rows[:4]], "class long, component long, text string")
    rare = ngram_join.rare_elements(ngram_join.common_elements(ngram_join.set_elements(left_over, 5)), ngram_join.sketches(left_over, 5), 80, 100)
    assert rare.where(F.size("rare") > ngram_join.CARRIED).count() == 0 and rare.groupBy("class").count().agg(F.max("count")).first()[0] > 10_000


def test_near_copies_make_one_star_per_class(spark):
    """Every class of a group of near copies is compared with one pivot in round one."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(200):
        words = list(base)
        words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(spark.createDataFrame(rows, DOCS), 3, 90, 100).collect()}
    assert got == {d: c for d, _, c in brute_components(rows, 3, 90, 100)}
    shared = ngram_join.shared_signatures(ngram_join.signatures(spark.createDataFrame(rows, DOCS), 3, 90, 100))
    by_round = [ngram_join.shared_signatures(ngram_join.signatures(spark.createDataFrame(rows, DOCS), 3, 90, 100, 3, k)) for k in range(3)]
    assert sum(x.count() for x in by_round) == shared.count()


@pytest.mark.parametrize("num", [80, 90])
def test_sets_signed_together_and_in_rounds_have_the_signatures_of_each_alone(num):
    rng = np.random.default_rng(4)
    found = [np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (1, 2, 3, 9, 10, 11, 40, 41, 200, 200, 3000)]
    sign = ngram_join.PartEnum(num, 100)
    parts = [sign.together(found, 3, k) for k in range(3)]
    signed, owner = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    for i, x in enumerate(found):
        assert sorted(signed[owner == i].tolist()) == sorted(sign(x).tolist())
    assert ngram_join.classes_of([*found, found[0][:0]]) == [*map(ngram_join.class_of, found), None]


def near_copies(n: int) -> list[tuple[int, str]]:
    """Near copies of one text, of which a tenth or so of all pairs are similar enough."""
    rng = random.Random(31)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_links_of_near_copies_grow_with_the_texts(spark, monkeypatch):
    rows, edges, compared = near_copies(300), [], []
    true_components, true_verified = ngram_join.connected_components, ngram_join.verified
    monkeypatch.setattr(ngram_join, "connected_components", lambda x: edges.append(x.count()) or true_components(x))
    monkeypatch.setattr(ngram_join, "verified", lambda x, *more: compared.append(x.count()) or true_verified(x, *more))
    got = ngram_join.link_documents(spark.createDataFrame(rows, DOCS), 3, 90, 100)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, 3, 90, 100)
    assert sum(edges) <= 3 * len(rows)


def test_sketches_count_the_cells_that_differ(spark):
    rng = random.Random(32)
    texts = [" ".join(f"v{rng.randrange(300)}" for _ in range(n)) for n in (1, 5, 40, 41, 300, 900)]
    residual = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "class long, component long, text string")
    sketched = ngram_join.sketches(residual, 3)
    pairs = sketched.select("class", F.col("sketch").alias("x")).crossJoin(sketched.select(F.col("class").alias("other"), F.col("sketch").alias("y")))
    got = {(r[0], r[1]): r[2] for r in pairs.select("class", "other", ngram_join.cells_apart(F.col("x"), F.col("y"))).collect()}
    bits = {r["class"]: [[x >> i & 1 for i in range(64)] for x in r.sketch] for r in sketched.collect()}
    sets = ngram_join.Sets(3)([t.encode() for t in texts])
    for (i, j), n in got.items():
        x, y = bits[i], bits[j]
        assert n == sum(any(x[4 * w + p][c] != y[4 * w + p][c] for p in range(4)) for w in range(4) for c in range(64))
        assert n <= len(np.setxor1d(sets[i], sets[j]))


def test_automaton_nodes_have_few_children():
    hashes = np.random.default_rng(3).integers(0, 2**63, 50_000).astype(np.uint64)
    symbols = substring_dedup._symbols(hashes)
    blocks = [symbols[i : i + len(symbols) // len(hashes)] for i in range(0, len(symbols), len(symbols) // len(hashes))]
    assert len(set(symbols)) <= 400 and len({b[0] for b in blocks}) <= 110
    assert len(set(blocks)) > 48_000 and not {b[0] for b in blocks} & {c for b in blocks for c in b[1:]}


def test_hits_of_a_piece_laid_out_together():
    """Texts side by side, whose borders cut passages; several passages with the same blocks; small slices."""
    rng = random.Random(33)
    word = lambda x: Words()([x.encode()])[0]
    base = word(" ".join(f"v{rng.randrange(6)}" for _ in range(400)))
    passages = [(rng.choice([5, 15, 25]), base[a : a + rng.randrange(20, 60)]) for a in range(0, 330, 11)]
    texts = [base[:37], base[37:60], base[0:0], base[60:200], np.concatenate([base[10:29], base[300:321], base[5:24]]), base[250:390], np.tile(base[40:47], 30)]
    docs, first = np.array([10, 20, 20, 30, 12, 5, 26]), np.cumsum([0, *map(len, texts)])
    for doc, text in zip(docs.tolist(), texts, strict=True):
        wanted = np.zeros(len(text), bool)
        known = {own[i : i + 20].tobytes() for source, own in passages if source < doc for i in range(len(own) - 19)}
        for i in range(len(text) - 19):
            if text[i : i + 20].tobytes() in known:
                wanted[i : i + 20] = True
        at = len(wanted)
        alone = substring_dedup.Phrases(passages).removed(np.array([doc]), text, np.array([0, at]))
        assert (alone == wanted).all()
    apart = [substring_dedup.Phrases(passages).removed(docs[i : i + 1], t, np.array([0, len(t)])) for i, t in enumerate(texts)]
    for laid in (substring_dedup.LAID, 7):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(substring_dedup, "LAID", laid)
            together = substring_dedup.Phrases(passages).removed(docs, np.concatenate(texts), first)
        assert (together == np.concatenate(apart)).all()
    assert together.any() and not together.all()
    assert not substring_dedup.Phrases([]).removed(docs, np.concatenate(texts), first).any()


def test_window_hashes_match_their_sum():
    hashes = np.random.default_rng(4).integers(0, 2**63, 90).astype(np.uint64)
    for k in (1, 2, 3, 6, 10, 13, 20, 31, 32, 90):
        sums = [(k + 7 + sum(int(h) * pow(0x2545F4914F6CDD1D, j + 1, 1 << 64) for j, h in enumerate(hashes[i : i + k]))) % (1 << 64) for i in range(91 - k)]
        assert (windows(hashes, k, 7) == mix(np.array(sums, np.uint64))).all()
