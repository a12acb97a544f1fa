"""Phrase and keyword match against plain Python, word borders, the two limits, hot keys and odd rows."""

import datetime as dt
import random
import re

import pytest

from pitspark.operators import news

D = dt.date


def brute(articles, phrases, keywords):
    plain = lambda x: " ".join(re.findall(r"[^\W_]+", (x or "").lower()))
    out = set()
    for i, body in articles:
        text = f" {plain(body)} "
        for key, phrase in phrases:
            if plain(phrase) and f" {plain(phrase)} " in text and all(f" {plain(w)} " in text for k, w in keywords if k == key and plain(w)):
                out.add((key, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_those_of_plain_python(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["Oil", "GAS", "énergie", "devon", "energy", "x1", "a"]
    articles = [(i, rng.choice([" ", "\n", ", ", "'s "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(900, None), (901, ""), (902, "oil " * 3_000 + "Devon-Energy")]
    phrases = [("d", "Devon Energy"), ("d", "x1 a gas"), ("e", "énergie"), ("e", "devon energy"), ("none", "..."), ("long", " ".join(["oil"] * 13))]
    keywords = [("d", "OIL"), ("e", "gas"), ("e", "Oil"), ("unused", "oil"), ("long", "?")]
    schema = "article_id long, body string"
    got = news.match_articles(spark.createDataFrame(articles, schema), spark.createDataFrame(phrases, "key string, text string"), spark.createDataFrame(keywords, "key string, text string"), "key")
    assert {tuple(r) for r in got.collect()} == brute(articles, phrases, keywords)


def test_word_borders_and_no_terms(spark):
    articles = spark.createDataFrame([(1, "Ovintivs"), (2, "the OVINTIV-deal"), (3, "ovintiv")], "article_id long, body string")
    phrases, none = spark.createDataFrame([("OVV", "Ovintiv")], "key string, text string"), spark.createDataFrame([], "key string, text string")
    assert sorted(r.article_id for r in news.match_articles(articles, phrases, none, "key").collect()) == [2, 3]
    assert news.match_articles(articles, none, none, "key").count() == 0
    assert news.match_articles(articles.limit(0), phrases, none, "key").count() == 0


def test_fetched_then_used_per_cell(spark):
    """A third of all articles on one day of one company: the limits keep the first by date and id."""
    rows = [(i, D(2024, 1, 5 + (i > 30)) if i % 3 else D(2024, 1, 9), "Devon Energy oil") for i in range(300)] + [(1000, D(2024, 2, 1), "Devon Energy oil"), (1001, None, "Devon Energy oil"), (1002, D(2023, 12, 31), "Devon Energy oil")]
    cells = [("DVN", D(2024, 3, 31), D(2024, 1, 1), D(2024, 1, 31)), ("DVN", D(2024, 6, 30), D(2024, 2, 1), D(2024, 1, 31)), ("OXY", D(2024, 3, 31), D(2024, 1, 1), D(2024, 1, 31))]
    articles = spark.createDataFrame(rows, "article_id long, publish_date date, body string")
    frame = spark.createDataFrame(cells, "ticker string, fpe date, prev_ed date, t date")
    phrases, keywords = spark.createDataFrame([("DVN", "devon energy"), ("OXY", "occidental")], "ticker string, text string"), spark.createDataFrame([("DVN", "oil")], "ticker string, text string")
    fetched = news.articles_for_cells(articles, frame, phrases, keywords, "ticker", ["ticker", "fpe"], 75, 30)
    got = sorted((r.position, r.article_id, r.used) for r in fetched.collect())
    order = sorted((d, i) for i, d, _ in rows if d and D(2024, 1, 1) <= d <= D(2024, 1, 31))[:75]
    assert got == [(n, i, n <= 30) for n, (_, i) in enumerate(order, 1)]
    per = {(r.ticker, r.fpe): (r.n_articles_in_window, r.used_ids) for r in news.news_per_cell(frame, fetched, ["ticker", "fpe"]).collect()}
    assert per == {("DVN", D(2024, 3, 31)): (75, [i for _, i in order[:30]]), ("DVN", D(2024, 6, 30)): (0, []), ("OXY", D(2024, 3, 31)): (0, [])}
