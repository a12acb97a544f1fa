"""News per decision cell: registered phrases and keywords found in whole texts, then two limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark import params
from pitspark.operators.core import first_n, window_join, with_scalar

NO_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def term(text: Column) -> Column:
    """A phrase or keyword in the form it is compared in: its words joined by one space."""
    return F.array_join(words(text), " ")


def grams(text: Column, lengths: Column) -> Column:
    """The distinct word n-grams of a text for an array of lengths, as an array. The words are bound once, so
    a text is split once however many n-grams it has."""

    def of(ws: Column) -> Column:
        def of_length(k: Column) -> Column:
            starts = F.when(F.size(ws) >= k, F.sequence(F.lit(1), F.size(ws) - k + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, k), " "))

        return F.array_distinct(F.flatten(F.transform(lengths, of_length)))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def terms_in_articles(articles: DataFrame, terms: DataFrame, article: str, body: str) -> DataFrame:
    """(article, terms): which of the registered ``terms`` (one column ``term``, any number of rows) each article
    holds. An equi-join of n-grams with terms: work grows with the texts, not with texts times terms. The lengths
    that occur among the terms are an array of a few numbers; the texts go no further than their n-grams."""
    distinct = terms.select("term").where("term != ''").distinct()
    lengths = distinct.agg(F.array_sort(F.collect_set(F.size(F.split("term", " ")))).alias("_lengths"))
    listed = with_scalar(articles.select(F.col(article).alias("_article"), F.col(body).alias("_body")), lengths)
    each = listed.select("_article", F.explode(grams(F.col("_body"), F.col("_lengths"))).alias("term"))
    return each.join(distinct, "term").groupBy(F.col("_article").alias(article)).agg(F.collect_set("term").alias("terms"))


def match_articles(articles: DataFrame, phrases: DataFrame, keywords: DataFrame, key: str, article: str = "article_id", body: str = "body") -> DataFrame:
    """(key, article): articles that hold a phrase of the key and all of the key's keywords. ``phrases`` and
    ``keywords`` have (key, text); a key may have several phrases, of which one is enough, and no keyword. Phrases
    are found across punctuation and line breaks, but only as whole words; one without words matches nothing."""
    named = phrases.select(key, term(F.col("text")).alias("term")).where("term != ''").distinct()
    needed = keywords.select(key, term(F.col("text")).alias("_word")).where("_word != ''")
    terms = named.select("term").unionByName(needed.select(F.col("_word").alias("term")))
    registry = named.join(needed.groupBy(key).agg(F.collect_set("_word").alias("_needed")), key, "left")
    found = terms_in_articles(articles, terms, article, body).select(article, "terms", F.explode("terms").alias("term"))
    lacking = F.size(F.array_except(F.coalesce("_needed", F.array().cast("array<string>")), F.col("terms")))
    return found.join(registry, "term").where(lacking == 0).select(key, article).distinct()


def articles_for_cells(articles: DataFrame, cells: DataFrame, phrases: DataFrame, keywords: DataFrame, key: str, cell_key: Sequence[str], fetch: int = params.NEWS_FETCH_LIMIT, use: int = params.NEWS_USE_LIMIT) -> DataFrame:
    """Matching articles of each cell published from the previous event through T: the first ``fetch`` by date
    and id are retrieved (``position``); of those still inside the cut-off the first ``use`` are read (``used``).
    ``articles``: (article_id, publish_date, body); ``cells``: the cell key with prev_ed and t."""
    matched = match_articles(articles, phrases, keywords, key)
    dated = matched.join(articles.select("article_id", "publish_date").where("publish_date IS NOT NULL"), "article_id")
    hits = window_join(cells.select(key, *[c for c in cell_key if c != key], "prev_ed", "t"), dated, [key], "prev_ed", "t", "publish_date", "article_id")
    fetched = first_n(hits, cell_key, ["publish_date", "article_id"], fetch, "position").where("publish_date <= t")
    return fetched.withColumn("used", F.col("position") <= use)


def news_per_cell(cells: DataFrame, fetched: DataFrame, cell_key: Sequence[str]) -> DataFrame:
    """Per cell the number of articles retrieved and the ids of those read, in their order; cells without
    articles have 0 and an empty list. A list has at most as many ids as are read."""
    ids = F.array_sort(F.collect_list(F.when(F.col("used"), F.struct("position", "article_id"))))
    per = fetched.groupBy(*cell_key).agg(F.count(F.lit(1)).alias("n_articles_in_window"), F.transform(ids, lambda x: x["article_id"]).alias("used_ids"))
    empty = fetched.select(F.array(F.col("article_id"))).schema[0].dataType
    rows = cells.select(*cell_key).join(per, list(cell_key), "left").na.fill(0, ["n_articles_in_window"])
    return rows.withColumn("used_ids", F.coalesce("used_ids", F.array().cast(empty)))
