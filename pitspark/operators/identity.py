"""Identity, cleaning, spines and text-derived fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import dates, scoring, text
from pitspark.operators.core import collapse_daily


def remap_entities(df: DataFrame, col: str, mapping: Mapping[str, str] = params.LEGACY_TICKERS, drop: Sequence[str] = params.DROPPED_TICKERS, universe: Sequence[str] = (*params.UNIVERSE, *params.BENCHMARK_SYMBOLS)) -> DataFrame:
    """Old identifier to current one; rows on the drop list, or outside the universe and the two
    benchmark symbols, are removed."""
    current = F.coalesce(scoring.lookup(F.col(col), dict(mapping)), F.col(col))
    return df.where(~F.col(col).isin(*drop)).withColumn(col, current).where(F.col(col).isin(*universe))


def filter_name_prefix(df: DataFrame, key: str, name: str, prefixes: Mapping[str, Sequence[str]] = params.NAME_PREFIXES) -> DataFrame:
    """Rows whose lower-case name starts with a prefix registered for their own key."""
    low = F.lower(F.coalesce(name, F.lit("")))
    own = [(F.col(key) == k) & reduce(Column.__or__, [low.startswith(p) for p in ps]) for k, ps in prefixes.items()]
    return df.where(reduce(Column.__or__, own))


def drop_contaminated(df: DataFrame, key: str, name: str, value: str = params.CONTAMINATED["ticker"], part: str = params.CONTAMINATED["name_part"]) -> DataFrame:
    """Drop rows of one key whose name shows they belong to another company."""
    return df.where(~((F.col(key) == value) & F.upper(F.coalesce(name, F.lit(""))).contains(part)))


def normalize_operator(df: DataFrame, name: str, out: str, registry: Mapping[str, Sequence[str]] = params.OPERATOR_PATTERNS) -> DataFrame:
    """First key, in registry order, with a pattern inside the upper-case name; NULL when none."""
    up = F.upper(F.coalesce(name, F.lit("")))
    first = F.coalesce(*[F.when(reduce(Column.__or__, [up.contains(p) for p in ps]), F.lit(k)) for k, ps in registry.items()])
    return df.withColumn(out, first)


def union_price_sources(primary: DataFrame, supplement: DataFrame, keys: Sequence[str], ts: str, cutoff) -> DataFrame:
    """Primary rows plus supplement rows after the cutoff on days the primary does not have."""
    extra = supplement.where(F.col(ts) > cutoff).join(primary.select(*keys, ts).distinct(), [*keys, ts], "left_anti")
    return primary.unionByName(extra)


def pct_change(prices: DataFrame, keys: Sequence[str], ts: str, value: str, out: str = "ret") -> DataFrame:
    """Day-over-day return per key, first NULL."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(ts))
    return collapse_daily(prices, keys, ts, [value]).withColumn(out, F.try_divide(F.col(value) - prev, prev))


def cell_grid(universe: DataFrame, start, end, earnings: DataFrame) -> DataFrame:
    """Universe x quarter ends, kept where an event date exists; T is 14 days before it."""
    grid = universe.withColumn("fpe", F.explode(dates.quarter_spine(start, end)))
    return grid.join(earnings, ["firm", "fpe"]).withColumn("t", dates.decision_date("ed"))


def filing_for_fiscal_year(filings: DataFrame, key: str, form: str = "10-K") -> DataFrame:
    """Newest annual filing per key and fiscal year; the fiscal year is the one before the filing's."""
    annual = filings.where(F.col("form") == form).withColumn("fiscal_year", F.year("filing_date") - 1)
    rest = [c for c in annual.columns if c not in (key, "fiscal_year", "filing_date", "filing_id")]
    best = annual.groupBy(key, "fiscal_year").agg(F.max(F.struct("filing_date", "filing_id", *rest)).alias("_f"))
    return best.select(key, "fiscal_year", "_f.*")


def fraction_with_provenance(targets: DataFrame, filings: DataFrame, key: str, pure_play: Sequence[str] = params.PURE_PLAY, pattern: str = params.SHARE_PATTERN) -> DataFrame:
    """Basin share per target (key, fiscal year) with the way it was found: pure-play default, read
    from the filing text, filing without a match (needs a narrative pass), or no filing (manual)."""
    # The share is read from every annual filing's whole text before the newest one is picked, so
    # that only the number, not the text, is shuffled.
    scored = filings.withColumn("share", text.extract_share(text.strip_html(F.col("html")), pattern)).drop("html")
    chosen = filing_for_fiscal_year(scored, key).select(key, "fiscal_year", "filing_date", "share")
    pure = F.col(key).isin(*pure_play)
    got = targets.join(chosen, [key, "fiscal_year"], "left")
    method = (
        F.when(pure, "pure_play_default").when(F.col("filing_date").isNull(), "manual")
        .when(F.col("share").isNotNull(), "regex_table").otherwise("llm_narrative")
    )
    return got.select(
        key, "fiscal_year", F.when(pure, F.lit(1.0)).otherwise(F.col("share")).alias("fraction"), method.alias("method"),
        F.when(~pure, F.col("filing_date")).alias("source_filing_date"),
        F.replace(scoring.lookup(method, params.SHARE_NOTES), F.lit("{}"), (F.col("fiscal_year") + 1).cast("string")).alias("notes"),
    )
