"""Coverage and eligibility panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import dates
from pitspark.operators import pit
from pitspark.operators.core import collapse_daily, group_summary


def coverage_panel(est: DataFrame, min_analysts: int = 3) -> DataFrame:
    """Next-quarter sales estimates at calendar quarter ends: counts, median, mean, sample deviation,
    first and last announcement, and whether enough analysts cover the quarter."""
    rows = est.where((F.col("fpi") == 6) & (F.col("measure") == "SAL") & F.col("fpe").isNotNull() & F.col("firm").isNotNull() & dates.is_quarter_end("fpe"))
    stats = group_summary(rows, ["firm", "fpe"], "value", {"median_value": 0.5}, extra={"newest_anndats": F.max("anndats"), "oldest_anndats": F.min("anndats")})
    analysts = rows.where(F.col("value").isNotNull()).select("firm", "fpe", "analyst").distinct().groupBy("firm", "fpe").agg(F.count("analyst").alias("n_analysts"))
    return stats.join(analysts, ["firm", "fpe"]).select(
        "firm", "fpe", F.col("n").alias("n_estimates"), "n_analysts", "median_value", F.col("mean").alias("mean_value"), F.col("sd").alias("dispersion"),
        "newest_anndats", "oldest_anndats", (F.col("n_analysts") >= min_analysts).alias("eligible"),
    )


def eligibility_panel(cells: DataFrame, prices: DataFrame, fraction: DataFrame, coverage: DataFrame, min_cap: float = 500e6, min_fraction: float = 0.30, min_analysts: int = 3) -> DataFrame:
    """Listed, large enough, enough of its output in the basin, and covered: with the reasons for a no
    in fixed order, NULL when eligible."""
    rows = pit.market_cap_asof(pit.listed_at(cells.select(*pit.CELL), prices), prices)
    rows = rows.withColumn("fiscal_year", dates.latest_fiscal_year("t")).join(fraction.select("firm", "fiscal_year", "fraction"), ["firm", "fiscal_year"], "left")
    rows = rows.join(coverage.select("firm", "fpe", "n_analysts"), ["firm", "fpe"], "left").na.fill(0, ["n_analysts"])

    def below(c: str, limit: float) -> Column:
        return F.coalesce(F.col(c) < limit, F.lit(True))

    reasons = F.concat_ws(
        ";", F.when(~F.col("listed"), "not_listed"), F.when(below("market_cap", min_cap), "low_market_cap"),
        F.when(below("fraction", min_fraction), "low_permian_fraction"), F.when(F.col("n_analysts") < min_analysts, "thin_coverage"),
    )
    rows = rows.withColumn("drop_reason", F.nullif(reasons, F.lit("")))
    return rows.select(*pit.CELL, "listed", "market_cap", "fraction", "n_analysts", F.col("drop_reason").isNull().alias("eligible"), "drop_reason")


def eligibility_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("firm").agg(F.count_if("eligible").alias("n_eligible"), F.count(F.lit(1)).alias("n_quarters"))


def coverage_matrix(panel: DataFrame, quarters: Sequence[str] | None = None) -> DataFrame:
    """Firm x quarter table of analyst counts; ``quarters`` are the labels (2024Q1) to show, by default
    all that occur (one per calendar quarter, so their list is bounded)."""
    labelled = panel.withColumn("_q", F.concat(F.year("fpe").cast("string"), F.lit("Q"), F.quarter("fpe").cast("string")))
    if quarters is None:
        quarters = sorted(r["_q"] for r in labelled.where("_q IS NOT NULL").select("_q").distinct().collect())
    return labelled.groupBy("firm").pivot("_q", list(quarters)).agg(F.max("n_analysts"))


def universe_rule(panel: DataFrame, share: float = 0.6) -> DataFrame:
    """Firms eligible in at least the given share of their quarters."""
    return eligibility_counts(panel).where(F.col("n_eligible") >= F.col("n_quarters") * share)


def coverage_band(n: Column) -> Column:
    return F.when(n >= 5, "high").when(n >= 3, "adequate").when(n >= 1, "thin").otherwise("none")


def audit_flags(cells: DataFrame, estimates: DataFrame, prices: DataFrame, sources: DataFrame, stale_days: int = 60, adv_days: int = 30) -> DataFrame:
    """Per cell: coverage band, stale estimates, mean traded value of the last 30 trading days, and
    whether two sources of the same figure diverge by more than 2 % or 5 %."""
    recent = Window.partitionBy("firm").orderBy("d").rowsBetween(-(adv_days - 1), 0)
    traded = collapse_daily(prices, ["firm"], "d", ["dollar_volume"]).withColumn("adv", F.avg("dollar_volume").over(recent))
    rows = pit.asof_join(cells.select(*pit.CELL), traded, ["firm"], "t", "d", ["adv"], panel=True, daily=True)
    rows = rows.join(estimates.select(*pit.CELL, "n_analysts", "estimate_age_days"), pit.CELL, "left")
    rows = rows.join(sources.select("firm", "fpe", "primary_value", "check_value"), ["firm", "fpe"], "left")
    gap = F.abs(F.try_divide(F.col("check_value") - F.col("primary_value"), F.col("primary_value")))
    flag = F.when(gap > 0.05, "over_5pct").when(gap > 0.02, "over_2pct").when(gap.isNotNull(), "ok")
    return rows.select(*pit.CELL, coverage_band(F.coalesce("n_analysts", F.lit(0))).alias("coverage_band"), (F.col("estimate_age_days") > stale_days).alias("stale"), "adv", flag.alias("source_gap"))
