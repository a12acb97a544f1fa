"""What was knowable at T: bitemporal filters, as-of lookups and date windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import dates
from pitspark.operators.core import asof_join, first_n, group_summary, nth_row_after, salted_join, window_join, window_mean

CELL = ["firm", "fpe", "t"]


def asof_fundamentals(cells: DataFrame, fundq: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fundamentals known at T. Rows become effective at their announcement date, or period end when
    it is missing; the search runs in period order and stops at the first row not yet effective. A row
    is therefore reached once the running maximum of effective dates has passed, and that maximum is
    the time axis of an ordinary as-of join."""
    effective = F.coalesce("rdq", "datadate")
    reach = F.max(effective).over(Window.partitionBy("firm").orderBy("datadate").rowsBetween(Window.unboundedPreceding, 0))
    return asof_join(cells, fundq.withColumn("reach", reach), ["firm"], "t", "reach", ["datadate", *cols], panel=True)


def active_estimates(est: DataFrame, cells: DataFrame) -> DataFrame:
    """Estimates in force at T: announced by T, and never revised (revision date missing or equal to
    the announcement) or revised only after T. A row without a value is no estimate and hides none."""
    in_force = F.col("revdats").isNull() | (F.col("revdats") == F.col("anndats")) | (F.col("revdats") > F.col("t"))
    e = est.where("value IS NOT NULL").select("firm", "fpe", "analyst", "anndats", "revdats", "value", "row_id")
    return salted_join(cells.select(*CELL), e, ["firm", "fpe"], "row_id").where((F.col("anndats") <= F.col("t")) & in_force)


def latest_per_analyst(active: DataFrame) -> DataFrame:
    """Each analyst's last estimate in a cell; same day: the first in source order, rows without a number last. A blank analyst is
    one analyst. The choice is an aggregate, so it is made before the shuffle as far as possible; day
    and row are ordered as one decimal, which the hash aggregate can hold."""
    day = F.datediff("anndats", F.lit("1970-01-01").cast("date")).cast("decimal(10,0)")
    order = day * F.lit("10000000000000000000").cast("decimal(20,0)") - F.coalesce("row_id", F.lit(2**63 - 1)).cast("decimal(20,0)")
    newest = F.max_by("value", order).alias("value")
    return active.withColumn("analyst", F.coalesce(F.col("analyst").cast("string"), F.lit(""))).groupBy(*CELL, "analyst").agg(newest)


def consensus_at(est: DataFrame, cells: DataFrame) -> DataFrame:
    """Count, median, mean and sample deviation of the estimates in force at each cell's T. One
    estimate has deviation 0; without estimates the statistics are NULL."""
    per_analyst = latest_per_analyst(active_estimates(est, cells))
    stats = group_summary(per_analyst, CELL, "value", {"median_value": 0.5})
    out = cells.select(*CELL).join(stats, CELL, "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return out.select(*CELL, n.alias("n_analysts"), "median_value", F.col("mean").alias("mean_value"), F.when(n > 0, F.coalesce("sd", F.lit(0.0))).alias("dispersion"))


def consensus_with_stops(est: DataFrame, cells: DataFrame, horizons: Sequence[int] = (6, 7, 8, 9)) -> DataFrame:
    """Strict variant over every estimate in force: a revision or a stop date must lie after T, and
    only the given forecast horizons count. Adds the newest announcement and its age in days."""
    def still_open(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) > F.col("t"))

    rows = salted_join(cells.select(*CELL), est.where(F.col("fpi").isin(*horizons)), ["firm", "fpe"], "row_id")
    rows = rows.where((F.col("anndats") <= F.col("t")) & still_open("revdats") & still_open("stopdats"))
    stats = group_summary(rows, CELL, "value", {"median_value": 0.5}, extra={"newest_anndats": F.max("anndats")})
    analysts = rows.select(*CELL, "analyst").distinct().groupBy(*CELL).agg(F.count("analyst").alias("n_analysts"))
    age = F.datediff("t", "newest_anndats").alias("estimate_age_days")
    return stats.join(analysts, CELL).select(*CELL, "n_analysts", "median_value", F.col("mean").alias("mean_value"), F.col("sd").alias("dispersion"), "newest_anndats", age)


def mask_permits(permits: DataFrame, cells: DataFrame) -> DataFrame:
    """Each cell's permits filed by T, with later filings hidden while they lie after T."""
    rows = salted_join(cells.select(*CELL), permits, ["firm"], "pad_id").where(F.col("permit_date") <= F.col("t"))
    known = {c: F.when(F.col(c) <= F.col("t"), F.col(c)) for c in ("spud_date", "completion_date")}
    return rows.withColumns(known)


def previous_event(earnings: DataFrame, fallback_days: int = 90) -> DataFrame:
    """Event date of the firm's previous fiscal quarter in the whole calendar, else 90 days back."""
    prev = F.lag("ed").over(Window.partitionBy("firm").orderBy("fpe"))
    return earnings.withColumn("prev_ed", F.coalesce(prev, F.date_sub("ed", fallback_days)))


def first_actual_date(est: DataFrame) -> DataFrame:
    """Earliest reported announcement per firm and quarter, and T. The minimum is taken over the text."""
    text = F.nullif(F.trim("anndats_act"), F.lit(""))
    first = est.groupBy("firm", "fpe").agg(F.min(text).alias("_a")).withColumn("ed", F.try_to_date("_a", "yyyy-MM-dd"))
    return first.where("ed IS NOT NULL").select("firm", "fpe", "ed", dates.decision_date("ed").alias("t"))


def articles_in_window(articles: DataFrame, cells: DataFrame, key: str, cell_key: Sequence[str], matches: Column, limit: int = params.NEWS_FETCH_LIMIT) -> DataFrame:
    """First ``limit`` matching articles of each cell published from the previous event through T, by
    date and id. The text is matched in full before the join and then dropped."""
    slim = articles.where(matches).select(key, "article_id", "publish_date")
    hits = window_join(cells.select(key, *[c for c in cell_key if c != key], "prev_ed", "t"), slim, [key], "prev_ed", "t", "publish_date", "article_id")
    return first_n(hits.where("publish_date <= t"), cell_key, ["publish_date", "article_id"], limit, "position")


def available_at(df: DataFrame, availability: str, t) -> DataFrame:
    """Rows whose publication, not capture, date is on or before ``t`` (a column or a literal)."""
    return df.where(F.col(availability) <= t)


def price_asof(cells: DataFrame, prices: DataFrame, ts: str = "t", out: str = "px", value: str = "px", panel: bool = True) -> DataFrame:
    """Last price on or before the cell's date."""
    return asof_join(cells, prices.select("firm", "d", F.col(value).alias(out)), ["firm"], ts, "d", [out], panel=panel)


def exit_price(events: DataFrame, prices: DataFrame, event_ts: str = "ed", n: int = 2, out: str = "exit_price") -> DataFrame:
    """Price on the n-th trading day of the firm's own series strictly after the event."""
    return nth_row_after(events, prices, ["firm"], event_ts, "d", "px", n, out)


def trailing_return(cells: DataFrame, prices: DataFrame, end: Column, lookback_days: int, out: str) -> DataFrame:
    """Return from ``end - lookback`` to ``end``, both as-of; NULL when a price is missing or zero."""
    probes = cells.withColumns({"_e": end, "_b": F.date_sub(end, lookback_days)})
    both = price_asof(price_asof(probes, prices, "_e", "_pe"), prices, "_b", "_pb")
    return both.withColumn(out, F.try_divide(F.col("_pe") - F.col("_pb"), F.col("_pb"))).drop("_e", "_b", "_pe", "_pb")


def window_average(cells: DataFrame, series: DataFrame, start: Column, end: Column, value: str, out: str, default: float) -> DataFrame:
    """Mean of a market-wide series over [start, end] per decision date, both ends included."""
    return window_mean(cells, series, [], ["t"], start, end, "d", value, out, default)


def market_cap_asof(cells: DataFrame, prices: DataFrame, out: str = "market_cap") -> DataFrame:
    """Last close times shares outstanding (in thousands); NULL when that last row does not parse."""
    got = asof_join(cells, prices, ["firm"], "t", "d", ["close", "shrout"], panel=True)
    return got.withColumn(out, F.abs("close") * F.col("shrout") * 1000.0).drop("close", "shrout")


def listed_at(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """Whether the firm has any price row on or before T."""
    first = prices.groupBy("firm").agg(F.min("d").alias("_first"))
    return cells.join(first, "firm", "left").withColumn("listed", F.coalesce(F.col("_first") <= F.col("t"), F.lit(False))).drop("_first")


def carry_forward(grid: DataFrame, series: DataFrame, keys: Sequence[str], grid_ts: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """A sparse series carried forward onto a denser date grid."""
    return asof_join(grid, series, keys, grid_ts, ts, cols)
