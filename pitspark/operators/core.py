"""Building blocks that keep working when one key holds a large part of all rows.

The time axis of an event study is the calendar day. So the first step of every ordered operator is
a partial aggregation to one row per (key, day), which Spark does before it shuffles; after it no key
holds more rows than there are days, and a window over a key is small whatever the input size. Where
the unit is finer than the day, rows are cut into ordered blocks: totals per block are scanned (few
rows), and only the rows of one block meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions.hashing import hash_prefix
from pitspark.session import materialize

SMALL_GROUP_ROWS = 1_000_000
VALUE_BINS = 1024
SALTS = 32


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row, so safe to broadcast)."""
    one = one_row.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join in which NULL is a key like any other; the keys are kept once."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(named, same).drop(*[f"_r_{c}" for c in on])


def salted_join(small: DataFrame, big: DataFrame, on: Sequence[str], spread_by: str, salts: int = SALTS) -> DataFrame:
    """Inner join of a table with few rows per key to one where a key may hold a large part of all
    rows. Rows of the big side get a salt from their own id and the small side is repeated per salt,
    so a key is joined by many tasks. As the join is then not clustered on the key alone, a following
    aggregation is done in part before it shuffles, instead of wholly inside the hot key's task."""
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return repeated.join(spread, [*on, "_salt"]).drop("_salt")


def collapse_daily(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """One row per (keys, day): the greatest tuple of ``cols`` when a day repeats."""
    dated = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts)
    if len(cols) == 1:  # a plain maximum stays in the hash aggregate
        return dated.agg(F.max(cols[0]).alias(cols[0]))
    picked = dated.agg(F.max(F.struct(*cols)).alias("_v"))
    return picked.select(*keys, ts, "_v.*")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    cols: Sequence[str],
    *,
    panel: bool = False,
    daily: bool = False,
) -> DataFrame:
    """Backward, inclusive as-of join on DATE columns: each left row gets ``cols`` of the last right
    row of its key with ``right_ts <= left_ts``, or NULLs. Same-day right rows: greatest tuple.

    Right rows are collapsed to days and left rows to distinct (key, day) probes before they meet in
    one window, so a hot key costs at most (days + probe days) rows in its task; the left rows
    themselves only take part in an equi-join on (key, day). Set ``panel`` when ``left`` has few rows
    per key (one per quarter, say): its rows then ride through the window and no second join is
    needed. Set ``daily`` when ``right`` already has one row per (key, day)."""
    keys = list(keys)
    if not daily:
        right = collapse_daily(right, keys, right_ts, cols)
    series = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*cols).alias("_v"))
    win = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last_seen = F.last("_v", ignorenulls=True).over(win)
    if panel:
        probes = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
        both = series.unionByName(probes, allowMissingColumns=True)
        hit = both.withColumn("_v", last_seen).where("_side = 1")
        return hit.select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in cols])
    probes = left.select(*keys, F.col(left_ts).alias("_t")).where(F.col("_t").isNotNull()).distinct().withColumn("_side", F.lit(1))
    both = series.unionByName(probes, allowMissingColumns=True)
    hit = both.withColumn("_v", last_seen).where("_side = 1").select(*keys, F.col("_t").alias(left_ts), "_v")
    out = left.join(hit, [*keys, left_ts], "left")
    return out.select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in cols])


def nth_row_after(events: DataFrame, prices: DataFrame, keys: Sequence[str], event_ts: str, ts: str, value: str, n: int, out: str) -> DataFrame:
    """Value on the n-th day of the key's own series strictly after the event; NULL when the series
    ends earlier. Adds ``out`` and ``out_date``."""
    series = collapse_daily(prices, keys, ts, [value])
    before_all = series.select(*keys).distinct().select(*keys, F.to_date(F.lit("0001-01-01")).alias(ts), F.lit(None).cast("double").alias(value))
    ahead = F.lead(F.struct(F.col(value).alias(out), F.col(ts).alias(f"{out}_date")), n).over(Window.partitionBy(*keys).orderBy(ts))
    calendar = series.unionByName(before_all).select(*keys, ts, ahead.alias("_ahead")).select(*keys, ts, f"_ahead.{out}", f"_ahead.{out}_date")
    return asof_join(events, calendar, keys, event_ts, ts, [out, f"{out}_date"], daily=True, panel=True)


def months_touched(start: Column, end: Column) -> Column:
    """First days of the months that [start, end] touches; none for an empty window."""
    return F.when(start <= end, F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))


def window_join(windows: DataFrame, rows: DataFrame, keys: Sequence[str], start: str, end: str, ts: str, spread_by: str | None = None) -> DataFrame:
    """Rows of ``rows`` that fall in [start, end] of a window of the same key. Windows are cut into
    the months they touch, which turns the range join into an equi-join on (keys, month); the exact
    bounds are a residual condition. Name an id in ``spread_by`` when the rows are not collapsed to
    days, so that one crowded month is salted over several tasks."""
    cut = windows.withColumn("_m", F.explode(months_touched(F.col(start), F.col(end))))
    rows = rows.withColumn("_m", F.trunc(ts, "month"))
    on = [*keys, "_m"]
    joined = salted_join(cut, rows, on, spread_by, 8) if spread_by else cut.join(rows, on)
    return joined.where(F.col(ts).between(F.col(start), F.col(end))).drop("_m")


def window_mean(cells: DataFrame, series: DataFrame, keys: Sequence[str], cell_key: Sequence[str], start: Column, end: Column, ts: str, value: str, out: str, default: float | None = None) -> DataFrame:
    """Mean of the series over [start, end] per cell, both ends included; ``default`` when empty.
    The series is first summed per day, the means are taken over distinct windows."""
    day = series.groupBy(*keys, ts).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    windows = cells.select(*dict.fromkeys([*keys, *cell_key]), start.alias("_a"), end.alias("_b")).distinct()
    means = (
        window_join(windows, day, keys, "_a", "_b", ts)
        .groupBy(*cell_key)
        .agg((F.sum("_s") / F.sum("_n")).alias(out))
    )
    joined = cells.join(means, list(cell_key), "left")
    return joined if default is None else joined.withColumn(out, F.coalesce(out, F.lit(default)))


def block_scan(df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column] | None = None, maxes: Mapping[str, Column] | None = None, desc: bool = False) -> DataFrame:
    """Inclusive running sums and maxima of each key's rows in the given order, without putting a key
    in one task. ``block`` must be non-decreasing (non-increasing with ``desc``) along the order and
    take a bounded number of values per key."""
    sums, maxes = dict(sums or {}), dict(maxes or {})
    part = [*keys, *block]
    totals = df.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()], *[F.max(c).alias(f"_t_{k}") for k, c in maxes.items()])
    block_order = [F.col(b).desc() if desc else F.col(b) for b in block]
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*block_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part,
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.max(f"_t_{k}").over(earlier).alias(f"_o_{k}") for k in maxes],
    )
    here = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(df, offsets, part)
    out = out.withColumns({
        **{k: F.col(f"_o_{k}") + F.sum(c).over(here) for k, c in sums.items()},
        **{k: F.greatest(F.col(f"_o_{k}"), F.max(c).over(here)) for k, c in maxes.items()},
    })
    return out.drop(*[f"_o_{k}" for k in [*sums, *maxes]])


def range_blocks(df: DataFrame, order: Sequence[Column | str], block: str = "_block") -> DataFrame:
    """The rows with the number of an ordered block each: sorted by range over the tasks of a shuffle, whose borders
    Spark takes from the rows themselves, so blocks are about equally full whatever key, day or value is crowded.
    Only rows that are equal in the whole order stay together. Borders come from a sample that a second run may draw
    anew, so the numbered rows are written once; both the totals of the blocks and the rows are then read from there."""
    return materialize(df.repartitionByRange(*order).withColumn(block, F.spark_partition_id()), "blocks")


def value_bin(value: Column, lo: Column, hi: Column, bins: int = VALUE_BINS) -> Column:
    """Bin number that never falls as the value rises: equal steps on a signed log scale. It depends
    on the group's extremes only, so recomputing it after a lost executor gives the same bins."""

    def scale(c: Column) -> Column:
        return F.signum(c) * F.log1p(F.abs(c))

    width = scale(hi) - scale(lo)
    step = F.floor((scale(value) - scale(lo)) / width * F.lit(bins))
    return F.when(width > 0, F.least(step, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def ranked(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column | str], out: str, desc: bool = True) -> DataFrame:
    """Full ranking of each key's rows by value, 1 first, NULL values unranked; ties by ``ties``.
    Rows of a key are spread over value bins, so ranking a key does not need one task."""
    has = df.where(F.col(value).isNotNull())
    span = has.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    binned = (join_null_safe(has, span, keys) if keys else with_scalar(has, span)).withColumn("_bin", value_bin(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    order = [F.col(value).desc() if desc else F.col(value).asc(), *ties]
    numbered = block_scan(binned, keys, ["_bin"], order, sums={out: F.lit(1).cast("bigint")}, desc=desc).drop("_bin")
    return numbered.unionByName(df.where(F.col(value).isNull()), allowMissingColumns=True)


def dense_index(df: DataFrame, keys: Sequence[str], item: str, out: str = "idx") -> DataFrame:
    """Number the rows of each key 0,1,2,... in the order (hash prefix, item). ``item`` is unique in a key."""
    prefix = hash_prefix(F.col(item))
    blocked = range_blocks(df, [*keys, prefix, item])
    return block_scan(blocked, keys, ["_block"], [prefix, item], sums={out: F.lit(1).cast("bigint")}).withColumn(out, F.col(out) - 1).drop("_block")


def group_summary(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float] | None = None, *, upper_median: str | None = None, extra: Mapping[str, Column] | None = None, small: int = SMALL_GROUP_ROWS) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles of a group's non-null values.

    Quantiles interpolate linearly between order statistics; ``upper_median`` names a column for the
    value at position n // 2 instead. Groups of at most ``small`` rows use the built-in exact
    percentile. Larger ones are cut into value bins: the bin that holds each wanted rank follows from
    the bin counts, and only that bin's distinct values are ordered. Both give the same numbers."""
    keys, quantiles, extra = list(keys), dict(quantiles or {}), dict(extra or {})
    rows = df.where(F.col(value).isNotNull())
    sizes = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"), F.max(value).alias("hi"), *[c.alias(k) for k, c in extra.items()],
    )
    wanted = {k: (F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p), (F.col("n") - 1) * p) for k, p in quantiles.items()}
    if upper_median:
        half = F.floor(F.col("n") / 2)
        wanted[upper_median] = (half, half, half.cast("double"))
    if not wanted:
        return sizes
    # At most (rows / small) groups are this large, so their list is broadcast: all rows of all groups would be
    # shuffled otherwise to meet a list that is mostly empty.
    hot = F.broadcast(sizes.where(F.col("n") > small).select(*keys, "n", "lo", "hi"))

    direct = [F.percentile(value, F.lit(p)).alias(k) for k, p in quantiles.items()]
    if upper_median:
        direct.append(F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)").alias(upper_median))
    cold_part = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").groupBy(*keys).agg(*direct)

    def narrowed(runs: DataFrame, group: list[str], bin_col: str) -> DataFrame:
        """Keep only the bins of each group that hold a wanted rank; ``_b0`` counts the rows before."""
        runs = runs.withColumn(bin_col, value_bin(F.col(value), F.col("lo"), F.col("hi")))
        bins = runs.groupBy(*group, "n", "_b0", bin_col).agg(F.sum("_c").alias("_bc"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        before = Window.partitionBy(*group).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_b0", F.col("_b0") + F.coalesce(F.sum("_bc").over(before), F.lit(0)))
        holds = F.lit(False)
        for ranks in wanted.values():
            for r in ranks[:2]:
                holds = holds | ((F.col("_b0") <= r) & (r < F.col("_b0") + F.col("_bc")))
        kept = bins.where(holds).drop("_bc", "n")
        return runs.drop("_b0", "lo", "hi").join(kept, [*group, bin_col])

    # Equal values are counted before they are shuffled by key and value, then two rounds of binning
    # leave about a millionth of a spread-out group to be ordered.
    runs = rows.join(hot, keys).groupBy(*keys, "n", "lo", "hi", value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b0", F.lit(0).cast("bigint"))
    near = narrowed(narrowed(runs, keys, "_bin"), [*keys, "_bin"], "_fine")
    upto = Window.partitionBy(*keys, "_bin", "_fine").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_e", F.col("_b0") + F.sum("_c").over(upto)).withColumn("_s", F.col("_e") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_s") <= rank) & (rank < F.col("_e")), F.col(value)))

    picks = near.groupBy(*keys, "n").agg(
        *[at(lo_rank).alias(f"_{k}_lo") for k, (lo_rank, _, _) in wanted.items()],
        *[at(hi_rank).alias(f"_{k}_hi") for k, (_, hi_rank, _) in wanted.items()],
    )

    def between(k: str, lo_rank: Column, hi_rank: Column, pos: Column) -> Column:
        a, b = F.col(f"_{k}_lo"), F.col(f"_{k}_hi")
        return F.when(lo_rank == hi_rank, a).otherwise((hi_rank - pos) * a + (pos - lo_rank) * b).alias(k)

    hot_part = picks.select(*keys, *[between(k, *ranks) for k, ranks in wanted.items()])
    return sizes.join(cold_part.unionByName(hot_part), keys)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in the given order. Spark keeps one row per key on each
    task before it shuffles (window group limit)."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "_rn") -> DataFrame:
    """The first ``n`` rows of each key in the given order, with their position in ``rank``."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, rn).where(F.col(rank) <= n)
