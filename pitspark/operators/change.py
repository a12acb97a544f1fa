"""Change detection on repeated observations, cohort sampling and firm-quarter activity.

States are newly_active, continuously_active and idle. A pad cell is a pad with the (firm, fpe, t) of
its decision cell and, where known, its completion date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import dates, hashing, scoring
from pitspark.operators.core import first_n, group_summary, salted_join, window_join, with_scalar
from pitspark.operators.pit import CELL, mask_permits
from pitspark.session import materialize

PAD_CELL = ["pad_id", *CELL]
NEW, CONT, IDLE = params.STATES


def zonal_mean(pixels: DataFrame, pads: DataFrame, buffer: float = 0.005) -> DataFrame:
    """Mean of linear backscatter per pad and scene over the pixels in a box around the pad, then dB;
    masked (NaN) pixels count but take no part in a mean, VV means that are not finite and positive are
    dropped, and a VH mean that is not finite is NULL. A site seen in every scene is salted by scene. Pads are laid on a grid of box-sized cells
    (at most four each), so the spatial join is an equi-join on the grid cell."""
    size = 2 * buffer

    def tiles(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - buffer) / size), F.floor((F.col(c) + buffer) / size)))

    boxes = pads.select("pad_id", "lat", "lon").withColumn("_i", tiles("lat")).withColumn("_j", tiles("lon"))
    px = pixels.select("scene_id", F.col("lat").alias("_la"), F.col("lon").alias("_lo"), "vv", "vh", F.floor(F.col("lat") / size).alias("_i"), F.floor(F.col("lon") / size).alias("_j"))
    inside = F.col("_la").between(F.col("lat") - buffer, F.col("lat") + buffer) & F.col("_lo").between(F.col("lon") - buffer, F.col("lon") + buffer)
    hits = salted_join(boxes, px, ["_i", "_j"], "scene_id").where(inside)

    def mean(c: str) -> Column:
        return F.avg(F.when(~F.isnan(c), F.col(c)))

    means = hits.groupBy("pad_id", "scene_id").agg(mean("vv").alias("vv"), mean("vh").alias("vh"), F.count(F.lit(1)).alias("n_pixels"))
    means = means.withColumn("vh", F.when(F.abs("vh") < float("inf"), F.col("vh")))
    return means.withColumn("vv_db", scoring.linear_to_db("vv")).where("vv_db IS NOT NULL")


def classify_rise(obs: DataFrame, pad_cells: DataFrame, activation: float = params.RISE_NEW_DB, sustained: float = params.RISE_SUSTAINED_DB) -> DataFrame:
    """State from the rise of mean backscatter: the quarter [q-91, min(q, T)] against the baseline
    [q-365, q-91). Observations are first summed per pad and day, so a pad with very many of them
    still joins as one row per day."""
    day = obs.groupBy("pad_id", "acq").agg(F.sum("vv_db").alias("_s"), F.count("vv_db").alias("_n"))
    q, last = F.col("fpe"), F.least("fpe", "t")
    windows = pad_cells.select(*PAD_CELL, F.date_sub(q, 365).alias("_a"), last.alias("_b"))
    hits = window_join(windows, day, ["pad_id"], "_a", "_b", "acq")
    current = F.col("acq") >= F.date_sub(q, 91)

    def mean(cond: Column) -> Column:
        return F.try_divide(F.sum(F.when(cond, F.col("_s"))), F.sum(F.when(cond, F.col("_n"))))

    means = hits.groupBy(*PAD_CELL).agg(mean(current).alias("cur_db"), mean(~current).alias("base_db"), F.sum("_n").alias("n_obs"))
    rows = pad_cells.join(means, PAD_CELL, "left")
    recent = F.coalesce(F.col("completion_date").between(F.date_sub(q, 8 * 91), F.col("t")), F.lit(False))
    delta = F.col("cur_db") - F.col("base_db")
    state = (
        F.when(F.col("cur_db").isNull(), IDLE)
        .when(F.col("base_db").isNull(), F.when(recent, CONT).otherwise(IDLE))
        .when((delta >= activation) & ~recent, NEW)
        .when((delta >= sustained) & recent, CONT)
        .otherwise(IDLE)
    )
    return rows.withColumns({"state": state, "delta_db": delta, "n_obs": F.coalesce("n_obs", F.lit(0).cast("bigint"))})


def classify_drop(obs: DataFrame, pad_cells: DataFrame, new: float = params.DROP_NEW_DB, sustained: float = params.DROP_SUSTAINED_DB) -> DataFrame:
    """Older rule: drop of the upper median between two windows of publication dates. The current
    window starts on the first of the month of q-92 days, the prior one 92 days and a month start
    earlier. Without both medians the pad is idle with change 0 and a note."""
    q = F.col("fpe")
    start = F.trunc(F.date_sub(q, 92), "month")
    windows = pad_cells.select("pad_id", "fpe", F.trunc(F.date_sub(start, 92), "month").alias("_a"), start.alias("_q0"), q.alias("_b"))
    spread = F.xxhash64(*[c for c in ("scene_id", "pad_id", "published", "vv_db") if c in obs.columns]).alias("_row")
    hits = window_join(windows, obs.select("pad_id", "published", "vv_db", spread), ["pad_id"], "_a", "_b", "published", "_row")
    hits = hits.select("pad_id", "fpe", F.when(F.col("published") >= F.col("_q0"), "cur").otherwise("prior").alias("_seg"), "vv_db")
    # The summary reads its rows several times (sizes, small and large groups): the join is run once for all.
    med = group_summary(materialize(hits, "drop-windows"), ["pad_id", "fpe", "_seg"], "vv_db", upper_median="m")

    def of(seg: str, c: str) -> Column:
        return F.max(F.when(F.col("_seg") == seg, F.col(c)))

    both = med.groupBy("pad_id", "fpe").agg(of("cur", "m").alias("_c"), of("prior", "m").alias("_p"), of("cur", "n").alias("_n"))
    rows = pad_cells.select("pad_id", "fpe").join(both, ["pad_id", "fpe"], "left")
    delta = F.col("_c") - F.col("_p")
    state = F.when(delta <= new, NEW).when(delta <= sustained, CONT).otherwise(IDLE)
    return rows.select(
        "pad_id", "fpe", state.alias("state"), F.coalesce(delta, F.lit(0.0)).alias("change_db"),
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_obs"), F.when(delta.isNull(), "insufficient observations").otherwise("").alias("notes"),
    )


def truth_state(masked: DataFrame) -> DataFrame:
    """State from filings known at T: spud inside the quarter; else completed before the quarter and
    not earlier than the first of the same month two years back; else idle."""
    q = F.col("fpe")
    start = dates.quarter_start(q)
    oldest = F.trunc(F.add_months(q, -24), "month")
    done = F.col("completion_date")
    return masked.withColumn("truth", F.when(F.col("spud_date").between(start, q), NEW).when((done >= oldest) & (done < start), CONT).otherwise(IDLE))


def apply_confusion(df: DataFrame, setting: str = "target", key: Sequence[str] = ("firm", "fpe", "pad_id"), truth: str = "truth", out: str = "observed") -> DataFrame:
    """Label noise: draw the observed state with the probabilities of the true state's row. The draw
    is a hash of the row's key and the setting, so it does not depend on partitioning."""
    u = hashing.unit_draw(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(setting)))
    rates = params.CONFUSION[setting]
    upto_new = scoring.lookup(F.col(truth), {s: r[0] for s, r in rates.items()})
    upto_cont = scoring.lookup(F.col(truth), {s: r[0] + r[1] for s, r in rates.items()})
    return df.withColumn(out, F.when(u < upto_new, NEW).when(u < upto_cont, CONT).otherwise(IDLE))


def sample_pads(permits: DataFrame, cells: DataFrame, n: int = 5) -> DataFrame:
    """Up to n pads per firm and quarter, dealt in turn from three cohorts in pad order: drilling
    (permit in the last 180 days, not completed by q), completed in the last 730 days, completed earlier.

    Pads with the same firm, permit and completion days are in the same cohort of any quarter, so the first n of
    them are all that can be chosen. The recent cohorts are windows of fixed length from such a day, joined by month.
    The oldest one is open to the past: of pads that enter it in one calendar quarter again only the first n matter
    later, and the first n of all quarters so far are carried along these few rows. So no quarter meets all permits of
    a firm."""
    q, done, fields = F.col("fpe"), F.col("completion_date"), ["pad_id", "permit_date", "completion_date"]
    rows = cells.select(*CELL).distinct()
    few = first_n(permits.select("firm", *fields), ["firm", "permit_date", "completion_date"], ["pad_id"], n).drop("_rn")
    by_quarter = rows.select("firm", q.alias("_q")).distinct()

    def recent(since: str, days: int, also: Column, cohort: int) -> DataFrame:
        windows = few.where(F.col(since).isNotNull()).withColumns({"_a": F.col(since), "_b": F.date_add(since, days)})
        hits = window_join(windows, by_quarter, ["firm"], "_a", "_b", "_q").where(also)
        return hits.select("firm", F.col("_q").alias("fpe"), *fields, F.lit(cohort).alias("cohort"))

    drilling = recent("permit_date", 180, done.isNull() | (done > F.col("_q")), 0)
    completed = recent("completion_date", 730, F.lit(True), 1)

    entering = few.where(done.isNotNull()).withColumns({"_in": F.date_add("completion_date", 731), "_e": dates.quarter_end(F.date_add("completion_date", 731))})
    binned = first_n(entering, ["firm", "_e"], ["pad_id"], n).groupBy("firm", "_e").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_pads"))
    bins = binned.select("firm", F.date_add("_e", 1).alias("_d"), F.lit(0).alias("_probe"), "_pads")
    marks = bins.unionByName(by_quarter.select("firm", F.col("_q").alias("_d"), F.lit(1).alias("_probe")), allowMissingColumns=True)
    so_far = F.collect_list("_pads").over(Window.partitionBy("firm").orderBy("_d", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    merged = F.reduce(so_far, F.array().cast(binned.schema["_pads"].dataType), lambda got, more: F.slice(F.array_sort(F.concat(got, more)), 1, n))
    before = marks.withColumn("_pads", merged).where("_probe = 1").select("firm", F.col("_d").alias("fpe"), F.inline("_pads"))
    within = by_quarter.withColumn("_e", dates.quarter_end("_q")).join(entering, ["firm", "_e"]).where(F.col("_in") <= F.col("_q")).select("firm", F.col("_q").alias("fpe"), *fields)
    oldest = before.unionByName(within).withColumn("cohort", F.lit(2))

    pads = drilling.unionByName(completed).unionByName(oldest)
    dealt = first_n(rows.join(pads, ["firm", "fpe"]), [*CELL, "cohort"], ["pad_id"], n, "in_cohort")
    return first_n(dealt, CELL, ["in_cohort", "cohort"], n, "deal")


def rollup_firm_quarter(pad_states: DataFrame, cells: DataFrame, state: str = "state", n_obs: str | None = None) -> DataFrame:
    """Counts per state, active pads and their share for every cell; cells without pads give zeros."""
    def count(*states: str) -> Column:
        return F.count_if(F.col(state).isin(*states))

    total_obs = F.sum(n_obs) if n_obs else F.lit(0).cast("bigint")
    agg = pad_states.groupBy(*CELL).agg(
        count(NEW).alias("n_new"), count(CONT).alias("n_cont"), count(IDLE).alias("n_idle"), count(NEW, CONT).alias("absolute_active"),
        F.count(state).alias("total_monitored"), total_obs.alias("n_obs"),
    )
    out = cells.select(*CELL).join(agg, CELL, "left").na.fill(0, ["n_new", "n_cont", "n_idle", "absolute_active", "total_monitored", "n_obs"])
    return out.withColumn("share_active", F.coalesce(F.try_divide("absolute_active", "total_monitored"), F.lit(0.0)))


def observed_activity(permits: DataFrame, cells: DataFrame, setting: str | None = "target") -> DataFrame:
    """Permits known at T, their state, label noise if a setting is given, and the firm-quarter counts."""
    states = truth_state(mask_permits(permits, cells))
    states = apply_confusion(states, setting) if setting else states.withColumn("observed", F.col("truth"))
    return rollup_firm_quarter(states, cells, "observed")


def shifted_cells(cells: DataFrame, quarters: int = 4) -> DataFrame:
    """Each cell's earlier quarters k=1..n with their own decision date T - 91k; keeps the origin."""
    k = F.col("k")
    rows = cells.select(F.col("firm"), F.col("fpe").alias("fpe0"), F.col("t").alias("t0"), F.explode(F.sequence(F.lit(1), F.lit(quarters))).alias("k"))
    return rows.select("firm", "fpe0", "t0", "k", dates.prior_quarter_end("fpe0", k).alias("fpe"), F.date_sub("t0", k * 91).alias("t"))


def trailing_quarter_avg(permits: DataFrame, cells: DataFrame, setting: str | None = "target", quarters: int = 4) -> DataFrame:
    """Mean active pads of the four earlier quarters, each seen with what was known at its own T."""
    shifted = shifted_cells(cells, quarters)
    activity = observed_activity(permits, shifted.select(*CELL).distinct(), setting)
    means = shifted.join(activity.select(*CELL, "absolute_active"), CELL).groupBy("firm", "fpe0", "t0").agg(F.avg("absolute_active").alias("trailing_avg"))
    return cells.select(*CELL).join(means.withColumnsRenamed({"fpe0": "fpe", "t0": "t"}), CELL, "left")


def trailing_from_history(activity: DataFrame, quarters: int = 4, floor_share: float = 0.3) -> DataFrame:
    """Mean active pads over those earlier aggregates that exist for exactly (firm, q_k, T - 91k) and
    have pads; with none, 0.3 of the pads now monitored (at least one)."""
    past = activity.where("total_monitored > 0").select(*CELL, "absolute_active")
    means = shifted_cells(activity, quarters).join(past, CELL).groupBy("firm", "fpe0", "t0").agg(F.avg("absolute_active").alias("_m"))
    rows = activity.join(means.withColumnsRenamed({"fpe0": "fpe", "t0": "t"}), CELL, "left")
    return rows.withColumn("trailing_avg", F.coalesce("_m", F.greatest(F.lit(1), "total_monitored") * floor_share)).drop("_m")


def relative_activity(activity: DataFrame) -> DataFrame:
    """Active pads against the trailing mean, and the signal: the ratio where the mean exceeds 1."""
    delta = F.col("absolute_active") - F.col("trailing_avg")
    return activity.withColumns({"relative_delta": delta, "signal": F.when(F.col("trailing_avg") > 1.0, delta / F.col("trailing_avg")).otherwise(0.0)})


def match_events(predicted: DataFrame, truth: DataFrame, window_days: int = params.MATCH_WINDOW_DAYS) -> DataFrame:
    """Per pad and quarter: is a newly active prediction backed by a filed event in [q-92, q+window]?
    The event kept is the first in source order; its date counts, and that of the detection, the quarter's
    end, where one was predicted. Events are first reduced to the first row per pad and day, so a pad has at
    most one per day in the join."""
    windows = predicted.select("pad_id", "fpe", F.date_sub("fpe", 92).alias("_a"), F.date_add("fpe", window_days).alias("_b"))
    daily = truth.groupBy("pad_id", "event_date").agg(F.min("row_id").alias("row_id"))
    hits = window_join(windows, daily, ["pad_id"], "_a", "_b", "event_date")
    first = hits.groupBy("pad_id", "fpe").agg(F.min_by("event_date", "row_id").alias("event_date"))
    rows = predicted.select("pad_id", "fpe", "state").join(first, ["pad_id", "fpe"], "left")
    says, is_ = F.col("state") == NEW, F.col("event_date").isNotNull()
    return rows.withColumns({"detection_date": F.when(says, F.col("fpe")), "predicted": says, "actual": is_, "matched": says == is_})


def validation_summary(matches: DataFrame, precision_goal: float = params.TARGET_PRECISION, recall_goal: float = params.TARGET_RECALL) -> DataFrame:
    p, a = F.col("predicted"), F.col("actual")
    counts = matches.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))

    def rate(other: str) -> Column:
        return F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), F.lit(0.0))

    rated = counts.withColumns({"precision": rate("fp"), "recall": rate("fn")})
    return rated.withColumn("passes", (F.col("precision") >= precision_goal) & (F.col("recall") >= recall_goal))


def thin_coverage(obs: DataFrame, pads: DataFrame, minimum: int = 30) -> DataFrame:
    """Pad-years with fewer acquisitions than the minimum, those without any included. The years are
    those that any pad was observed in, one per calendar year, so their list is bounded."""
    per = obs.groupBy("pad_id", F.year("acq").alias("year")).agg(F.count(F.lit(1)).alias("n_obs"))
    years = per.agg(F.collect_set("year").alias("_years"))
    due = with_scalar(pads.select("pad_id").distinct(), years).select("pad_id", F.explode("_years").alias("year"))
    return due.join(per, ["pad_id", "year"], "left").na.fill(0, ["n_obs"]).where(F.col("n_obs") < minimum)


def malformed_files(texts: DataFrame, key: str, col: str, schema: str = "array<struct<pad_id:string>>") -> DataFrame:
    """Observation files per key whose text is no JSON array: how many, of how many."""
    bad = F.col(col).isNull() | F.from_json(col, schema).isNull()
    return texts.groupBy(key).agg(F.count_if(bad).alias("n_malformed"), F.count(F.lit(1)).alias("n_files"))


def coverage_by_firm(activity: DataFrame) -> DataFrame:
    """Firm-quarter aggregates with at least one pad, and the quarters they span."""
    return activity.where("total_monitored > 0").groupBy("firm").agg(F.count(F.lit(1)).alias("n_aggregates"), F.count_distinct("fpe").alias("n_quarters"))


def confusion_report(df: DataFrame, truth: str = "truth", observed: str = "observed") -> DataFrame:
    """Cross table of true and observed states with the share of each true state recovered."""
    table = df.groupBy(truth).agg(*[F.count_if(F.col(observed) == s).alias(s) for s in params.STATES], F.count_if(F.col(observed) == F.col(truth)).alias("hits"), F.count(F.lit(1)).alias("n"))
    return table.withColumn("recall", F.col("hits") / F.col("n"))


def active_quarters(permits: DataFrame) -> DataFrame:
    """(firm, pad_id, permit_date, quarter, state): the at most nine quarters in which a pad is newly or continuously
    active by its filings: the one of its spud date, and the eight after that of its completion. What holds in each
    is decided by the rule for any quarter."""
    fields = ["firm", "pad_id", "permit_date", "spud_date", "completion_date"]
    after = [dates.quarter_end(F.add_months("completion_date", 3 * k)) for k in range(1, 9)]
    near = permits.select(*fields, F.explode(F.array_distinct(F.array(dates.quarter_end(F.col("spud_date")), *after))).alias("fpe")).where("fpe IS NOT NULL")
    return truth_state(near).where(F.col("truth") != IDLE).select("firm", "pad_id", "permit_date", F.col("fpe").alias("quarter"), F.col("truth").alias("state"))


def active_pads_at(panel: DataFrame, cells: DataFrame, lag_days: int = 90) -> DataFrame:
    """Pads permitted by T that are active in the quarter holding T - 90 days. ``panel`` has (firm, quarter, pad_id,
    permit_date, state). Pads are counted per firm, quarter and permit day before they meet the cells, so a firm's
    cell joins a row per day at most."""
    probe = cells.select(*CELL, dates.quarter_end(F.date_sub("t", lag_days)).alias("quarter"))
    active = panel.where(F.col("state").isin(NEW, CONT)).groupBy("firm", "quarter", "pad_id").agg(F.min("permit_date").alias("permit_date"))
    daily = active.groupBy("firm", "quarter", "permit_date").agg(F.count(F.lit(1)).alias("_n"))
    hits = probe.join(daily, ["firm", "quarter"]).where("permit_date <= t").groupBy(*CELL).agg(F.sum("_n").alias("n_active"))
    return cells.select(*CELL).join(hits, CELL, "left").na.fill(0, ["n_active"])


def top_sites(obs: DataFrame, n: int = 300) -> DataFrame:
    """The n most observed pads; ties by pad."""
    per = obs.groupBy("pad_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return per.orderBy(F.col("n_obs").desc(), "pad_id").limit(n)

