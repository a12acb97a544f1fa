"""Forecast, divergence, gate, sizing and verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import scoring
from pitspark.operators.core import first_n


def forecast(df: DataFrame, alpha: Column | float = params.ALPHA, unit: float = 1e6) -> DataFrame:
    """Revenue forecast per cell. With at least one analyst the consensus is moved by alpha times the
    clipped activity signal, and production is implied back from it; without one, production follows
    from the base, its decline and the new wells, and revenue from the oil price.

    Needs ticker, n_analysts, median_value, signal, n_new, n_cont and oil_avg."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    ticker = F.col("ticker")
    wells = scoring.lookup(ticker, params.WELLS_PER_PAD)
    realized = F.col("oil_avg") * scoring.lookup(ticker, params.PRICE_DIFFERENTIAL)
    share = scoring.lookup(ticker, params.REVENUE_SHARE)
    base = scoring.lookup(ticker, {k: float(v) for k, v in params.BASE_PRODUCTION.items()}, float(params.BASE_PRODUCTION_DEFAULT))
    per_day = realized * params.QUARTER_DAYS

    anchored = (F.col("n_analysts") >= 1) & F.col("median_value").isNotNull()
    moved = F.col("median_value") * unit * (1.0 + alpha * scoring.clip(F.col("signal"), -1.0, 1.0))
    implied = F.when((realized > 0) & (share > 0), moved * share / per_day).otherwise(0.0)

    built = base * params.QUARTERLY_DECLINE + (F.col("n_new") + F.col("n_cont")) * wells * params.NEW_WELL_RATE
    built_revenue = built * per_day
    return df.withColumns({
        "mode": F.when(anchored, "consensus_anchored").otherwise("structural"),
        "production": F.when(anchored, implied).otherwise(built),
        "basin_revenue": F.when(anchored, moved * share).otherwise(built_revenue),
        "forecast": F.when(anchored, moved).when(share > 0, built_revenue / share).otherwise(built_revenue),
    })


def divergence(df: DataFrame, strong: float = 15.0, modest: Column | float = 5.0, unit: float = 1e6) -> DataFrame:
    """Forecast against consensus: percentage, class (from the unrounded percentage) and confidence.
    Without coverage the cell is in line with low confidence."""
    covered = (F.col("n_analysts") > 0) & F.col("median_value").isNotNull()
    consensus, spread = F.col("median_value") * unit, F.coalesce("dispersion", F.lit(0.0)) * unit
    pct = F.when(covered, scoring.divergence_pct(F.col("forecast"), consensus)).otherwise(0.0)
    return df.withColumns({
        "divergence_pct": pct,
        "divergence_class": scoring.divergence_class(pct, strong, modest),
        "confidence": F.when(covered, scoring.confidence_tier(F.col("n_analysts"), spread, consensus)).otherwise("low"),
    })


def gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that may trade, and finished no-trade rows with the reason for all others."""
    go = scoring.passes_gate(F.col("divergence_class"))
    stopped = df.where(~F.coalesce(go, F.lit(False))).withColumns({
        "decision": F.lit("no_trade"), "conviction_tier": F.lit("none"), "size": F.lit(0.0),
        "reason": F.concat(F.lit("short_circuit_"), F.coalesce("divergence_class", F.lit("missing"))),
    })
    return df.where(go), stopped


def normalize_verdicts(df: DataFrame, text_limit: int = 3000) -> DataFrame:
    """Outside verdicts made regular: long/buy or no_trade, four tiers (synonyms mapped, the rest
    none), weights in [0, 1], at most three pieces of evidence, text cut to the limit."""
    word = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    tier = F.lower(F.trim(F.coalesce("conviction_tier", F.lit(""))))
    known = F.when(tier.isin(*params.TIER_SIZE), tier).otherwise(scoring.lookup(tier, params.TIER_SYNONYMS, "none"))
    changes = {"decision": F.when(word.isin("long", "buy"), "long").otherwise("no_trade"), "conviction_tier": known}
    if "weight" in df.columns:
        changes["weight"] = scoring.clip(F.coalesce("weight", F.lit(0.0)), 0.0, 1.0)
    if "evidence" in df.columns:
        changes["evidence"] = F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 3)
    if "reasoning" in df.columns:
        changes["reasoning"] = F.substring(F.coalesce("reasoning", F.lit("(no reasoning returned)")), 1, text_limit)
    return df.withColumns(changes)


def normalize_opinions(df: DataFrame, text_limit: int = 1500) -> DataFrame:
    """Outside opinions made regular: long/buy or no_trade, three confidence levels (the rest low), at
    most three pieces of evidence on either side, reasoning cut to the limit."""
    word = F.lower(F.trim(F.coalesce("direction", F.lit(""))))
    level = F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "direction": F.when(word.isin("long", "buy"), "long").otherwise("no_trade"),
        "confidence": F.when(level.isin("high", "medium", "low"), level).otherwise("low"),
        "key_evidence": F.slice(F.coalesce("key_evidence", none), 1, 3),
        "counter_evidence": F.slice(F.coalesce("counter_evidence", none), 1, 3),
        "reasoning_short": F.substring(F.coalesce("reasoning_short", F.lit("")), 1, text_limit),
    })


def size_position(df: DataFrame) -> DataFrame:
    """Tier to size. No trade has tier none and size 0; a long without a sized tier is no trade."""
    tier = F.when(F.col("decision") == "long", F.col("conviction_tier")).otherwise("none")
    size = scoring.tier_size(tier)
    return df.withColumns({
        "decision": F.when(size > 0, "long").otherwise("no_trade"),
        "conviction_tier": F.when(size > 0, tier).otherwise("none"),
        "size": size,
    })


def downgrade_tier(df: DataFrame, disclosed: str = "disclosed") -> DataFrame:
    """One tier lower where the news already disclosed the activity."""
    tier = F.col("conviction_tier")
    return df.withColumn("conviction_tier", F.when(F.coalesce(disclosed, F.lit(False)), scoring.downgraded(tier)).otherwise(tier))


def decide(scored: DataFrame, verdicts: DataFrame, keys: list[str], downgrade: bool = False) -> DataFrame:
    """Gate the scored cells, attach the normalised verdict to those that pass, size them, and add the
    finished rows of the others. A passing cell without a verdict is no trade."""
    passing, stopped = gate(scored)
    judged = normalize_verdicts(passing.join(verdicts, keys, "left"))
    if downgrade:
        judged = downgrade_tier(judged)
    done = size_position(judged).withColumn("reason", F.lit("ok"))
    cols = [*scored.columns, "decision", "conviction_tier", "size", "reason"]
    return done.select(*cols).unionByName(stopped.select(*cols))


def explode_opinions(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per role from the nested opinions of a decision; the deciding role comes last."""
    def row(role: str, who: str) -> Column:
        o = F.col(who)
        return F.struct(
            F.lit(role).alias("role"), o["direction"].alias("direction"), o["confidence"].alias("confidence"),
            F.array_join(o["key_evidence"], " | ").alias("key_evidence"), F.array_join(o["counter_evidence"], " | ").alias("counter_evidence"),
            o["reasoning_short"].alias("reasoning_short"), F.lit(False).alias("decisive_for_arbiter"),
        )

    final = F.struct(
        F.lit("arbiter").alias("role"), F.col("decision").alias("direction"), F.col("conviction_tier").alias("confidence"),
        F.lit("").alias("key_evidence"), F.lit("").alias("counter_evidence"), F.col("reasoning").alias("reasoning_short"), F.lit(True).alias("decisive_for_arbiter"),
    )
    return df.select(*keys, F.explode(F.array(row("bull", "bull"), row("bear", "bear"), final)).alias("o")).select(*keys, "o.*")


def cap_concurrent(df: DataFrame, season: str = "fpe", n: int = 8) -> DataFrame:
    """At most n longs per earnings season, by tier and then by size of the divergence."""
    longs = df.where(F.col("decision") == "long").withColumn("_p", scoring.lookup(F.col("conviction_tier"), params.TIER_RANK))
    return first_n(longs, [season], ["_p", F.abs("divergence_pct").desc(), "firm"], n, "slot").drop("_p")


def cash_sleeve(trades: DataFrame, cash: DataFrame, season: str = "fpe", min_names: int = 4) -> DataFrame:
    """Season return with idle cash: below ``min_names`` positions the unallocated weight earns the
    cash series from first entry to last exit."""
    from pitspark.operators.core import asof_join

    by = trades.groupBy(season).agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("size").alias("allocated"), F.sum(F.col("size") * F.col("net_return")).alias("traded"),
        F.min("entry_date").alias("_a"), F.max("exit_date").alias("_b"),
    )
    priced = asof_join(asof_join(by, cash.select("d", F.col("px").alias("_pa")), [], "_a", "d", ["_pa"]), cash.select("d", F.col("px").alias("_pb")), [], "_b", "d", ["_pb"])
    earned = F.coalesce(F.try_divide(F.col("_pb") - F.col("_pa"), F.col("_pa")), F.lit(0.0))
    idle = F.when(F.col("n_names") < min_names, F.greatest(1.0 - F.col("allocated"), F.lit(0.0))).otherwise(0.0)
    return priced.select(season, "n_names", "allocated", idle.alias("cash_weight"), earned.alias("cash_return"), (F.col("traded") + idle * earned).alias("season_return"))
