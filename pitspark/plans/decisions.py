"""Queries for forecasts, gates, verdicts and strategies, and the composed strategies themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import scoring
from pitspark.functions.rounding import rnd
from pitspark.operators import change, forecast, pit, signals
from pitspark.operators.core import latest_row
from pitspark.plans import bindings as b
from pitspark.plans import oracle_base as o
from pitspark.plans.activity import ACTIVITY, CPM, relative
from pitspark.plans.point_in_time import FUND, FUND_AT, TRAILING
from pitspark.plans.registry import query
from pitspark.session import materialize

TICKERS = {i: t for i, t in enumerate(params.UNIVERSE)}


def with_ticker(df: DataFrame) -> DataFrame:
    """Give each firm one of the registry's tickers, so that the per-company constants apply."""
    return df.withColumn("ticker", scoring.lookup(F.col("firm") % len(TICKERS), TICKERS))


def case(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE"

    return f"CASE {expr} " + " ".join(f"WHEN {lit(k) if isinstance(k, str) else k} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def scoring_inputs(spark, sf, setting: str | None = "target") -> DataFrame:
    """Everything the forecast needs, per cell."""
    cells = b.cells(spark, sf)
    act = relative(spark, sf, setting).select(*pit.CELL, "n_new", "n_cont", "signal")
    cons = pit.consensus_at(b.estimates(spark, sf), cells)
    oil = pit.window_average(cells, b.macro(spark, sf), F.date_sub("t", 90), F.col("t"), "oil", "oil_avg", params.DEFAULT_OIL_PRICE)
    return with_ticker(oil.join(act, pit.CELL).join(cons, pit.CELL))


@b.derived
def scored_cells(spark, sf) -> DataFrame:
    with b.written_once("cells", "permits"):
        return forecast.divergence(forecast.forecast(scoring_inputs(spark, sf), unit=1.0), unit=1.0)


SCORED = f"""{CPM} {o.ACTIVE}, {o.MACRO}, {ACTIVITY},
inputs AS (SELECT r.firm, r.fpe, r.t, c.ed, n_new, n_cont, signal, n_analysts, median_value, dispersion, coalesce((SELECT avg(oil) FROM macro m WHERE m.d BETWEEN r.t - 90 AND r.t), 70.0::DOUBLE) AS oil_avg, {case('r.firm % 10', TICKERS)} AS ticker
  FROM relative r JOIN consensus USING (firm, fpe, t) JOIN cells c USING (firm, fpe, t)),
fin AS (SELECT *, {case('ticker', params.WELLS_PER_PAD)} AS wells, oil_avg * {case('ticker', params.PRICE_DIFFERENTIAL)} AS realized, {case('ticker', params.REVENUE_SHARE)} AS share, {case('ticker', params.BASE_PRODUCTION)} AS base FROM inputs),
fc AS (SELECT *, CASE WHEN n_analysts >= 1 THEN 'consensus_anchored' ELSE 'structural' END AS mode,
  CASE WHEN n_analysts >= 1 THEN median_value * (1 + 0.1::DOUBLE * greatest(least(signal, 1.0), -1.0)) ELSE (base * 0.92::DOUBLE + (n_new + n_cont) * wells * 800) * 91 * realized / share END AS forecast FROM fin),
scored0 AS (SELECT *, CASE WHEN n_analysts > 0 THEN (forecast - median_value) / median_value * 100 ELSE 0 END AS divergence_pct FROM fc),
scored AS (SELECT *, CASE WHEN divergence_pct > 15 THEN 'strong_beat' WHEN divergence_pct > 5 THEN 'modest_beat' WHEN divergence_pct >= -5 THEN 'in_line' WHEN divergence_pct >= -15 THEN 'modest_miss' ELSE 'strong_miss' END AS divergence_class,
  CASE WHEN coalesce(n_analysts, 0) = 0 THEN 'low' WHEN n_analysts >= 10 AND dispersion / median_value < 0.03 THEN 'high' WHEN n_analysts >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM scored0)"""


@query("f1_forecast_anchored", f"""WITH {SCORED} SELECT firm, fpe, rnd(forecast, 4) AS forecast, rnd(forecast * share, 4) AS basin_revenue, rnd(forecast * share / (91 * realized), 6) AS production FROM fc WHERE mode = 'consensus_anchored'""")
def f1(spark, sf):
    got = forecast.forecast(scoring_inputs(spark, sf), unit=1.0).where("mode = 'consensus_anchored'")
    return got.select("firm", "fpe", rnd("forecast", 4).alias("forecast"), rnd("basin_revenue", 4).alias("basin_revenue"), rnd("production", 6).alias("production"))


@query("f2_forecast_structural", f"""WITH {SCORED} SELECT firm, fpe, rnd(base * 0.92::DOUBLE + (n_new + n_cont) * wells * 800, 4) AS production, rnd((base * 0.92::DOUBLE + (n_new + n_cont) * wells * 800) * 91 * realized / share / 1e6, 4) AS forecast_millions FROM fin""")
def f2(spark, sf):
    inputs = scoring_inputs(spark, sf).withColumn("n_analysts", F.lit(0).cast("bigint"))
    got = forecast.forecast(inputs, unit=1.0)
    return got.select("firm", "fpe", rnd("production", 4).alias("production"), rnd(F.col("forecast") / 1e6, 4).alias("forecast_millions"))


@query("f3_forecast_mode", f"WITH {SCORED} SELECT mode, count(*) AS n, rnd(avg(forecast) / 1e6, 4) AS mean_millions FROM fc GROUP BY 1")
def f3(spark, sf):
    got = forecast.forecast(scoring_inputs(spark, sf), unit=1.0)
    return got.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("forecast") / 1e6, 4).alias("mean_millions"))


@query("f4_divergence_class", f"WITH {SCORED} SELECT firm, fpe, rnd(divergence_pct, 2) AS divergence_pct, divergence_class FROM scored")
def f4(spark, sf):
    return scored_cells(spark, sf).select("firm", "fpe", rnd("divergence_pct", 2).alias("divergence_pct"), "divergence_class")


@query("f5_confidence_tier", f"WITH {SCORED} SELECT firm, fpe, n_analysts, confidence FROM scored")
def f5(spark, sf):
    return scored_cells(spark, sf).select("firm", "fpe", "n_analysts", "confidence")


@query("f6_gate", f"WITH {SCORED} SELECT firm, fpe, CASE WHEN divergence_class IN ('modest_beat', 'strong_beat') THEN 'pass' ELSE 'short_circuit_' || divergence_class END AS reason FROM scored")
def f6(spark, sf):
    passing, stopped = forecast.gate(scored_cells(spark, sf))
    return passing.select("firm", "fpe", F.lit("pass").alias("reason")).unionByName(stopped.select("firm", "fpe", "reason"))


def norm_sql(source: str) -> str:
    tier = "lower(trim(coalesce(conviction_tier, '')))"
    synonyms = case(tier, {t: t for t in params.TIER_SIZE} | params.TIER_SYNONYMS, "'none'")
    return f"""SELECT * EXCLUDE (decision, conviction_tier, weight, evidence, reasoning), CASE WHEN lower(trim(coalesce(decision, ''))) IN ('long', 'buy') THEN 'long' ELSE 'no_trade' END AS decision, {synonyms} AS conviction_tier,
 least(greatest(weight, 0), 1) AS weight, evidence[1:3] AS evidence, substr(reasoning, 1, 3000) AS reasoning FROM {source}"""


def sized_sql(source: str) -> str:
    size = f"CASE WHEN decision = 'long' THEN {case('conviction_tier', params.TIER_SIZE, '0.0::DOUBLE')} ELSE 0.0::DOUBLE END"
    return f"SELECT * EXCLUDE (decision, conviction_tier), {size} AS size, CASE WHEN {size} > 0 THEN 'long' ELSE 'no_trade' END AS decision, CASE WHEN {size} > 0 THEN conviction_tier ELSE 'none' END AS conviction_tier FROM {source}"


@query("f7_size_position", f"WITH {o.VERDICTS}, n AS ({norm_sql('verdicts')}), s AS ({sized_sql('n')}) SELECT verdict_id, decision, conviction_tier, size FROM s")
def f7(spark, sf):
    return forecast.size_position(forecast.normalize_verdicts(b.verdicts(spark, sf))).select("verdict_id", "decision", "conviction_tier", "size")


@query("f8_normalize_verdicts", f"WITH {o.VERDICTS}, n AS ({norm_sql('verdicts')}) SELECT verdict_id, decision, conviction_tier, rnd(weight, 6) AS weight, array_to_string(evidence, '|') AS evidence, reasoning FROM n")
def f8(spark, sf):
    n = forecast.normalize_verdicts(b.verdicts(spark, sf))
    return n.select("verdict_id", "decision", "conviction_tier", rnd("weight", 6).alias("weight"), F.array_join("evidence", "|").alias("evidence"), "reasoning")


@query("f8_normalize_opinions", """SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) THEN 'long' ELSE 'no_trade' END AS direction, CASE length(text) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
 array_to_string(string_split(text, chr(10))[1:3], '|') AS key_evidence, substr(text, 1, 1500) AS reasoning_short FROM conversations""")
def f8_opinions(spark, sf):
    turn, size = F.col("turn") % 4, F.length("text") % 4
    raw = b.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(turn == 0, "BUY ").when(turn == 1, "Long").when(turn == 2, "short").alias("direction"),
        F.when(size == 0, " HIGH").when(size == 1, "Medium").when(size == 2, "certain").alias("confidence"),
        F.split("text", "\n").alias("key_evidence"), F.lit(None).cast("array<string>").alias("counter_evidence"), F.col("text").alias("reasoning_short"),
    )
    got = forecast.normalize_opinions(raw)
    return got.select("conv_id", "turn", "direction", "confidence", F.array_join("key_evidence", "|").alias("key_evidence"), "reasoning_short")


LOWER = "CASE conviction_tier WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'none' END"


@query("f9_downgrade_tier", f"WITH {o.VERDICTS}, n AS ({norm_sql('verdicts')}) SELECT verdict_id, CASE WHEN disclosed THEN {LOWER} ELSE conviction_tier END AS conviction_tier FROM n")
def f9(spark, sf):
    return forecast.downgrade_tier(forecast.normalize_verdicts(b.verdicts(spark, sf))).select("verdict_id", "conviction_tier")


def opinions(spark, sf) -> DataFrame:
    """Verdicts with the nested opinions of the two opposing roles."""
    n = forecast.size_position(forecast.normalize_verdicts(b.verdicts(spark, sf)))

    def opinion(direction, evidence, counter):
        return F.struct(
            F.lit(direction).alias("direction"), F.when(F.col("weight") > 0.5, "high").otherwise("low").alias("confidence"),
            evidence.alias("key_evidence"), counter.alias("counter_evidence"), F.upper("reasoning").alias("reasoning_short"),
        )

    none = F.array().cast("array<string>")
    return n.select("verdict_id", "decision", "conviction_tier", "reasoning", opinion("long", F.col("evidence"), none).alias("bull"), opinion("no_trade", none, F.col("evidence")).alias("bear"))


@query("f10_explode_opinions", f"""WITH {o.VERDICTS}, n AS ({norm_sql('verdicts')}), s AS ({sized_sql('n')}), e AS (SELECT *, array_to_string(evidence, ' | ') AS ev, CASE WHEN weight > 0.5 THEN 'high' ELSE 'low' END AS conf FROM s)
 SELECT verdict_id, 'bull' AS role, 'long' AS direction, conf AS confidence, ev AS key_evidence, '' AS counter_evidence, upper(reasoning) AS reasoning_short, false AS decisive_for_arbiter FROM e
 UNION ALL SELECT verdict_id, 'bear', 'no_trade', conf, '', ev, upper(reasoning), false FROM e UNION ALL SELECT verdict_id, 'arbiter', decision, conviction_tier, '', '', reasoning, true FROM e""")
def f10(spark, sf):
    return forecast.explode_opinions(opinions(spark, sf), ["verdict_id"])


def cell_verdicts(spark, sf, news: bool = True) -> DataFrame:
    """The verdict used for a cell: the one with the smallest id, or without news the first of those
    that were given while nothing was disclosed."""
    v = b.verdicts(spark, sf)
    v = latest_row(v if news else v.where("NOT disclosed"), ["firm", "fpe"], [F.col("verdict_id").asc()])
    return v.select("firm", "fpe", "decision", "conviction_tier", "disclosed")


def composite(spark, sf, news: bool = True, downgrade: bool = False) -> DataFrame:
    """Activity, forecast, divergence, gate, verdict and size for every cell. The scored cells are few
    and feed both sides of the gate, so they are written once."""
    with b.written_once("scored_cells"):
        return forecast.decide(scored_cells(spark, sf), cell_verdicts(spark, sf, news), ["firm", "fpe"], downgrade)


CELL_VERDICTS = f"""cv0 AS ({norm_sql('verdicts')}), cv AS (SELECT firm, fpe, decision, conviction_tier, disclosed FROM cv0 QUALIFY row_number() OVER (PARTITION BY firm, fpe ORDER BY verdict_id) = 1),
cvn AS (SELECT firm, fpe, decision, conviction_tier, disclosed FROM cv0 WHERE NOT disclosed QUALIFY row_number() OVER (PARTITION BY firm, fpe ORDER BY verdict_id) = 1)"""


def composite_sql(name: str, verdicts: str = "cv", downgrade: bool = False) -> str:
    tier = f"CASE WHEN disclosed THEN {LOWER} ELSE conviction_tier END" if downgrade else "conviction_tier"
    go = "divergence_class IN ('modest_beat', 'strong_beat')"
    return f"""{name}0 AS (SELECT s.*, CASE WHEN {go} THEN coalesce(decision, 'no_trade') ELSE 'no_trade' END AS decision, CASE WHEN {go} THEN coalesce({tier}, 'none') ELSE 'none' END AS conviction_tier,
 CASE WHEN {go} THEN 'ok' ELSE 'short_circuit_' || divergence_class END AS reason FROM scored s LEFT JOIN {verdicts} USING (firm, fpe)), {name} AS ({sized_sql(name + '0')})"""


COMPOSITES = f"{SCORED}, {o.VERDICTS}, {CELL_VERDICTS}, {composite_sql('full_')}, {composite_sql('nonews', 'cvn')}, {composite_sql('lowered', downgrade=True)}"


@query("f11_cap_concurrent", f"""WITH {COMPOSITES} SELECT firm, fpe, conviction_tier, CAST(row_number() OVER (PARTITION BY fpe ORDER BY {case('conviction_tier', params.TIER_RANK)}, abs(divergence_pct) DESC, firm) AS INTEGER) AS slot FROM full_ WHERE decision = 'long'
 QUALIFY slot <= 3""")
def f11(spark, sf):
    return forecast.cap_concurrent(composite(spark, sf), n=3).select("firm", "fpe", "conviction_tier", "slot")


@query("g1_signal_composite_full", f"WITH {COMPOSITES} SELECT firm, fpe, t, decision AS direction, size, conviction_tier, reason FROM full_")
def g1(spark, sf):
    return composite(spark, sf).select(*pit.CELL, F.col("decision").alias("direction"), "size", "conviction_tier", "reason")


@query("g2_signal_composite_no_news", f"WITH {COMPOSITES} SELECT firm, fpe, t, decision AS direction, size FROM nonews")
def g2(spark, sf):
    """The same with verdicts given without news."""
    return composite(spark, sf, news=False).select(*pit.CELL, F.col("decision").alias("direction"), "size")


@query("g1_signal_with_downgrade", f"WITH {COMPOSITES} SELECT firm, fpe, t, decision AS direction, size FROM lowered")
def g1_lowered(spark, sf):
    """The documented rule that a disclosure lowers the tier by one, which the base strategy leaves to
    the verdict."""
    return composite(spark, sf, downgrade=True).select(*pit.CELL, F.col("decision").alias("direction"), "size")


def signal_sql(go: str, source: str) -> str:
    return f"SELECT firm, fpe, t, CASE WHEN {go} THEN 'long' ELSE 'no_trade' END AS direction, CASE WHEN {go} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS size FROM {source}"


REVISION = """, cells28 AS (SELECT firm, fpe, CAST(t - 28 AS DATE) AS t FROM cells),
act28 AS (SELECT c.firm, c.fpe, c.t, e.analyst, e.value, e.anndats, e.row_id FROM cells28 c JOIN estimates e ON c.firm = e.firm AND c.fpe = e.fpe WHERE e.anndats <= c.t AND (e.revdats IS NULL OR e.revdats = e.anndats OR e.revdats > c.t)),
lat28 AS (SELECT * FROM act28 QUALIFY row_number() OVER (PARTITION BY firm, fpe, analyst ORDER BY anndats DESC, row_id) = 1),
con28 AS (SELECT firm, fpe, median(value) AS before FROM lat28 GROUP BY 1, 2), rev AS (SELECT c.firm, c.fpe, c.t, c.median_value AS now, before FROM consensus c LEFT JOIN con28 USING (firm, fpe))"""
G3 = signal_sql("now > before", "rev")


@query("g3_signal_revision", f"WITH {o.CELLS} {o.ACTIVE} {REVISION} {G3}")
def g3(spark, sf):
    return signals.revision(b.cells(spark, sf), b.estimates(spark, sf))


OIL = """oil2 AS (SELECT c.*, a.oil AS now, p.oil AS before FROM (SELECT *, t - 90 AS tb FROM cells) c ASOF LEFT JOIN macro a ON c.t >= a.d ASOF LEFT JOIN macro p ON c.tb >= p.d)"""
G4 = signal_sql("before <> 0 AND now > before", "oil2")


@query("g4_signal_macro_momentum", f"WITH {o.CELLS}, {o.MACRO}, {OIL} {G4}")
def g4(spark, sf):
    return signals.macro_momentum(b.cells(spark, sf), b.macro(spark, sf))


RIGS = """rigs2 AS (SELECT c.*, coalesce((SELECT avg(rigs) FROM macro m WHERE m.d BETWEEN c.t - 28 AND c.t), 300) AS cur, coalesce((SELECT avg(rigs) FROM macro m WHERE m.d BETWEEN c.t - 56 AND c.t - 28), 300) AS prior FROM cells c)"""
G5 = signal_sql("cur <> 0 AND prior <> 0 AND cur > prior", "rigs2")


@query("g5_signal_window_change", f"WITH {o.CELLS}, {o.MACRO}, {RIGS} {G5}")
def g5(spark, sf):
    return signals.window_change(b.cells(spark, sf), b.macro(spark, sf))


@query("g6_signal_equal_weight", f"WITH {o.CELLS} SELECT firm, fpe, t, 'long' AS direction, 0.1::DOUBLE AS size FROM cells")
def g6(spark, sf):
    return signals.equal_weight(b.cells(spark, sf))


@query("g7_signal_never", f"WITH {o.CELLS} SELECT firm, fpe, t, 'no_trade' AS direction, 0.0::DOUBLE AS size FROM cells")
def g7_cells(spark, sf):
    return signals.never(b.cells(spark, sf))


BUY_HOLD = """bh AS (SELECT coalesce(max_by(oil, d) FILTER (d <= DATE '1990-01-01'), min_by(oil, d)) AS p0, coalesce(max_by(oil, d) FILTER (d <= DATE '2000-12-31'), max_by(oil, d)) AS p1 FROM macro)"""


def buy_hold(spark, sf):
    series = b.macro(spark, sf).select("d", F.col("oil").alias("px"))
    return signals.buy_hold(series, F.to_date(F.lit("1990-01-01")), F.to_date(F.lit("2000-12-31")))


@query("g7_benchmark_buy_hold", f"WITH {o.MACRO}, {BUY_HOLD} SELECT rnd((p1 - p0) / p0, 6) AS gross_return, rnd((p1 - p0) / p0 - 0.003, 6) AS net_return FROM bh")
def g7(spark, sf):
    return buy_hold(spark, sf).select(rnd("gross_return", 6).alias("gross_return"), rnd("net_return", 6).alias("net_return"))


def universe(spark, sf) -> DataFrame:
    u = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("firm"), F.col("n_nationkey").alias("idx"))
    shares = scoring.lookup(F.col("ticker"), {k: float(v) for k, v in params.SHARES_MILLIONS.items()}, float(params.SHARES_MILLIONS_DEFAULT))
    return with_ticker(u).withColumn("shares", shares)


@b.derived
def panel(spark, sf) -> DataFrame:
    return signals.ranking_panel(b.cells(spark, sf), universe(spark, sf))


def momentum(spark, sf):
    return signals.momentum_scores(panel(spark, sf), b.prices(spark, sf))


def value(spark, sf):
    return signals.composite(signals.value_inputs(panel(spark, sf), b.fundq(spark, sf), b.prices(spark, sf)), signals.VALUE_COLS, "value_score")


def quality(spark, sf):
    return signals.composite(signals.quality_inputs(panel(spark, sf), b.fundq(spark, sf)), signals.QUALITY_COLS, "quality_score")


PANEL = f"""panel AS (SELECT n_nationkey AS firm, n_nationkey AS idx, t, {case(case('n_nationkey % 10', TICKERS), params.SHARES_MILLIONS, '200.0::DOUBLE')} AS shares FROM nation, (SELECT DISTINCT t FROM cells))"""
MOM_PANEL = TRAILING.replace("mom AS", "mom0 AS").replace("FROM cells) c", "FROM panel) c") + ", mom AS (SELECT *, (pe - pb) / pb AS momentum FROM mom0)"
FUND_PANEL = FUND_AT.replace("fund_at AS (SELECT c.firm, c.fpe, c.t,", "fund_at AS (SELECT c.firm, c.t, c.idx, c.shares,").replace("FROM cells c", "FROM panel c").replace("PARTITION BY c.firm, c.fpe, c.t", "PARTITION BY c.firm, c.t")
VALUE = f"""val0 AS (SELECT f.*, p.px, p.px * shares * 1e6 AS cap FROM fund_at f ASOF LEFT JOIN prices p ON f.firm = p.firm AND f.t >= p.d),
val1 AS (SELECT *, -(cap + coalesce(dlttq, 0) * 1e6 + coalesce(dlcq, 0) * 1e6 - coalesce(cheq, 0) * 1e6) / (oibdpq * 4 * 1e6) AS a, -cap / (ceqq * 1e6) AS b, (coalesce(oancfy, 0) - coalesce(capxy, 0)) * 1e6 / cap AS c FROM val0 WHERE px > 0 AND oibdpq > 0 AND ceqq > 0)"""
QUALITY = "qua1 AS (SELECT *, niq * 4 / ceqq AS a, -(coalesce(dlttq, 0) + coalesce(dlcq, 0)) / ceqq AS b, coalesce(oancfy, 0) / saleq AS c FROM fund_at WHERE niq IS NOT NULL AND ceqq > 0 AND saleq > 0)"


def z_sql(c: str, part: str = "t") -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN count({c}) OVER (PARTITION BY {part}) < 2 OR stddev_pop({c}) OVER (PARTITION BY {part}) = 0 THEN 0 ELSE ({c} - avg({c}) OVER (PARTITION BY {part})) / stddev_pop({c}) OVER (PARTITION BY {part}) END"


def composite_score(source: str, name: str, out: str) -> str:
    return f"{name} AS (SELECT *, ({z_sql('a')} + {z_sql('b')} + {z_sql('c')}) / 3 AS {out} FROM {source} QUALIFY count(*) OVER (PARTITION BY t) >= 2)"


def top_sql(source: str, score: str) -> str:
    return f"""top4 AS (SELECT firm, t FROM {source} WHERE {score} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY {score} DESC, idx) <= 4),
flagged AS (SELECT c.*, top4.firm IS NOT NULL AS top FROM cells c LEFT JOIN top4 ON c.firm = top4.firm AND c.t = top4.t)"""


G8 = f"{PANEL}, {MOM_PANEL}"
G9 = f"{PANEL}, {o.FUNDQ_ONLY}, {FUND_PANEL}, {VALUE}, {composite_score('val1', 'val', 'value_score')}"
G10 = f"{PANEL}, {o.FUNDQ_ONLY}, {FUND_PANEL}, {QUALITY}, {composite_score('qua1', 'qua', 'quality_score')}"


@query("g8_signal_momentum_12_1", f"WITH {o.CELLS}, {o.PRICES}, {G8}, {top_sql('mom', 'momentum')} {signal_sql('top', 'flagged')}")
def g8(spark, sf):
    return signals.long_top(b.cells(spark, sf), momentum(spark, sf), "momentum")


@query("g9_signal_value", f"WITH {o.CELLS}, {o.PRICES}, {G9}, {top_sql('val', 'value_score')} {signal_sql('top', 'flagged')}")
def g9(spark, sf):
    return signals.long_top(b.cells(spark, sf), value(spark, sf), "value_score")


@query("g10_signal_quality", f"WITH {o.CELLS}, {o.PRICES}, {G10}, {top_sql('qua', 'quality_score')} {signal_sql('top', 'flagged')}")
def g10(spark, sf):
    return signals.long_top(b.cells(spark, sf), quality(spark, sf), "quality_score")


@query("g11_zscore_by", f"WITH {o.PRICES} SELECT firm, d, rnd({z_sql('px', 'd')}, 6) AS z_px, rnd({z_sql('CAST(ntrades AS DOUBLE)', 'd')}, 6) AS z_ntrades FROM prices")
def g11(spark, sf):
    z = signals.zscore_by(b.prices(spark, sf), ["d"], ["px", "ntrades"])
    return z.select("firm", "d", rnd("z_px", 6).alias("z_px"), rnd("z_ntrades", 6).alias("z_ntrades"))


@query("g12_top_n_by", f"WITH {o.PRICES} SELECT firm, d, CAST(row_number() OVER (PARTITION BY d ORDER BY ntrades DESC, firm) AS INTEGER) AS \"position\" FROM prices QUALIFY \"position\" <= 4")
def g12(spark, sf):
    return signals.top_n_by(b.prices(spark, sf), ["d"], "ntrades", 4, "firm").select("firm", "d", "position")


def _factor(src: str, score: str) -> str:
    return f"SELECT firm, t, {score}, row_number() OVER (PARTITION BY t ORDER BY {score} DESC, idx) AS r FROM {src} WHERE {score} IS NOT NULL"


@query("g13_factor_panel", f"""WITH {o.CELLS}, {o.PRICES}, {G8}, {o.FUNDQ_ONLY}, {FUND_PANEL}, {VALUE}, {composite_score('val1', 'val', 'value_score')}, {QUALITY}, {composite_score('qua1', 'qua', 'quality_score')},
 m AS ({_factor('mom', 'momentum')}), v AS ({_factor('val', 'value_score')}), q AS ({_factor('qua', 'quality_score')})
 SELECT p.firm, p.t, rnd(momentum, 6) AS momentum, m.r AS momentum_rank, coalesce(m.r <= 4, false) AS momentum_top, rnd(value_score, 6) AS value_score, v.r AS value_score_rank, coalesce(v.r <= 4, false) AS value_score_top,
 rnd(quality_score, 6) AS quality_score, q.r AS quality_score_rank, coalesce(q.r <= 4, false) AS quality_score_top FROM panel p LEFT JOIN m USING (firm, t) LEFT JOIN v USING (firm, t) LEFT JOIN q USING (firm, t)""")
def g13(spark, sf):
    with b.written_once("cells", "prices", "fundq", "panel"):
        made = {"momentum": momentum(spark, sf), "value_score": value(spark, sf), "quality_score": quality(spark, sf)}
        # A full ranking reads its input several times, so the scores are written first.
        scores = {name: materialize(df.select("firm", "t", "idx", name), name) for name, df in made.items()}
        return signals.factor_panel(panel(spark, sf), scores).withColumns({c: rnd(c, 6) for c in scores})


SPEC = f"""fq4 AS (SELECT *, CASE WHEN month(datadate) <= 3 THEN oancfy WHEN CAST(last_day(datadate - INTERVAL 3 MONTH) AS DATE) = lag(datadate) OVER y THEN oancfy - lag(oancfy) OVER y END AS ocf_q, CASE WHEN month(datadate) <= 3 THEN capxy WHEN CAST(last_day(datadate - INTERVAL 3 MONTH) AS DATE) = lag(datadate) OVER y THEN capxy - lag(capxy) OVER y END AS capex_q,
  CASE WHEN count(niq) OVER f = 4 AND count(ceqq) OVER f = 4 AND avg(ceqq) OVER f > 0 THEN sum(niq) OVER f / avg(ceqq) OVER f END AS roe_4q FROM fundq
  WINDOW y AS (PARTITION BY firm, year(datadate) ORDER BY datadate), f AS (PARTITION BY firm ORDER BY datadate ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
{FUND_PANEL.replace('LEFT JOIN fundq f', 'LEFT JOIN fq4 f')},
sp0 AS (SELECT f.*, p.px, CASE WHEN p.px > 0 THEN p.px * shares * 1e6 END AS cap, CASE WHEN ceqq > 0 THEN ceqq END AS eq FROM fund_at f ASOF LEFT JOIN prices p ON f.firm = p.firm AND f.t >= p.d),
sp1 AS (SELECT *, CASE WHEN oibdpq > 0 THEN -(cap + (dlttq + dlcq - cheq) * 1e6) / (oibdpq * 1e6) END AS a, -cap / (eq * 1e6) AS b, (ocf_q - capex_q) * 1e6 / cap AS c, roe_4q AS d, -(dlttq + dlcq) / eq AS e, CASE WHEN saleq > 0 THEN ocf_q / saleq END AS f FROM sp0),
sp2 AS (SELECT firm, t, cap, {', '.join(f'{z_sql(c)} AS z{c}' for c in 'abcdef')} FROM sp1)"""


@query("g14_spec_factor_variants", f"""WITH {o.CELLS}, {o.PRICES}, {PANEL}, {o.FUNDQ_ONLY}, {SPEC}, s AS (SELECT firm, t, cap, list_avg(list_filter([za, zb, zc], lambda x: x IS NOT NULL)) AS vs, list_avg(list_filter([zd, ze, zf], lambda x: x IS NOT NULL)) AS qs FROM sp2)
 SELECT firm, t, rnd(vs, 6) AS value_spec, rnd(qs, 6) AS quality_spec, CASE WHEN vs IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY vs DESC NULLS LAST, cap DESC, firm) <= 4 ELSE false END AS value_top,
 CASE WHEN qs IS NOT NULL THEN row_number() OVER (PARTITION BY t ORDER BY qs DESC NULLS LAST, cap DESC, firm) <= 4 ELSE false END AS quality_top FROM s""")
def g14(spark, sf):
    s = signals.spec_scores(panel(spark, sf), b.fundq(spark, sf), b.prices(spark, sf)).select("firm", "t", "cap", "value_spec", "quality_spec")
    out = s
    for name in ("value", "quality"):
        score = f"{name}_spec"
        top = signals.first_n(s.where(F.col(score).isNotNull()), ["t"], [F.col(score).desc(), F.col("cap").desc(), "firm"], 4).select("firm", "t", F.lit(True).alias(f"{name}_top"))
        out = out.join(top, ["firm", "t"], "left").withColumn(f"{name}_top", F.coalesce(f"{name}_top", F.lit(False)))
    return out.select("firm", "t", rnd("value_spec", 6).alias("value_spec"), rnd("quality_spec", 6).alias("quality_spec"), "value_top", "quality_top")
