"""Queries for point-in-time filters, as-of joins and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions import dates
from pitspark.functions.rounding import rnd
from pitspark.operators import news, pit
from pitspark.operators.core import asof_join
from pitspark.plans import bindings as b
from pitspark.plans import oracle_base as o
from pitspark.plans.registry import query

CP = f"{o.CELLS}, {o.PRICES}"


@query("c1_asof_price", f"WITH {CP} SELECT c.firm, c.fpe, c.t, rnd(p.px, 7) AS px FROM cells c ASOF LEFT JOIN prices p ON c.firm = p.firm AND c.t >= p.d")
def c1(spark, sf):
    got = pit.price_asof(b.cells(spark, sf), b.prices(spark, sf))
    return got.select("firm", "fpe", "t", rnd("px", 7).alias("px"))


@query("c1_asof_every_line", f"""WITH {o.PRICES}, ord AS (SELECT o_orderkey, c_nationkey AS firm, CAST(o_orderdate AS DATE) AS od FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT o_orderkey, rnd(p.px, 7) AS px, ntrades FROM ord c ASOF LEFT JOIN prices p ON c.firm = p.firm AND c.od >= p.d""")
def c1_lines(spark, sf):
    cust = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("firm"))
    left = b.table(spark, sf, "orders").join(cust, "o_custkey").select("o_orderkey", "firm", F.to_date("o_orderdate").alias("od"))
    got = asof_join(left, b.prices(spark, sf), ["firm"], "od", "d", ["px", "ntrades"])
    return got.select("o_orderkey", rnd("px", 7).alias("px"), "ntrades")


FUND = ["rdq", "saleq", "oibdpq", "niq", "oancfy", "capxy", "ceqq", "dlttq", "dlcq", "cheq"]
FUND_AT = """fund_at AS (SELECT c.firm, c.fpe, c.t, f.* EXCLUDE (firm) FROM cells c LEFT JOIN fundq f ON f.firm = c.firm AND coalesce(f.rdq, f.datadate) <= c.t
  AND NOT EXISTS (SELECT 1 FROM fundq g WHERE g.firm = f.firm AND g.datadate < f.datadate AND coalesce(g.rdq, g.datadate) > c.t)
 QUALIFY row_number() OVER (PARTITION BY c.firm, c.fpe, c.t ORDER BY f.datadate DESC NULLS LAST) = 1)"""


@query("c2_asof_fundamentals", f"WITH {o.CELLS}, {o.FUNDQ}, {FUND_AT} SELECT firm, fpe, t, datadate, rdq, rnd(saleq, 6) AS saleq, rnd(cheq, 6) AS cheq FROM fund_at")
def c2(spark, sf):
    got = pit.asof_fundamentals(b.cells(spark, sf), b.fundq(spark, sf), ["rdq", "saleq", "cheq"])
    return got.select("firm", "fpe", "t", "datadate", "rdq", rnd("saleq", 6).alias("saleq"), rnd("cheq", 6).alias("cheq"))


@query("c3_estimate_active_at", f"WITH {o.CELLS} {o.ACTIVE} SELECT row_id, firm, fpe, t, anndats, value FROM active")
def c3(spark, sf):
    return pit.active_estimates(b.estimates(spark, sf), b.cells(spark, sf)).select("row_id", "firm", "fpe", "t", "anndats", "value")


# Some estimates without a value: they hide none of the analyst's others.
GAPPED = o.ACTIVE.replace("JOIN estimates e", "JOIN (SELECT * REPLACE (CASE WHEN row_id % 17 <> 3 THEN value END AS value) FROM estimates) e").replace("WHERE e.anndats", "WHERE e.value IS NOT NULL AND e.anndats")


def gapped(spark, sf):
    return b.estimates(spark, sf).withColumn("value", F.when(F.col("row_id") % 17 != 3, F.col("value")))


@query("c4_latest_per_analyst", f"WITH {o.CELLS} {GAPPED} SELECT firm, fpe, t, CAST(analyst AS VARCHAR) AS analyst, value FROM latest")
def c4(spark, sf):
    return pit.latest_per_analyst(pit.active_estimates(gapped(spark, sf), b.cells(spark, sf)))


@query("c5_consensus_at", f"WITH {o.CELLS} {GAPPED} SELECT firm, fpe, t, n_analysts, rnd(median_value, 4) AS median_value, rnd(mean_value, 4) AS mean_value, rnd(dispersion, 4) AS dispersion FROM consensus")
def c5(spark, sf):
    c = pit.consensus_at(gapped(spark, sf), b.cells(spark, sf))
    return c.select("firm", "fpe", "t", "n_analysts", *[rnd(x, 4).alias(x) for x in ("median_value", "mean_value", "dispersion")])


@query("c6_stopped_estimate_filter", f"""WITH {o.CELLS} SELECT c.firm, c.fpe, c.t, count(DISTINCT e.analyst) AS n_analysts, rnd(median(e.value), 4) AS median_value, rnd(avg(e.value), 4) AS mean_value,
 rnd(stddev_samp(e.value), 4) AS dispersion, max(e.anndats) AS newest_anndats, CAST(c.t - max(e.anndats) AS INTEGER) AS estimate_age_days
 FROM cells c JOIN estimates e ON c.firm = e.firm AND c.fpe = e.fpe WHERE e.anndats <= c.t AND e.fpi IN (6, 7, 8, 9) AND (e.revdats IS NULL OR e.revdats > c.t) AND (e.stopdats IS NULL OR e.stopdats > c.t) GROUP BY 1, 2, 3""")
def c6(spark, sf):
    c = pit.consensus_with_stops(b.estimates(spark, sf), b.cells(spark, sf))
    return c.withColumns({x: rnd(x, 4) for x in ("median_value", "mean_value", "dispersion")})


MASKED = """masked AS (SELECT c.firm, c.fpe, c.t, p.pad_id, p.permit_date, p.lat, p.lon, CASE WHEN p.spud_date <= c.t THEN p.spud_date END AS spud_date,
 CASE WHEN p.completion_date <= c.t THEN p.completion_date END AS completion_date FROM cells c JOIN permits p ON c.firm = p.firm WHERE p.permit_date <= c.t)"""


@query("c7_mask_pit", f"WITH {o.CELLS}, {o.PERMITS}, {MASKED} SELECT firm, fpe, t, pad_id, permit_date, spud_date, completion_date FROM masked")
def c7(spark, sf):
    return pit.mask_permits(b.permits(spark, sf), b.cells(spark, sf)).drop("lat", "lon")


@query("c8_prev_event", f"WITH {o.CELLS} SELECT firm, fpe, ed, CAST(coalesce(lag(ed) OVER (PARTITION BY firm ORDER BY fpe), ed - 90) AS DATE) AS prev_ed FROM earnings")
def c8(spark, sf):
    return pit.previous_event(b.earnings(spark, sf))


@query("c9_first_actual_date", f"WITH {o.ESTIMATES} SELECT firm, fpe, CAST(min(anndats_act) AS DATE) AS ed, CAST(CAST(min(anndats_act) AS DATE) - 14 AS DATE) AS t FROM estimates WHERE anndats_act <> '' GROUP BY 1, 2")
def c9(spark, sf):
    return pit.first_actual_date(b.estimates(spark, sf))


@query("c10_articles_in_window", f"""WITH {o.ARTICLES}, {o.OUTLET_CELLS} SELECT c.outlet, c.fpe, a.article_id, a.publish_date, CAST(row_number() OVER (PARTITION BY c.outlet, c.fpe ORDER BY a.publish_date, a.article_id) AS INTEGER) AS "position" FROM outlet_cells c JOIN articles a
 ON a.outlet = c.outlet AND a.publish_date BETWEEN c.prev_ed AND c.t WHERE contains(lower(a.body), 'en') AND contains(lower(a.body), 'th') QUALIFY row_number() OVER (PARTITION BY c.outlet, c.fpe ORDER BY a.publish_date, a.article_id) <= 30""")
def c10(spark, sf):
    low = F.lower("body")
    got = pit.articles_in_window(b.articles(spark, sf), b.outlet_cells(spark, sf), "outlet", ["outlet", "fpe"], low.contains("en") & low.contains("th"), 30)
    return got.select("outlet", "fpe", "article_id", "publish_date", "position")


def _fetched(spark, sf):
    return news.articles_for_cells(b.company_news(spark, sf), b.ticker_cells(spark, sf), *b.news_registry(spark), "ticker", ["ticker", "fpe"])


@query("c10_news_by_ticker", f"""WITH {o.NEWS} SELECT ticker, fpe, article_id, publish_date, "position", "position" <= 30 AS used FROM hits""")
def c10_news(spark, sf):
    return _fetched(spark, sf).select("ticker", "fpe", "article_id", "publish_date", "position", "used")


@query("c10_news_per_cell", f"""WITH {o.NEWS} SELECT c.ticker, c.fpe, count(h.article_id) AS n_articles_in_window, coalesce(string_agg(CAST(h.article_id AS VARCHAR), ',' ORDER BY h."position") FILTER (h."position" <= 30), '') AS used_ids
 FROM ticker_cells c LEFT JOIN hits h USING (ticker, fpe) GROUP BY 1, 2""")
def c10_cells(spark, sf):
    got = news.news_per_cell(b.ticker_cells(spark, sf), _fetched(spark, sf), ["ticker", "fpe"])
    return got.withColumn("used_ids", F.array_join(F.col("used_ids").cast("array<string>"), ","))


@query("c11_available_at", f"WITH {o.SAR} SELECT pad_id, count(*) AS n, max(acq) AS last_acq FROM sar_obs WHERE acq + CAST(1 + scene_id % 5 AS INTEGER) <= DATE '1999-06-30' GROUP BY 1")
def c11(spark, sf):
    obs = b.sar_obs(spark, sf).withColumn("published", F.date_add("acq", (F.col("scene_id") % 5 + 1).cast("int")))
    return pit.available_at(obs, "published", F.to_date(F.lit("1999-06-30"))).groupBy("pad_id").agg(F.count(F.lit(1)).alias("n"), F.max("acq").alias("last_acq"))


EXITS = """exits AS (SELECT c.firm, c.fpe, p.d AS exit_price_date, p.px AS exit_price FROM cells c JOIN prices p ON p.firm = c.firm AND p.d > c.ed
 QUALIFY row_number() OVER (PARTITION BY c.firm, c.fpe ORDER BY p.d) = 2)"""


@query("c12_nth_row_after", f"WITH {CP}, {EXITS} SELECT c.firm, c.fpe, c.ed, rnd(e.exit_price, 7) AS exit_price, e.exit_price_date FROM cells c LEFT JOIN exits e USING (firm, fpe)")
def c12(spark, sf):
    got = pit.exit_price(b.cells(spark, sf), b.prices(spark, sf))
    return got.select("firm", "fpe", "ed", rnd("exit_price", 7).alias("exit_price"), "exit_price_date")


TRAILING = """mom AS (SELECT c.*, pe.px AS pe, pb.px AS pb FROM (SELECT *, t - 30 AS e, t - 360 AS s FROM cells) c
 ASOF LEFT JOIN prices pe ON c.firm = pe.firm AND c.e >= pe.d ASOF LEFT JOIN prices pb ON c.firm = pb.firm AND c.s >= pb.d)"""


@query("c13_trailing_return", f"WITH {CP}, {TRAILING} SELECT firm, fpe, t, rnd((pe - pb) / pb, 6) AS ret FROM mom")
def c13(spark, sf):
    got = pit.trailing_return(b.cells(spark, sf), b.prices(spark, sf), F.date_sub("t", 30), 330, "ret")
    return got.select("firm", "fpe", "t", rnd("ret", 6).alias("ret"))


@query("c14_window_avg", f"""WITH {o.CELLS}, {o.MACRO} SELECT c.firm, c.fpe, c.t, rnd(coalesce((SELECT avg(oil) FROM macro m WHERE m.d BETWEEN c.t - 90 AND c.t), 70.0::DOUBLE), 6) AS oil_avg,
 rnd(coalesce((SELECT avg(rigs) FROM macro m WHERE m.d BETWEEN c.t - 28 AND c.t), 300.0::DOUBLE), 6) AS rigs_avg FROM cells c""")
def c14(spark, sf):
    m = b.macro(spark, sf)
    got = pit.window_average(b.cells(spark, sf), m, F.date_sub("t", 90), F.col("t"), "oil", "oil_avg", 70.0)
    got = pit.window_average(got, m, F.date_sub("t", 28), F.col("t"), "rigs", "rigs_avg", 300.0)
    return got.select("firm", "fpe", "t", rnd("oil_avg", 6).alias("oil_avg"), rnd("rigs_avg", 6).alias("rigs_avg"))


CAPS = "caps AS (SELECT firm, d, CASE WHEN ntrades % 7 <> 0 THEN px END AS close, CAST(100 + firm AS DOUBLE) AS shrout FROM prices)"


def close_and_shares(spark, sf):
    p = b.prices(spark, sf)
    return p.select("firm", "d", F.when(F.col("ntrades") % 7 != 0, F.col("px")).alias("close"), (F.col("firm") + 100).cast("double").alias("shrout"))


@query("c15_market_cap_asof", f"WITH {CP}, {CAPS} SELECT c.firm, c.fpe, c.t, rnd(abs(p.close) * p.shrout * 1000, 2) AS market_cap FROM cells c ASOF LEFT JOIN caps p ON c.firm = p.firm AND c.t >= p.d")
def c15(spark, sf):
    got = pit.market_cap_asof(b.cells(spark, sf), close_and_shares(spark, sf))
    return got.select("firm", "fpe", "t", rnd("market_cap", 2).alias("market_cap"))


@query("c16_listed_at", f"WITH {CP} SELECT c.firm, c.fpe, c.t, EXISTS (SELECT 1 FROM prices p WHERE p.firm = c.firm AND p.d <= c.t) AS listed FROM cells c")
def c16(spark, sf):
    return pit.listed_at(b.cells(spark, sf), b.prices(spark, sf)).select("firm", "fpe", "t", "listed")


@query("c17_carry_forward", f"""WITH {o.PRICES}, monthly AS (SELECT firm, CAST(date_trunc('month', d) AS DATE) AS m, max(px) AS hi FROM prices GROUP BY 1, 2)
 SELECT p.firm, p.d, rnd(m.hi, 7) AS hi FROM prices p ASOF LEFT JOIN (SELECT firm, CAST(m + INTERVAL 1 MONTH AS DATE) AS m, hi FROM monthly) m ON p.firm = m.firm AND p.d >= m.m""")
def c17(spark, sf):
    p = b.prices(spark, sf)
    monthly = p.groupBy("firm", F.add_months(F.trunc("d", "month"), 1).alias("m")).agg(F.max("px").alias("hi"))
    return pit.carry_forward(p.select("firm", "d"), monthly, ["firm"], "d", "m", ["hi"]).select("firm", "d", rnd("hi", 7).alias("hi"))
