"""Queries for scans, parsing, identity and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark import params
from pitspark.functions import dates, hashing, scoring, text
from pitspark.functions.rounding import rnd
from pitspark.operators import identity
from pitspark.operators.core import latest_row
from pitspark.plans import bindings as b
from pitspark.plans import oracle_base as o
from pitspark.plans.registry import query
from pitspark.sources import readers


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _iso(c):
    return F.to_date(c).cast("string")


@query("a1_read_table", """SELECT o_orderstatus, count(*) AS n, rnd(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def a1(spark, sf):
    schema = T.StructType([T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    t = readers.read_table(spark, f"{sf}/orders.parquet", schema)
    return t.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("a2_read_estimates", """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS fpe,
 CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS revdats, o_totalprice AS value, CAST(o_custkey AS VARCHAR) AS analyst
 FROM orders WHERE o_orderkey % 13 <> 0""")
def a2(spark, sf):
    k = F.col("o_orderkey")
    raw = b.table(spark, sf, "orders").select(
        _s("o_orderkey").alias("row_id"), F.lit("X").alias("OFTIC"), F.lit("x").alias("CNAME"),
        F.when(k % 17 == 0, "bad-date").otherwise(_iso("o_orderdate")).alias("FPEDATS"), _iso("o_orderdate").alias("ANNDATS"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.date_add(F.to_date("o_orderdate"), 30).cast("string")).alias("REVDATS"),
        F.when(k % 13 == 0, "n/a").otherwise(_s("o_totalprice")).alias("VALUE"), _s("o_custkey").alias("ANALYS"),
        F.lit("6").alias("FPI"), F.lit("SAL").alias("MEASURE"), F.lit("").alias("ANNDATS_ACT"),
    )
    return readers.parse_estimates(raw).select("row_id", "fpe", "revdats", "value", "analyst")


@query("a3_read_prices", """WITH r AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, l_orderkey AS k, l_extendedprice AS p, CAST(round(l_discount * 100) AS INTEGER) AS disc,
 CAST(round(l_tax * 100) AS INTEGER) AS tax, l_linenumber AS ln FROM lineitem)
SELECT CAST(l_suppkey AS VARCHAR) AS ticker, d, rnd(CASE WHEN disc IN (0, 1) THEN p ELSE p / (1 + disc / 100.0::DOUBLE) END, 4) AS adj_close,
 CASE WHEN tax NOT IN (0, 1) THEN tax / 100.0::DOUBLE END AS ret FROM r WHERE k % 97 <> 0 AND tax <> 2""")
def a3(spark, sf):
    disc, tax = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    raw = b.table(spark, sf, "lineitem").select(
        _s("l_suppkey").alias("TICKER"), F.lit("x").alias("COMNAM"), _iso("l_shipdate").alias("date"),
        F.when(F.col("l_orderkey") % 97 == 0, "x").when(F.col("l_linenumber") == 1, _s(-F.col("l_extendedprice"))).otherwise(_s("l_extendedprice")).alias("PRC"),
        F.when(disc == 0, "").when(disc == 1, "0").otherwise(F.concat(F.lit("1."), F.lpad(_s(disc), 2, "0"))).alias("CFACPR"),
        F.when(tax == 0, "").when(tax == 1, "C").when(tax == 2, "B").otherwise(F.concat(F.lit("0."), F.lpad(_s(tax), 2, "0"))).alias("RET"),
        F.lit("1000").alias("SHROUT"),
    )
    return readers.parse_prices(raw).select("ticker", "d", rnd("adj_close", 4).alias("adj_close"), "ret")


@query("a4_read_fundq", """SELECT CAST(o_custkey AS VARCHAR) AS firm, CAST(o_orderdate AS DATE) AS datadate, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 40 END AS rdq,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS saleq FROM orders WHERE o_custkey % 19 <> 0 AND o_orderkey % 23 <> 0""")
def a4(spark, sf):
    k = F.col("o_orderkey")
    raw = b.table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 19 == 0, "").otherwise(_s("o_custkey")).alias("tic"),
        F.when(k % 23 == 0, "31/12/1999").otherwise(_iso("o_orderdate")).alias("datadate"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_add(F.to_date("o_orderdate"), 40).cast("string")).alias("rdq"),
        F.when(k % 13 == 0, "-").otherwise(_s("o_totalprice")).alias("saleq"),
    )
    return readers.parse_fundq(raw)


@query("a5_read_macro_series", """SELECT CAST(ts AS DATE) AS d, rnd(sum(value), 4) AS total, CAST(sum(trunc(value)) AS BIGINT) AS whole_total FROM events WHERE event_id % 11 <> 0 GROUP BY 1""")
def a5(spark, sf):
    e = b.table(spark, sf, "events")
    raw = e.select(_iso("ts").alias("date"), F.when(F.col("event_id") % 11 == 0, "x").otherwise(_s("value")).alias("value"))
    level = readers.parse_macro(raw).groupBy("d").agg(rnd(F.sum("value"), 4).alias("total"))
    count = readers.parse_macro(raw, whole=True).groupBy("d").agg(F.sum("value").alias("whole_total"))
    return level.join(count, "d")


def _raw_permits(spark, sf):
    k = F.col("p_partkey")
    day = F.date_add(F.to_date(F.lit("1995-01-01")), (k % 2000).cast("int"))
    return b.table(spark, sf, "part").select(
        _s("p_partkey").alias("pad_id"), F.col("p_brand").alias("operator_at_permit"), F.col("p_type").alias("operator_normalized"),
        F.lit("TX").alias("state"), F.lit("").alias("county"), F.when(k % 31 == 0, "?").otherwise(_s("p_retailprice")).alias("latitude"), _s("p_size").alias("longitude"),
        F.when(k % 29 == 0, "").otherwise(day.cast("string")).alias("permit_filing_date"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.date_add(day, 90).cast("string")).alias("spud_filing_date"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.date_add(day, 400).cast("string")).alias("completion_filing_date"), F.lit("").alias("api_number"),
    )


_PART_DAY = "CAST(DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS DATE)"


@query("a6_read_permits", f"""SELECT CAST(p_partkey AS VARCHAR) AS pad_id, p_brand AS operator_at_permit, p_retailprice AS lat, CAST(p_size AS DOUBLE) AS lon, {_PART_DAY} AS permit_date,
 CASE WHEN p_size % 5 <> 0 THEN {_PART_DAY} + 90 END AS spud_date, CASE WHEN p_size % 3 <> 0 THEN {_PART_DAY} + 400 END AS completion_date
 FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 29 <> 0""")
def a6(spark, sf):
    return readers.parse_permits(_raw_permits(spark, sf)).drop("operator_normalized")


@query("a6_read_pads_known_at", f"""SELECT CAST(p_partkey AS VARCHAR) AS pad_id, p_brand AS operator_at_permit, {_PART_DAY} AS permit_date
 FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 29 <> 0 AND {_PART_DAY} <= DATE '1998-06-30'""")
def a6_legacy(spark, sf):
    return readers.parse_pads_known_at(_raw_permits(spark, sf), F.to_date(F.lit("1998-06-30"))).drop("lat", "lon")


@query("a7_read_sar_observations", """SELECT CAST(l_suppkey AS VARCHAR) AS pad_id, l_orderkey || '-' || l_linenumber AS scene_id, CAST(max(struct_pack(d := CAST(l_shipdate AS DATE), v := l_tax)).d AS DATE) AS acquisition_date,
 max(struct_pack(d := CAST(l_shipdate AS DATE), v := l_tax)).v AS vv_mean_linear FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1, 2""")
def a7(spark, sf):
    obs = F.struct(
        _s("l_suppkey").alias("pad_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("scene_id"), _iso("l_shipdate").alias("acquisition_date"), F.col("l_tax").alias("vv_mean_linear"),
    )
    files = b.table(spark, sf, "lineitem").select("l_orderkey", F.to_json(F.array(obs, obs)).alias("body"))
    files = files.withColumn("body", F.when(F.col("l_orderkey") % 10 == 0, F.expr("substring(body, 1, 20)")).otherwise(F.col("body")))
    return readers.parse_sar_files(files, "body").select("pad_id", "scene_id", "acquisition_date", "vv_mean_linear")


@query("a8_read_articles", """WITH p AS (SELECT *, page_id % 5 AS response, CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS DATE) AS publish_date FROM pages WHERE page_id % 7 <> 3),
 n AS (SELECT *, row_number() OVER (PARTITION BY response ORDER BY page_id) - 1 AS pos FROM p)
 SELECT response, CASE WHEN page_id % 9 = 0 THEN CAST(pos AS VARCHAR) ELSE right(url, 32) END AS article_id, publish_date, CAST(length(html) AS BIGINT) AS title_chars FROM n""")
def a8(spark, sf):
    k = F.col("page_id")
    stamp = F.concat(F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (k % 300).cast("int")), "yyyyMMdd"), F.lit("T120000Z"))
    raw = b.table(spark, sf, "pages").select(
        (k % 5).alias("response"), k.alias("pos"), F.when(k % 7 == 3, "20240101").otherwise(stamp).alias("seendate"),
        F.col("html").alias("title"), F.when(k % 9 == 0, "").otherwise(F.col("url")).alias("url"),
    )
    got = readers.parse_articles(raw, "response", "pos")
    return got.select("response", "article_id", "publish_date", F.length("title").cast("bigint").alias("title_chars"))


@query("a9_read_permian_fraction", """WITH r AS (SELECT p_partkey, p_brand, CAST(2015 + p_size % 10 AS INTEGER) AS fiscal_year,
 CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 7 / 8.0::DOUBLE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_partkey % 5 / 4.0::DOUBLE END AS v FROM part)
 SELECT p_brand AS ticker, fiscal_year, max_by(v, p_partkey) AS fraction FROM r WHERE v IS NOT NULL GROUP BY 1, 2""")
def a9(spark, sf):
    k = F.col("p_partkey")
    raw = b.table(spark, sf, "part").select(
        k.alias("row_id"), F.col("p_brand").alias("ticker"), (F.col("p_size") % 10 + 2015).cast("string").alias("fiscal_year"),
        F.when(k % 4 == 0, _s(k % 7 / 8.0)).when(k % 4 == 1, " ").otherwise("").alias("permian_production_fraction_ttm"),
        F.when(k % 4 >= 2, _s(k % 5 / 4.0)).otherwise("x").alias("permian_fraction_ttm"),
    )
    return readers.parse_fraction(raw)


@query("a10_read_earnings_calendar", f"WITH {o.ESTIMATES} SELECT CAST(firm AS VARCHAR) AS firm, fpe, max_by(CAST(anndats_act AS DATE), row_id) AS ed FROM estimates WHERE anndats_act <> '' GROUP BY 1, 2")
def a10(spark, sf):
    e = b.estimates(spark, sf)
    raw = e.select("row_id", _s("firm").alias("ticker"), _s("fpe").alias("fiscal_quarter_end"), F.col("anndats_act").alias("earnings_date_actual"))
    return readers.parse_earnings(raw)


@query("a11_read_truth_events", "SELECT CAST(l_suppkey AS VARCHAR) AS pad_id, CAST(l_shipdate AS DATE) AS event_date, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1, 2")
def a11(spark, sf):
    raw = b.table(spark, sf, "lineitem").select(_s("l_suppkey").alias("pad_id"), F.when(F.col("l_linenumber") == 3, "n/a").otherwise(_iso("l_shipdate")).alias("event_date"))
    return readers.parse_truth_events(raw).groupBy("pad_id", "event_date").agg(F.count(F.lit(1)).alias("n"))


@query("a12_melt_benchmarks", f"WITH {o.MACRO} SELECT 'oil' AS symbol, d, rnd(oil, 6) AS px FROM macro UNION ALL SELECT 'rigs', d, CAST(rigs AS DOUBLE) FROM macro")
def a12(spark, sf):
    wide = b.macro(spark, sf).select("d", "oil", F.col("rigs").cast("double").alias("rigs"))
    return readers.melt_benchmarks(wide, "d", ["oil", "rigs"]).withColumn("px", rnd("px", 6))


_RUNS = """runs AS (SELECT CAST(o_custkey % 10 + 1 AS INTEGER) AS strategy, CAST(year(o_orderdate) AS VARCHAR) AS window_label,
 CAST(o_orderdate AS DATE) || '-strategy' || (o_custkey % 10 + 1) || '-target' || CASE WHEN o_orderkey % 3 = 0 THEN '-rerun' ELSE '' END AS run_name,
 CASE WHEN o_orderstatus = 'F' THEN 'full' ELSE 'summary' END AS kind FROM orders)"""


def _runs(spark, sf):
    n = F.col("o_custkey") % 10 + 1
    name = F.concat(_iso("o_orderdate"), F.lit("-strategy"), _s(n), F.lit("-target"), F.when(F.col("o_orderkey") % 3 == 0, "-rerun").otherwise(""))
    return b.table(spark, sf, "orders").select(n.cast("int").alias("strategy"), _s(F.year("o_orderdate")).alias("window"), name.alias("run_name"), F.when(F.col("o_orderstatus") == "F", "full").otherwise("summary").alias("kind"))


@query("a13_latest_run", f"""WITH {_RUNS} SELECT strategy, window_label AS window_label, run_name, kind FROM runs WHERE kind = 'summary' OR strategy IN (1, 2)
 QUALIFY row_number() OVER (PARTITION BY strategy, window_label ORDER BY run_name DESC, kind) = 1""")
def a13(spark, sf):
    return readers.latest_run(_runs(spark, sf)).withColumnRenamed("window", "window_label")


_SAMPLE_TICKERS = ["FANG", "COG", "CDEV", "ECA", "XLE", "ZZZ", "EOG"]


@query("b1_remap_entities", """WITH r AS (SELECT *, CASE l_suppkey % 7 WHEN 0 THEN 'FANG' WHEN 1 THEN 'CTRA' WHEN 2 THEN 'PR' WHEN 3 THEN 'OVV' WHEN 4 THEN 'XLE' WHEN 6 THEN 'EOG' END AS ticker FROM lineitem)
 SELECT ticker, count(*) AS n, rnd(sum(l_quantity), 2) AS qty FROM r WHERE ticker IS NOT NULL GROUP BY 1""")
def b1(spark, sf):
    name = F.element_at(F.array(*[F.lit(t) for t in _SAMPLE_TICKERS]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    rows = identity.remap_entities(b.table(spark, sf, "lineitem").withColumn("ticker", name), "ticker")
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("qty"))


@query("b2_filter_name_prefix", """SELECT p_partkey, p_type, p_name FROM part WHERE (p_type = 'ECONOMY' AND (starts_with(lower(p_name), 'small') OR starts_with(lower(p_name), 'red')))
 OR (p_type = 'STANDARD' AND starts_with(lower(p_name), 'b'))""")
def b2(spark, sf):
    part = b.table(spark, sf, "part").select("p_partkey", "p_type", "p_name")
    return identity.filter_name_prefix(part, "p_type", "p_name", {"ECONOMY": ["small", "red"], "STANDARD": ["b"]})


@query("b3_drop_contaminated", "SELECT p_type, count(*) AS n FROM part WHERE NOT (p_type = 'ECONOMY' AND contains(upper(p_name), 'WIDGET')) GROUP BY 1")
def b3(spark, sf):
    rows = identity.drop_contaminated(b.table(spark, sf, "part"), "p_type", "p_name", "ECONOMY", "WIDGET")
    return rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("b4_normalize_operator", """SELECT p_partkey, CASE WHEN contains(upper(p_name), 'RED') OR contains(upper(p_name), 'BLUE') THEN 'COLOR' WHEN contains(upper(p_name), 'WIDGET') THEN 'WIDGET' WHEN contains(upper(p_name), 'R') THEN 'R' END AS op FROM part""")
def b4(spark, sf):
    part = b.table(spark, sf, "part").select("p_partkey", "p_name")
    return identity.normalize_operator(part, "p_name", "op", {"COLOR": ["RED", "BLUE"], "WIDGET": ["WIDGET"], "R": ["R"]}).drop("p_name")


@query("b5_union_price_sources", f"""WITH {o.PRICES}, sup AS (SELECT c_nationkey AS firm, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice / 100) AS px FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 u AS (SELECT firm, d, px FROM prices UNION ALL SELECT firm, d, px FROM sup WHERE d > DATE '1999-12-31' AND NOT EXISTS (SELECT 1 FROM prices p WHERE p.firm = sup.firm AND p.d = sup.d))
 SELECT firm, d, rnd(px, 7) AS px FROM u""")
def b5(spark, sf):
    cust = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("firm"))
    sup = b.table(spark, sf, "orders").join(cust, "o_custkey").groupBy("firm", F.to_date("o_orderdate").alias("d")).agg(F.avg(F.col("o_totalprice") / 100).alias("px"))
    both = identity.union_price_sources(b.prices(spark, sf).select("firm", "d", "px"), sup, ["firm"], "d", F.to_date(F.lit("1999-12-31")))
    return both.withColumn("px", rnd("px", 7))


@query("b6_pct_change", f"""WITH {o.PRICES} SELECT firm, d, rnd((px - lag(px) OVER w) / lag(px) OVER w, 6) AS ret FROM prices WINDOW w AS (PARTITION BY firm ORDER BY d)""")
def b6(spark, sf):
    return identity.pct_change(b.prices(spark, sf), ["firm"], "d", "px").select("firm", "d", rnd("ret", 6).alias("ret"))


@query("b7_quarter_arithmetic", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), q AS (SELECT d, last_day(CAST(date_trunc('quarter', d) AS DATE) + INTERVAL 2 MONTH) AS q_end FROM d)
 SELECT d, q_end, CAST(date_trunc('quarter', q_end) AS DATE) AS q_start, last_day(q_end - INTERVAL 3 MONTH) AS prior_1, last_day(q_end - INTERVAL 12 MONTH) AS prior_4 FROM q""")
def b7(spark, sf):
    d = b.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("q_end", dates.quarter_end("d"))
    return d.select("d", "q_end", dates.quarter_start("q_end").alias("q_start"), dates.prior_quarter_end("q_end", 1).alias("prior_1"), dates.prior_quarter_end("q_end", 4).alias("prior_4"))


@query("b8_quarter_spine", """WITH s AS (SELECT c_nationkey AS firm, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
 q AS (SELECT firm, unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', z), INTERVAL 3 MONTH)) AS q FROM s)
 SELECT firm, year(q) || 'Q' || quarter(q) AS label, last_day(CAST(q AS DATE) + INTERVAL 2 MONTH) AS fpe FROM q""")
def b8(spark, sf):
    e = b.estimates(spark, sf).groupBy("firm").agg(F.min("anndats").alias("a"), F.max("anndats").alias("z"))
    q = e.select("firm", F.explode(dates.quarter_spine(dates.quarter_end("a"), dates.quarter_end("z"))).alias("q"))
    q = q.withColumn("label", F.concat(_s(F.year("q")), F.lit("Q"), _s(F.quarter("q"))))
    return q.select("firm", "label", dates.parse_quarter_label("label").alias("fpe"))


@query("b9_cell_grid", f"WITH {o.CELLS} SELECT firm, fpe, ed, t FROM cells WHERE fpe BETWEEN DATE '1996-03-31' AND DATE '1999-12-31'")
def b9(spark, sf):
    universe = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("firm"))
    ends = [dates.parse_quarter_label(F.lit(q)) for q in ("1996Q1", "1999Q4")]
    return identity.cell_grid(universe, ends[0], ends[1], b.earnings(spark, sf))


@query("b10_calendar_decision_date", f"WITH {o.CELLS} SELECT firm, fpe, CAST(fpe + 31 AS DATE) AS t FROM cells")
def b10(spark, sf):
    return b.cells(spark, sf).select("firm", "fpe", dates.calendar_decision_date("fpe").alias("t"))


@query("b11_latest_fiscal_year", f"WITH {o.CELLS} SELECT firm, fpe, t, CAST(CASE WHEN month(t) <= 3 THEN year(t) - 2 ELSE year(t) - 1 END AS INTEGER) AS fiscal_year FROM cells")
def b11(spark, sf):
    return b.cells(spark, sf).select("firm", "fpe", "t", dates.latest_fiscal_year("t").alias("fiscal_year"))


@query("b12_linear_to_db", "SELECT l_suppkey AS pad_id, count(*) AS n, rnd(avg(10 * log10(l_tax)), 6) AS mean_db FROM lineitem WHERE l_tax > 0 GROUP BY 1")
def b12(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pad_id"), scoring.linear_to_db("l_tax").alias("db")).where("db IS NOT NULL")
    return rows.groupBy("pad_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("db"), 6).alias("mean_db"))


@query("b13_is_quarter_end", f"""WITH {o.PRICES} SELECT firm, d, ntrades FROM prices WHERE month(d) IN (3, 6, 9, 12) AND d = last_day(d)""")
def b13(spark, sf):
    return b.prices(spark, sf).where(dates.is_quarter_end("d")).select("firm", "d", "ntrades")


@query("b14_year_window", f"WITH {o.CELLS} SELECT CASE WHEN year(fpe) BETWEEN 1996 AND 1999 THEN CAST(year(fpe) AS VARCHAR) ELSE '2000' END AS window_label, count(*) AS n FROM cells GROUP BY 1")
def b14(spark, sf):
    return b.cells(spark, sf).groupBy(dates.year_window("fpe", 1996, 1999, "2000").alias("window_label")).agg(F.count(F.lit(1)).alias("n"))


_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


@query("b15_strip_html", f"SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g') AS body FROM pages")
def b15(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


_NUM = r"([0-9]{1,3}(?:\.[0-9]+)?)"


@query("b16_extract_share", f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g') AS body FROM pages)
 SELECT page_id, list_filter(list_transform(regexp_extract_all(body, '(?i){_NUM}', 1), lambda s: CAST(s AS DOUBLE) / 100.0::DOUBLE), lambda x: x >= 0.05 AND x <= 1.0)[1] AS share FROM p""")
def b16(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.extract_share(text.strip_html(F.col("html")), _NUM).alias("share"))


_FILINGS = """filings AS (SELECT o_custkey AS firm, CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN o_orderkey % 3 = 0 THEN '10-Q' ELSE '10-K' END AS form, o_orderkey AS filing_id FROM orders)"""


@query("b17_filing_for_fiscal_year", f"""WITH {_FILINGS} SELECT firm, CAST(year(filing_date) - 1 AS INTEGER) AS fiscal_year, filing_date, filing_id FROM filings WHERE form = '10-K'
 QUALIFY row_number() OVER (PARTITION BY firm, year(filing_date) ORDER BY filing_date DESC, filing_id DESC) = 1""")
def b17(spark, sf):
    f = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("firm"), F.to_date("o_orderdate").alias("filing_date"), F.when(F.col("o_orderkey") % 3 == 0, "10-Q").otherwise("10-K").alias("form"), F.col("o_orderkey").alias("filing_id"),
    )
    return identity.filing_for_fiscal_year(f, "firm").select("firm", "fiscal_year", "filing_date", "filing_id")


@query("b18_fraction_with_provenance", f"""WITH f AS (SELECT page_id, 'T' || (page_id % 12) AS ticker, CAST(2018 + page_id % 5 AS INTEGER) AS fiscal_year, make_date(CAST(2019 + page_id % 5 AS BIGINT), 2, CAST(1 + page_id % 28 AS BIGINT)) AS filing_date,
  regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g') AS body FROM pages WHERE page_id % 4 <> 0),
 g AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '(?i){_NUM}', 1), lambda s: CAST(s AS DOUBLE) / 100.0::DOUBLE), lambda x: x >= 0.05 AND x <= 1.0)[1] AS share FROM f
  QUALIFY row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY filing_date DESC, page_id DESC) = 1),
 targets AS (SELECT t.ticker, y.fiscal_year FROM (SELECT DISTINCT 'T' || (page_id % 12) AS ticker FROM pages) t, (SELECT CAST(unnest(range(2018, 2025)) AS INTEGER) AS fiscal_year) y)
 SELECT ticker, fiscal_year, CASE WHEN ticker IN ('T1', 'T5') THEN 1.0::DOUBLE ELSE share END AS fraction,
  CASE WHEN ticker IN ('T1', 'T5') THEN 'pure_play_default' WHEN filing_date IS NULL THEN 'manual' WHEN share IS NOT NULL THEN 'regex_table' ELSE 'llm_narrative' END AS method,
  CASE WHEN ticker NOT IN ('T1', 'T5') THEN filing_date END AS source_filing_date,
  CASE WHEN ticker IN ('T1', 'T5') THEN 'Pure-play Permian operator; assumed 100% Permian.' WHEN filing_date IS NULL THEN 'No 10-K filed in CY ' || (fiscal_year + 1) || '.'
   WHEN share IS NOT NULL THEN 'Regex match on ''<X>% ... production''.' ELSE 'Regex did not match; pass excerpt to LLM with `llm_extract_permian_fraction_prompt`.' END AS notes
 FROM targets LEFT JOIN g USING (ticker, fiscal_year)""")
def b18(spark, sf):
    k = F.col("page_id")
    pages = b.table(spark, sf, "pages").withColumn("ticker", F.concat(F.lit("T"), _s(k % 12)))
    filings = pages.select(
        "ticker", F.make_date((k % 5 + 2019).cast("int"), F.lit(2), (k % 28 + 1).cast("int")).alias("filing_date"),
        F.when(k % 4 == 0, "10-Q").otherwise("10-K").alias("form"), k.alias("filing_id"), "html",
    )
    targets = pages.select("ticker").distinct().withColumn("fiscal_year", F.explode(F.sequence(F.lit(2018), F.lit(2024))))
    return identity.fraction_with_provenance(targets, filings, "ticker", ["T1", "T5"], _NUM)


@query("b19_extract_json_object", """SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN role END AS role, CASE WHEN turn % 3 <> 2 THEN turn END AS n FROM conversations""")
def b19(spark, sf):
    body = F.to_json(F.struct("role", F.col("turn").alias("n")))
    noisy = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>{"), "text", F.lit("}</think>\n\n```json\n"), body, F.lit("\n```\n")))
    noisy = noisy.when(F.col("turn") % 3 == 1, F.concat(F.lit("The answer is: "), body, F.lit(" as asked."))).otherwise(F.translate("text", "{}", "()"))
    found = F.from_json(text.json_object_text(noisy), "role string, n bigint")
    return b.table(spark, sf, "conversations").select("conv_id", "turn", found["role"].alias("role"), found["n"].alias("n"))


@query("b20_canonical_key", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS key FROM customer""")
def b20(spark, sf):
    return b.table(spark, sf, "customer").select("c_custkey", hashing.canonical_key("c_nationkey", "c_custkey", "c_mktsegment").alias("key"))
