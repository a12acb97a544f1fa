"""The event-study tables as derived from the supplied star schema.

Firm is the nation key; a decision cell is a firm and fiscal quarter with the event date ``ed`` and
the decision date ``t``. Every table here is a plain plan over whole input tables."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark import params
from pitspark.functions import dates
from pitspark.session import materialize

_scopes: ContextVar[tuple[dict, ...]] = ContextVar("_scopes", default=())


@contextmanager
def written_once(*names: str):
    """Within the block the named tables are written to the shared folder when first asked for, and
    every plan built in the block reads that one copy. A block inside another one shares the outer
    block's copies. Nothing is kept beyond the outermost block that named the table."""
    before = _scopes.set((*_scopes.get(), dict.fromkeys(names)))
    try:
        yield
    finally:
        _scopes.reset(before)


def derived(fn):
    """A table function that takes part in ``written_once`` under its own name."""
    name = fn.__name__

    @wraps(fn)
    def get(spark, sf):
        scope = next((s for s in _scopes.get() if name in s), None)
        if scope is None:
            return fn(spark, sf)
        if scope[name] is None:
            scope[name] = materialize(fn(spark, sf), name)
        return scope[name]

    return get


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _lines(spark, sf) -> DataFrame:
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("firm"))
    lines = table(spark, sf, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    return lines.join(supplier, "l_suppkey")


@derived
def prices(spark, sf) -> DataFrame:
    """(firm, d, px, ntrades): one daily price per firm."""
    return _lines(spark, sf).groupBy("firm", "d").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.count(F.lit(1)).alias("ntrades"))


@derived
def estimates(spark, sf) -> DataFrame:
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("firm"), "c_name")
    o = table(spark, sf, "orders").withColumn("anndats", F.to_date("o_orderdate"))
    fpe = dates.quarter_end(F.date_sub("anndats", 20))
    return o.join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("row_id"),
        "firm",
        F.col("c_name").alias("cname"),
        F.col("o_custkey").alias("analyst"),
        fpe.alias("fpe"),
        "anndats",
        F.when(F.col("o_orderstatus") == "F", F.col("anndats")).when(F.col("o_orderstatus") == "O", F.date_add("anndats", 30)).alias("revdats"),
        F.when(F.col("o_orderkey") % 5 == 0, F.date_add("anndats", 60)).alias("stopdats"),
        (F.col("o_orderkey") % 2 + 6).cast("int").alias("fpi"),
        F.when(F.col("o_orderpriority") == "5-LOW", "EPS").otherwise("SAL").alias("measure"),
        F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_add(fpe, (F.col("o_orderkey") % 15 + 20).cast("int")).cast("string")).alias("anndats_act"),
    )


@derived
def earnings(spark, sf) -> DataFrame:
    """(firm, fpe, ed): one event date per firm and fiscal quarter."""
    cells = estimates(spark, sf).select("firm", "fpe").distinct()
    return cells.withColumn("ed", F.date_add("fpe", F.col("firm") % 15 + 20))


@derived
def cells(spark, sf) -> DataFrame:
    return earnings(spark, sf).withColumn("t", dates.decision_date("ed"))


@derived
def macro(spark, sf) -> DataFrame:
    """(d, oil, rigs): weekly price level and activity count."""
    lines = table(spark, sf, "lineitem").withColumn("d", F.to_date(F.date_trunc("week", "l_shipdate")))
    return lines.groupBy("d").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("oil"), F.count(F.lit(1)).alias("rigs"))


@derived
def fundq(spark, sf) -> DataFrame:
    """Quarterly fundamentals in millions. Some announcement dates are missing, some arrive late
    enough to be out of order."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    g = (
        _lines(spark, sf)
        .withColumn("datadate", dates.quarter_end("d"))
        .groupBy("firm", "datadate")
        .agg(
            F.sum(p).alias("sp"), F.sum(p * F.col("l_discount")).alias("spd"), F.sum(p * F.col("l_tax")).alias("spt"),
            F.sum(q).alias("sq"), F.sum(p * F.col("l_discount") * F.col("l_tax")).alias("spdt"),
        )
    )
    f, m = F.col("firm"), F.month("datadate")
    late = F.when((m == 6) & (f % 3 == 0), 100).otherwise(0)
    return g.select(
        "firm", "datadate",
        F.when(f % 7 != 0, F.date_add("datadate", (f + 30 + late).cast("int"))).alias("rdq"),
        (F.col("sp") / 1e6).alias("saleq"), (F.col("spd") / 1e6).alias("oibdpq"),
        ((F.col("spd") - F.col("sp") * 0.03) / 1e6).alias("niq"),
        F.when(~((m == 12) & (f % 4 == 1)), F.col("spt") / 1e6).alias("oancfy"),
        F.when(f % 9 != 8, F.col("spdt") / 1e6).alias("capxy"),
        (F.col("sq") / 500 - F.when(f % 11 == 10, F.col("sq")).otherwise(0)).alias("ceqq"),
        F.when(f % 5 != 0, F.col("sp") * 0.2 / 1e6).alias("dlttq"),
        (F.col("spt") * 0.1 / 1e6).alias("dlcq"),
        F.when(f % 6 != 0, F.col("sq") / 1000).alias("cheq"),
    )


@derived
def permits(spark, sf) -> DataFrame:
    """One well pad per supplier, spread over the calendar by key."""
    k = F.col("l_suppkey")
    g = _lines(spark, sf).groupBy("l_suppkey", "firm").agg(F.min("d").alias("first_d"))
    g = g.withColumn("permit_date", F.date_add("first_d", (k * 37 % 2000).cast("int")))
    return g.select(
        k.alias("pad_id"), "firm", "permit_date",
        F.when(k % 8 != 3, F.date_add("permit_date", 120)).alias("spud_date"),
        F.when(k % 6 != 0, F.date_add("permit_date", 300)).alias("completion_date"),
        (F.lit(31.0) + (k % 200) / 100.0).alias("lat"), (F.lit(-104.0) + (F.floor(k / 200) % 200) / 100.0).alias("lon"),
    )


def sar_obs(spark, sf) -> DataFrame:
    """Radar observations: one per order line, keyed by pad and scene."""
    li = table(spark, sf, "lineitem")
    vv = F.lit(0.01) + F.col("l_discount") + F.col("l_tax")
    return li.select(
        F.col("l_suppkey").alias("pad_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene_id"),
        F.to_date("l_shipdate").alias("acq"), vv.alias("vv"), (10 * F.log10(vv)).alias("vv_db"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") / 2).alias("vh"),
    )


def observation_files(spark, sf) -> DataFrame:
    """(name, text): a file per pad and year as a fetcher would cache it. By pad some are cut off, some are an
    object instead of a list, and some hold a record without its values."""
    obs = sar_obs(spark, sf).join(permits(spark, sf).select("pad_id", "lat", "lon"), "pad_id").withColumn("year", F.year("acq"))
    record = F.struct(
        F.col("pad_id").cast("string").alias("pad_id"), "lat", "lon", F.col("scene_id").cast("string").alias("scene_id"), F.date_format("acq", "yyyy-MM-dd").alias("acquisition_date"),
        F.col("vv").alias("vv_mean_linear"), F.col("vv_db").alias("vv_mean_db"), F.col("vh").alias("vh_mean_linear"),
    )
    per = obs.groupBy("pad_id", "lat", "lon", "year").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("text"))
    name = F.format_string("%d_%.4f_%.4f_%d-01-01_%d-12-31", "pad_id", "lat", "lon", "year", "year")
    kind, text = F.col("pad_id") % 7, F.col("text")
    broken = F.when(kind == 3, F.left(text, F.length(text) - 9)).when(kind == 5, F.concat(F.lit('{"observations":'), text, F.lit("}")))
    short = F.when(kind == 6, F.concat(F.lit('[{"pad_id":"0"},'), F.substring(text, F.lit(2), F.length(text))))
    return per.select(name.alias("name"), F.coalesce(broken, short, text).alias("text"))


def articles(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("outlet"), F.col("doc_id").alias("article_id"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 365).cast("int")).alias("publish_date"), F.col("text").alias("body"),
    )


def outlet_cells(spark, sf) -> DataFrame:
    """Outlet x quarter of 2024, with the previous event date."""
    outlets = table(spark, sf, "documents").select(F.col("source").alias("outlet")).distinct()
    spine = dates.quarter_spine(F.to_date(F.lit("2024-03-31")), F.to_date(F.lit("2024-12-31")))
    grid = outlets.withColumn("fpe", F.explode(spine))
    return grid.withColumn("t", F.date_add("fpe", 6)).withColumn("prev_ed", F.date_add(dates.prior_quarter_end("fpe", 1), 20))


def company_news(spark, sf) -> DataFrame:
    """The articles with a mention of a company behind the whole text, in capitals, broken over lines or in a
    possessive; some mention none of the registered ones, some lack a keyword."""
    k = F.col("article_id")
    names = F.array(*[F.lit(x) for x in [*params.NEWS_PHRASES.values(), "Diamondbacks Energy", "Devon Energetic"]])
    name = F.get(names, (k % 12).cast("int"))
    spelled = F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.replace(name, F.lit(" "), F.lit(" \n"))).otherwise(F.concat(name, F.lit("'s")))
    rest = F.when(k % 5 == 4, F.lit(" oil")).otherwise(F.lit(" Drilling for (oil)"))
    return articles(spark, sf).select("article_id", "publish_date", F.concat(F.coalesce("body", F.lit("")), F.lit("\n"), spelled, rest).alias("body"))


def ticker_cells(spark, sf) -> DataFrame:
    """Every company with the quarters of the outlets' cells."""
    tickers = F.array(*[F.lit(x) for x in params.UNIVERSE])
    return outlet_cells(spark, sf).select("fpe", "t", "prev_ed").distinct().withColumn("ticker", F.explode(tickers))


def news_registry(spark) -> tuple[DataFrame, DataFrame]:
    """(ticker, text) of the registered phrases and of the keywords that every ticker needs."""
    phrases = spark.createDataFrame(list(params.NEWS_PHRASES.items()), "ticker string, text string")
    keywords = spark.createDataFrame([(t, w) for t in params.NEWS_PHRASES for w in params.NEWS_KEYWORDS], "ticker string, text string")
    return phrases, keywords


def verdicts(spark, sf) -> DataFrame:
    """Raw verdict strings per order: what an outside judge would return, not yet normalised."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("firm"))
    o = table(spark, sf, "orders").join(customer, "o_custkey")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("verdict_id"), "firm", dates.quarter_end(F.date_sub(F.to_date("o_orderdate"), 20)).alias("fpe"),
        F.when(F.col("o_orderstatus") == "F", " Long ").when(F.col("o_orderstatus") == "O", "BUY").otherwise("hold").alias("decision"),
        F.when(p == "1-URGENT", "Strong").when(p == "2-HIGH", " high").when(p == "3-MEDIUM", "moderate").when(p == "5-LOW", "weak").alias("conviction_tier"),
        (F.col("o_totalprice") / 250000.0 - 0.1).alias("weight"),
        F.split(p, "[-E]").alias("evidence"),
        F.concat(p, F.lit(", status "), "o_orderstatus").alias("reasoning"),
        (F.col("o_custkey") % 4 == 0).alias("disclosed"),
    )


def truth_labels(spark, sf) -> DataFrame:
    """Documents with their judged and their predicted state."""
    q, x = F.col("quality"), F.col("toxic")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang",
        F.when(x == 1, "idle").when(q == 1, "newly_active").otherwise("continuously_active").alias("truth"),
        F.when(F.col("n_chars") % 3 == 0, "newly_active").when(F.col("n_chars") % 3 == 1, "continuously_active").otherwise("idle").alias("observed"),
    )
