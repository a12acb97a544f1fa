"""Readers. ``read_table`` brings a file in with a declared schema; the ``parse_*`` functions apply
each table's own rule for bad values and work on any DataFrame with the raw columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark import params, schemas
from pitspark.functions.text import article_key
from pitspark.operators.core import block_scan, latest_row

ISO = "yyyy-M-d"


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """CSV with header, Parquet, or files of JSON arrays. A missing path gives an empty typed frame."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if fmt == "json":
        reader = reader.option("multiLine", True)
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def iso_date(col: str):
    return F.try_to_date(F.col(col), ISO)


def number(col: str):
    return F.col(col).try_cast("double")


def parse_estimates(raw: DataFrame) -> DataFrame:
    """Bad dates become NULL; a row without a numeric value is dropped."""
    return raw.select(
        F.col("row_id").try_cast("bigint").alias("row_id"), F.col("OFTIC").alias("firm"), F.col("CNAME").alias("cname"),
        iso_date("FPEDATS").alias("fpe"), iso_date("ANNDATS").alias("anndats"),
        F.try_to_date(F.trim("REVDATS"), ISO).alias("revdats"), number("VALUE").alias("value"), F.col("ANALYS").alias("analyst"),
        F.col("FPI").try_cast("int").alias("fpi"), F.col("MEASURE").alias("measure"), F.col("ANNDATS_ACT").alias("anndats_act"),
    ).where("value IS NOT NULL")


def parse_prices(raw: DataFrame) -> DataFrame:
    """Adjusted close |PRC|/CFACPR. A blank factor is 1 and a zero factor leaves the price unscaled;
    a blank return or the marker C is NULL; any other bad number drops the row."""
    factor = F.when(F.coalesce("CFACPR", F.lit("")) == "", F.lit(1.0)).otherwise(number("CFACPR"))
    no_return = F.coalesce("RET", F.lit("")).isin("", "C")
    parsed = raw.withColumns({"_p": F.abs(number("PRC")), "_f": factor, "_r": number("RET"), "d": iso_date("date")})
    ok = F.col("d").isNotNull() & F.col("_p").isNotNull() & F.col("_f").isNotNull() & (no_return | F.col("_r").isNotNull())
    return parsed.where(ok).select(
        F.col("TICKER").alias("ticker"), F.col("COMNAM").alias("name"), "d",
        F.when(F.col("_f") != 0, F.col("_p") / F.col("_f")).otherwise(F.col("_p")).alias("adj_close"),
        F.when(~no_return, F.col("_r")).alias("ret"), number("SHROUT").alias("shrout"), F.col("_p").alias("close"),
    )


def parse_supplement(raw: DataFrame) -> DataFrame:
    rows = raw.select("ticker", iso_date("date").alias("d"), number("adj_close").alias("adj_close"), number("ret").alias("ret"))
    return rows.where("d IS NOT NULL AND adj_close IS NOT NULL")


def parse_fundq(raw: DataFrame) -> DataFrame:
    """Ticker and period end are required; every measure is NULL when it does not parse."""
    measures = [f.name for f in schemas.RAW_FUNDQ if f.name not in ("tic", "datadate", "rdq")]
    have = [m for m in measures if m in raw.columns]
    rows = raw.select(F.col("tic").alias("firm"), iso_date("datadate").alias("datadate"), iso_date("rdq").alias("rdq"), *[number(m).alias(m) for m in have])
    return rows.where("firm <> '' AND datadate IS NOT NULL")


def parse_macro(raw: DataFrame, whole: bool = False) -> DataFrame:
    """Two-column series; bad rows are dropped. ``whole`` truncates to whole numbers."""
    value = number("value").cast("bigint") if whole else number("value")
    return raw.select(iso_date("date").alias("d"), value.alias("value")).where("d IS NOT NULL AND value IS NOT NULL")


def parse_permits(raw: DataFrame) -> DataFrame:
    """Permit date and coordinates are required; later filings are NULL when blank."""
    rows = raw.select(
        "pad_id", "operator_at_permit", "operator_normalized", number("latitude").alias("lat"), number("longitude").alias("lon"),
        iso_date("permit_filing_date").alias("permit_date"), iso_date("spud_filing_date").alias("spud_date"),
        iso_date("completion_filing_date").alias("completion_date"),
    )
    return rows.where("permit_date IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def parse_pads_known_at(raw: DataFrame, t) -> DataFrame:
    """Pads whose permit was filed by ``t``; rows that do not parse are dropped."""
    return parse_permits(raw).where(F.col("permit_date") <= t).select("pad_id", "operator_at_permit", "lat", "lon", "permit_date")


def parse_sar_files(texts: DataFrame, col: str) -> DataFrame:
    """Observations out of JSON array texts. A corrupt text is skipped; a scene that overlapping
    windows repeat is kept once per pad."""
    obs = texts.select(F.explode(F.from_json(col, schemas.SAR_FILE)).alias("o")).select("o.*")
    rest = [f.name for f in schemas.SAR_OBS if f.name not in ("pad_id", "scene_id")]
    once = obs.where("pad_id IS NOT NULL").groupBy("pad_id", "scene_id").agg(F.max(F.struct(*rest)).alias("o"))
    return once.select("pad_id", "scene_id", "o.*")


def parse_articles(raw: DataFrame, response: str, position: str) -> DataFrame:
    """Articles of news responses. The stamp is cut to its date; rows with a bad stamp are dropped.
    The id is the tail of the address, or the article's ordinal in its response when it has none."""
    day = F.to_date(F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")))
    kept = raw.withColumn("publish_date", day).where("publish_date IS NOT NULL").withColumn("_b", F.floor(F.col(position) / 4096))
    counted = block_scan(kept, [response], ["_b"], [position], sums={"_ord": F.lit(1).cast("bigint")})
    key = F.coalesce(article_key(F.col("url")), (F.col("_ord") - 1).cast("string"))
    return counted.select(response, key.alias("article_id"), "publish_date", "title", "url")


def parse_fraction(raw: DataFrame, position: str = "row_id") -> DataFrame:
    """Basin share per ticker and fiscal year from either of two columns; blank and bad values are
    skipped and a later row replaces an earlier one."""
    text = F.coalesce(F.nullif("permian_production_fraction_ttm", F.lit("")), F.col("permian_fraction_ttm"))
    rows = raw.select("ticker", F.col("fiscal_year").try_cast("int").alias("fiscal_year"), F.trim(text).try_cast("double").alias("fraction"), position)
    rows = rows.where("fraction IS NOT NULL AND fiscal_year IS NOT NULL")
    return rows.groupBy("ticker", "fiscal_year").agg(F.max_by("fraction", position).alias("fraction"))


def default_fraction(spark: SparkSession) -> DataFrame:
    """The share table used when no file is supplied."""
    first, last = params.SHARE_YEARS
    rows = [(t, y, 1.0 if t in params.PURE_PLAY else params.MULTI_BASIN_SHARE) for t in params.UNIVERSE for y in range(first, last + 1)]
    return spark.createDataFrame(rows, "ticker string, fiscal_year int, fraction double")


def read_fraction(spark: SparkSession, path: str) -> DataFrame:
    raw = read_table(spark, path, schemas.RAW_FRACTION, "csv").withColumn("row_id", F.monotonically_increasing_id())
    return parse_fraction(raw) if raw.inputFiles() else default_fraction(spark)


def parse_earnings(raw: DataFrame, position: str = "row_id") -> DataFrame:
    """(firm, fpe) to event date; a later row replaces an earlier one."""
    rows = raw.select(F.col("ticker").alias("firm"), iso_date("fiscal_quarter_end").alias("fpe"), iso_date("earnings_date_actual").alias("ed"), position)
    return rows.where("fpe IS NOT NULL AND ed IS NOT NULL").groupBy("firm", "fpe").agg(F.max_by("ed", position).alias("ed"))


def parse_truth_events(raw: DataFrame) -> DataFrame:
    return raw.select("pad_id", iso_date("event_date").alias("event_date")).where("event_date IS NOT NULL")


def melt_benchmarks(wide: DataFrame, date: str, symbols: list[str]) -> DataFrame:
    """Wide price table to (symbol, d, px)."""
    return wide.unpivot([date], symbols, "symbol", "px").withColumnRenamed(date, "d").where("px IS NOT NULL")


def latest_run(files: DataFrame, full_for: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Newest usable output per strategy and window, by run name in reverse order, so that a suffixed
    run comes before its base. Only the strategies in ``full_for`` use full outputs, and prefer them
    to a summary of the same run. ``files`` has run_name, strategy, window, kind (full | summary)."""
    usable = files.where((F.col("kind") == "summary") | ((F.col("kind") == "full") & F.col("strategy").isin(*full_for)))
    return latest_row(usable, ["strategy", "window"], [F.col("run_name").desc(), F.col("kind").asc()])
