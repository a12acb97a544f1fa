"""Cached observation files as a source: one JSON text per file, its place and window in the file's name.

A file is one row with its name, so what is wrong is said of the file it is wrong in. Nothing is parsed on the driver.
Loose files (``write_texts``, ``read_texts``) cost a listing, an open and, when written, a folder and a rename each,
some milliseconds whatever they hold, and the driver lists them all. A large cache is therefore kept in packs
(``pack_texts``, ``read_packed``): Parquet parts with many files each, a row per file, their number given by the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark import schemas

NAME = r"([^/=]+)_(-?\d+(?:\.\d+)?)_(-?\d+(?:\.\d+)?)_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})"
REQUIRED = ("pad_id", "lat", "lon", "scene_id", "acquisition_date", "vv_mean_linear", "vv_mean_db")
FINE, NO_JSON, NO_LIST, TOO_FEW = "fine", "no_json", "no_list", "too_few"
MINIMUM = 30


def _day(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def read_texts(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(file, bytes, text) of every file under a folder; ``pattern`` is a glob on file names."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))


def with_window(texts: DataFrame) -> DataFrame:
    """Adds what the name says: (pad_id, lat, lon, first_day, last_day, year). The name may be the file's own or
    that of the folder it is alone in; without such a name they are NULL."""
    part = lambda i: F.nullif(F.regexp_extract("file", NAME, i), F.lit(""))
    named = texts.withColumns({"pad_id": part(1), "lat": part(2).cast("double"), "lon": part(3).cast("double"), "first_day": _day(part(4)), "last_day": _day(part(5))})
    return named.withColumn("year", F.year("first_day"))


def _records(parsed: Column) -> Column:
    """The required fields of the elements of a parsed JSON list, NULL for an element that is no object; NULL if the
    text is no JSON or no list."""
    kinds = ",".join(f"{name}:{'string' if name == 'acquisition_date' else 'variant'}" for name in REQUIRED)
    return F.try_variant_get(parsed, "$", f"array<struct<{kinds}>>")


def _is_incomplete(record: Column) -> Column:
    """An element that is no object, lacks a required field (null is a value), or has a date that is none."""
    lacks = record.isNull() | _day(record["acquisition_date"]).isNull()
    for name in REQUIRED:
        lacks = lacks | record[name].isNull()
    return lacks


def audit_observation_files(texts: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """One row per file: the window of its name, ``status`` (no_json, no_list, too_few, fine), how many
    observations it lists, how many of these are incomplete, and whether a reader takes it: a list whose elements
    are all complete. An empty file is no JSON, an empty list has too few observations."""
    parsed = with_window(texts).withColumn("_v", F.try_parse_json("text")).withColumn("_r", _records(F.col("_v")))
    rows = parsed.withColumns({"_list": F.col("_r").isNotNull(), "_json": F.col("_v").isNotNull(), "_n": F.when(F.col("_r").isNotNull(), F.size("_r"))})
    incomplete = F.size(F.filter("_r", _is_incomplete))
    status = F.when(~F.col("_json"), NO_JSON).when(~F.col("_list"), NO_LIST).when(F.col("_n") < minimum, TOO_FEW).otherwise(FINE)
    rows = rows.withColumns({"status": status, "n_obs": F.coalesce("_n", F.lit(0)).cast("long"), "n_incomplete": F.when(F.col("_list"), incomplete).otherwise(0).cast("long")})
    return rows.select("file", "bytes", "pad_id", "lat", "lon", "first_day", "last_day", "year", "status", "n_obs", "n_incomplete", (F.col("_list") & (F.col("n_incomplete") == 0)).alias("readable"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per year and status: files and observations; issues are files that are no JSON or no list."""
    issue = F.col("status").isin(NO_JSON, NO_LIST)
    return audit.groupBy("year", "status").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_obs").alias("n_obs"), F.count_if(issue).alias("n_issues"), F.count_if(~F.col("readable")).alias("n_unreadable"))


def read_observations(texts: DataFrame) -> DataFrame:
    """The observations of all readable files with the file they are from. A file with one incomplete element is
    left out whole, as it has to be fetched again. A scene that overlapping windows repeat is kept once per pad:
    from the window that starts first, then by file and by the smallest values."""
    readable = with_window(texts).where(~F.exists(_records(F.try_parse_json("text")), _is_incomplete))  # NULL, so left out, where there is no list
    parsed = readable.select("file", "first_day", F.explode(F.from_json("text", schemas.SAR_FILE)).alias("o")).select("file", "first_day", "o.*")
    rest = [c for c in parsed.columns if c not in ("pad_id", "scene_id", "first_day", "file")]
    once = parsed.groupBy("pad_id", "scene_id").agg(F.min(F.struct("first_day", "file", *rest)).alias("o"))
    return once.select("pad_id", "scene_id", "o.*").drop("first_day")


def audit_aggregates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Firm-quarter aggregate files, a JSON object each: per firm the files with at least one pad and their distinct
    quarters; and the files that are no JSON object."""
    parsed = texts.select("file", F.try_parse_json("text").alias("_v")).withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False)))
    field = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    with_pads = parsed.where("_object").where(F.coalesce(field("n_pads_sampled", "long"), F.lit(0)) > 0)
    rows = with_pads.select(F.coalesce(field("ticker", "string"), F.lit("?")).alias("firm"), field("fiscal_quarter_end", "string").alias("quarter"))
    return rows.groupBy("firm").agg(F.count(F.lit(1)).alias("n_aggregates"), F.count_distinct("quarter").alias("n_quarters")), parsed.where(~F.col("_object")).select("file")


def write_texts(named: DataFrame, folder: str) -> None:
    """(name, text) rows as one file each, in a folder of that name: what a fetcher would have cached. A name's
    rows go to one task, names are spread over all."""
    named.select("text", F.col("name").alias("file")).repartition("file").write.partitionBy("file").text(folder)


def pack_texts(named: DataFrame, folder: str) -> None:
    """(name, text) rows in packs, as many as the rows have partitions."""
    named.select(F.col("name").alias("file"), "text").write.option("compression", "zstd").parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, text) of every file in the packs under a folder; ``file`` is its name."""
    rows = spark.read.schema("file string, text string").parquet(folder)
    return rows.select("file", F.octet_length("text").cast("long").alias("bytes"), "text")
