"""Writers and the set operations around them. Writers return nothing; everything else is lazy."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitspark.functions.text import log_safe
from pitspark.operators.core import latest_row
from pitspark.sources.readers import read_table


def upsert_by_key(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Existing rows whose key is not in ``new``, plus ``new``: the last write wins. Of several new rows
    with one key the last in ``order`` counts (by the greatest values of the other columns, if no order
    is given). NULL is a key like any other."""
    rest = [*order, *[c for c in new.columns if c not in keys and c not in order]]
    last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]) if rest else new.distinct()
    touched = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
    same = reduce(Column.__and__, [existing[c].eqNullSafe(touched[f"_k{i}"]) for i, c in enumerate(keys)])
    return existing.join(touched, same, "left_anti").unionByName(last, allowMissingColumns=True)


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    return latest_row(df, keys, [F.col(c).desc() for c in order])


def pending(cells: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells without a finished result: what a resumed run still has to do."""
    return cells.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def with_errors(df: DataFrame, message: Column, limit: int = 200) -> DataFrame:
    """Turn rows with an error message into no-trade rows that carry it, cut to ``limit``."""
    bad = message.isNotNull()
    return df.withColumns({
        "direction": F.when(bad, "no_trade").otherwise(F.col("direction")),
        "size": F.when(bad, 0.0).otherwise(F.col("size")),
        "error": F.substring(F.coalesce(message, F.lit("")), 1, limit),
    })


def quality_log(df: DataFrame, keys: Sequence[str], low_quality: str, reason: str) -> DataFrame:
    return df.select(*keys, F.col(low_quality).alias("low_quality_flag"), log_safe(F.col(reason)).alias("reason"))


def write_mirrored(df: DataFrame, folder: str, name: str, max_rows: int = 1_000_000) -> None:
    """The table as Parquet, and the same rows as one CSV file with header. The CSV is made from the
    written Parquet, so the plan runs once. One file is one task, so a table of more than ``max_rows``
    rows is no report and raises an error (after the Parquet was written); nothing is cut."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    rows = df.sparkSession.read.parquet(f"{folder}/{name}.parquet").count()
    if rows > max_rows:
        raise ValueError(f"{name} has {rows} rows, more than the {max_rows} that one CSV file may hold")
    df.sparkSession.read.parquet(f"{folder}/{name}.parquet").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_json_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Parquet laid out by the named columns, rows of one value written by few tasks."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(path)


VERSIONS = "number long, folder string"


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> str:
    """Upsert into a versioned Parquet table and return the new version's folder. The version is
    written beside the old ones, since a folder cannot be overwritten while it is read, and becomes
    current when its line is added to the list of versions. One writer at a time; several need a table
    format with transactions."""
    current = current_version(spark, path)
    number = 0 if current is None else current.number + 1
    merged = new if current is None else upsert_by_key(spark.read.parquet(current.folder), new, keys)
    folder = f"{path}/data/{number:08d}-{uuid.uuid4().hex[:8]}"
    merged.write.parquet(folder)
    spark.createDataFrame([(number, folder)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return folder


def current_version(spark: SparkSession, path: str) -> Row | None:
    """Number and folder of the newest finished version; None before the first."""
    listed = read_table(spark, f"{path}/versions", StructType.fromDDL(VERSIONS))
    newest = listed.orderBy(F.col("number").desc()).limit(1).collect()
    return newest[0] if newest else None
