"""Runs that survive a crash, and what they read.

``RunLog`` keeps the results of evaluated cells. An attempt stages its results in a folder of its own and publishes
them last, with one small file that can be created only once per number. What was staged but not published does not
exist for readers, so a run that stops in between is simply repeated: no cell is lost, none is counted twice.

``InputManifest`` records the content of a run's input tables file by file. The hash of a file is the sum of its
rows' hashes, so those of a table are the sum over its files, files can be hashed apart, and files that have not
changed since the last run are not read again. Two recorded runs are compared without reading any data."""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitspark.operators.quality import row_hash
from pitspark.sources.sinks import with_errors


class AlreadyPublished(RuntimeError):
    """Another attempt has published under the number that this one wanted."""


class Published:
    """Numbered entries of a folder, each a small JSON file that is created once. Creation fails where the file
    exists, on file systems whose create is atomic, as HDFS."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def entries(self) -> list[dict]:
        """All entries in order of their numbers."""
        fs, place = self._place()
        if not fs.exists(place):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(place))
        rows = self.spark.read.text([f"{self.folder}/{n}" for n in names if n.isdigit()]).collect() if any(n.isdigit() for n in names) else []
        return sorted((json.loads(r[0]) for r in rows), key=lambda e: e["number"])

    def add(self, number: int, entry: dict) -> None:
        fs, place = self._place(f"{number:012d}")
        try:
            out = fs.create(place, False)
        except Exception as error:
            if fs.exists(place):
                raise AlreadyPublished(f"{self.folder} has an entry {number}") from error
            raise
        out.write(bytearray(json.dumps(entry | {"number": number}).encode()))
        out.close()


class RunLog:
    """Results by cell in ``path``; ``keys`` name a cell. Of several published rows of a cell the last counts."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.log = Published(spark, f"{self.path}/published")

    def results(self) -> DataFrame | None:
        """Published results, one row per cell; None before the first."""
        entries = self.log.entries()
        if not entries:
            return None
        parts = [self.spark.read.schema(e["schema"]).parquet(f"{self.path}/attempts/{e['attempt']}").withColumn("_number", F.lit(e["number"])) for e in entries]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("_number")))
        return rows.withColumn("_last", last).where("_last = 1").drop("_last", "_number")

    def pending(self, cells: DataFrame, retry_errors: bool = True) -> DataFrame:
        """Cells without a published result, and those whose result is an error if these are to be tried again."""
        done = self.results()
        if done is None:
            return cells
        if retry_errors and "error" in done.columns:
            done = done.where(F.coalesce("error", F.lit("")) == "")
        finished = done.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).distinct()
        return cells.join(finished, reduce(Column.__and__, [cells[k].eqNullSafe(finished[f"_k{i}"]) for i, k in enumerate(self.keys)]), "left_anti")

    def stage(self, results: DataFrame) -> dict:
        """Write an attempt's results where no reader looks yet; the entry that would publish them. One row per
        cell: of several the one with the greatest values."""
        attempt = uuid.uuid4().hex
        rest = [c for c in results.columns if c not in self.keys]
        once = results.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*self.keys, "_r.*")
        once.write.parquet(f"{self.path}/attempts/{attempt}")
        return {"attempt": attempt, "schema": once.schema.toDDL()}

    def run(self, cells: DataFrame, evaluate: Callable[[DataFrame], DataFrame], message: Column | None = None, retry_errors: bool = True) -> dict:
        """Evaluate what is pending, stage it and publish it. ``evaluate`` takes cells and returns rows with the keys,
        direction and size; rows with a ``message`` become no-trades that carry it. The number to publish under is
        taken before the work, so of two runs over the same cells at once one is refused."""
        number = len(self.log.entries())
        results = evaluate(self.pending(cells, retry_errors))
        entry = self.stage(results if message is None else with_errors(results, message))
        self.log.add(number, entry)
        return entry | {"number": number}


FILES = "table_name string, file string, bytes long, modified timestamp, n_rows long, content_hash decimal(38,0)"


class InputManifest:
    """Fingerprints of input tables per run, in ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Published(spark, f"{self.path}/runs")

    @staticmethod
    def _file(path: Column, folder: str) -> Column:
        """A file's name below its table's folder."""
        return F.regexp_extract(path, re.escape(posixpath.basename(folder.rstrip("/"))) + r"/(.*)$", 1)

    def _listed(self, name: str, folder: str) -> DataFrame:
        """The table's files with size and time, from the file system alone."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        return files.select(F.lit(name).alias("table_name"), self._file(F.col("path"), folder).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    def files(self, run: str) -> DataFrame:
        """The files that a run has recorded."""
        entry = next(e for e in reversed(self.log.entries()) if e["run"] == run)
        return self.spark.read.schema(FILES).parquet(f"{self.path}/files/{entry['write']}")

    def record(self, run: str, tables: dict[str, str]) -> dict:
        """Record the tables (name to folder of Parquet files) under a run's name. Files that the last recorded run
        had with the same size and time keep their hash; the others are read. The entry says how many were."""
        entries = self.log.entries()
        before = self.files(entries[-1]["run"]) if entries else self.spark.createDataFrame([], FILES)
        parts, read = [], 0
        for name, folder in tables.items():
            known = self._listed(name, folder).join(before, ["table_name", "file", "bytes", "modified"], "left")
            new = [r.file for r in known.where("content_hash IS NULL").select("file").collect()]
            parts.append(known.where("content_hash IS NOT NULL").select("table_name", "file", "bytes", "modified", "n_rows", "content_hash"))
            if new:
                rows = self.spark.read.parquet(*[f"{folder.rstrip('/')}/{f}" for f in new])
                hashed = rows.select(self._file(F.col("_metadata.file_path"), folder).alias("file"), row_hash(rows).alias("_h")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("_h").cast("decimal(38,0)").alias("h"))
                fresh = known.where("content_hash IS NULL").join(hashed, "file", "left")
                parts.append(fresh.select("table_name", "file", "bytes", "modified", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("h", F.lit(0)).cast("decimal(38,0)").alias("content_hash")))
                read += len(new)
        write = uuid.uuid4().hex
        reduce(DataFrame.unionByName, parts).coalesce(1).write.parquet(f"{self.path}/files/{write}")
        entry = {"run": run, "write": write, "files_read": read, "tables": sorted(tables)}
        self.log.add(len(entries), entry)
        return entry

    def tables(self, run: str) -> DataFrame:
        """(table_name, n_files, n_rows, content_hash) of a recorded run."""
        total = F.sum("content_hash").cast("decimal(38,0)").cast("string")
        return self.files(run).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), total.alias("content_hash"))

    def drift(self, earlier: str, later: str) -> DataFrame:
        """Per table of either run: rows before and after, files added, removed and changed, and whether the content
        is the same. Files that were only rewritten or moved leave the content as it was."""
        a, b = (self.files(r).select("table_name", "file", F.col("n_rows").alias(f"n_{x}"), F.col("content_hash").alias(f"h_{x}")) for r, x in ((earlier, "a"), (later, "b")))
        both = a.join(b, ["table_name", "file"], "full")
        rows = both.groupBy("table_name").agg(
            F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_after"),
            F.count_if(F.col("h_a").isNull()).alias("files_added"), F.count_if(F.col("h_b").isNull()).alias("files_removed"), F.count_if(F.col("h_a") != F.col("h_b")).alias("files_changed"),
            F.coalesce(F.sum("h_a"), F.lit(0)).alias("_a"), F.coalesce(F.sum("h_b"), F.lit(0)).alias("_b"),
        )
        return rows.withColumn("same", (F.col("_a") == F.col("_b")) & (F.col("rows_before") == F.col("rows_after"))).drop("_a", "_b")
