"""A keyed Parquet table whose upserts rewrite only the buckets they touch.

Layout under the table's folder::

    data/<write>/bucket=<b>/   rows of bucket b, as the write with that id left them
    manifests/<write>/         one row per live bucket: (bucket, folder, rows)
    log/<number>               one small file per snapshot: its write id, number of buckets and keys

A row's bucket is a hash of its key. An upsert reads the buckets that the new rows fall into, writes these anew,
writes a manifest that points to them and to the untouched folders of the snapshot before, and publishes the
snapshot last, by creating its log file. Creation fails where the file exists, so of two writers that started from
one snapshot the second is refused (on file systems whose create is atomic, as HDFS). A write that stops earlier
leaves files that no snapshot names; readers still see the snapshot before, and ``expire`` removes them.

The driver handles one entry per bucket, never rows: buckets are sized from the data, about ``BUCKET_BYTES`` each,
and grow in number (doubling, so a bucket splits in two) once they hold several times that."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.sources.sinks import upsert_by_key

BUCKET_BYTES = 256 << 20
SPLIT_AT = 4
MANIFEST = "bucket int, folder string, rows long"


class ConcurrentUpsert(RuntimeError):
    """Another writer has published the snapshot that this one wanted to."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    write: str
    buckets: int
    keys: tuple[str, ...]
    schema: str
    bytes: int


class BucketTable:
    """``path`` is a folder on a file system that all executors share."""

    def __init__(self, spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.path, self.bucket_bytes = spark, path.rstrip("/"), bucket_bytes

    # --- the file system behind the folder

    def _hadoop(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        fs, place = self._hadoop(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []

    def _size(self, folder: str) -> int:
        fs, place = self._hadoop(folder)
        return fs.getContentSummary(place).getLength() if fs.exists(place) else 0

    def _publish(self, snapshot: Snapshot) -> None:
        fs, place = self._hadoop(f"{self.path}/log/{snapshot.number:012d}")
        try:
            out = fs.create(place, False)
        except Exception as error:
            if fs.exists(place):
                raise ConcurrentUpsert(f"snapshot {snapshot.number} of {self.path} was published by another writer") from error
            raise
        out.write(bytearray(json.dumps(snapshot.__dict__).encode()))
        out.close()

    # --- reading

    def snapshot(self, number: int | None = None) -> Snapshot | None:
        """The given snapshot, or the newest; None before the first."""
        numbers = sorted(n for n in self._names("log") if n.isdigit())
        name = f"{number:012d}" if number is not None else numbers[-1] if numbers else None
        if name is None:
            return None
        line = self.spark.read.text(f"{self.path}/log/{name}").first()[0]
        return Snapshot(**(fields := json.loads(line)) | {"keys": tuple(fields["keys"])})

    def manifest(self, snapshot: Snapshot) -> DataFrame:
        """(bucket, folder, rows) of the live buckets."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{snapshot.write}")

    def _rows(self, snapshot: Snapshot, entries: DataFrame) -> DataFrame:
        folders = [r.folder for r in entries.select("folder").collect()]
        reader = self.spark.read.schema(snapshot.schema)
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], snapshot.schema)

    def read(self, number: int | None = None) -> DataFrame:
        snapshot = self.snapshot(number)
        if snapshot is None:
            raise ValueError(f"{self.path} has no snapshot yet")
        return self._rows(snapshot, self.manifest(snapshot))

    # --- writing

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _stage(self, rows: DataFrame, keys: Sequence[str], buckets: int, write: str) -> tuple[DataFrame, int]:
        """Rows written by bucket; the new entries of the manifest, and the bytes written. Buckets are dealt to
        tasks, and a crowded one is split over several by the rebalancing of adaptive execution."""
        folder = f"{self.path}/data/{write}"
        rows.withColumn("bucket", self._bucket(keys, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        if not self._names(f"data/{write}") or self._names(f"data/{write}") == ["_SUCCESS"]:
            return self.spark.createDataFrame([], MANIFEST), 0
        found = self.spark.read.parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
        entries = found.select(F.col("bucket").cast("int").alias("bucket"), F.concat(F.lit(f"{write}/bucket="), F.col("bucket").cast("string")).alias("folder"), "rows")
        return entries, self._size(folder)

    def create(self, rows: DataFrame, keys: Sequence[str], expected_bytes: int | None = None) -> Snapshot:
        """The first snapshot. Its number of buckets follows from ``expected_bytes``, or from what the rows take
        when they are written once as they are. Of rows that share a key the greatest stays."""
        if self.snapshot() is not None:
            raise ConcurrentUpsert(f"{self.path} exists")
        rows = upsert_by_key(rows.limit(0), rows, keys)
        if expected_bytes is None:
            trial = f"{self.path}/data/{uuid.uuid4().hex}"
            rows.write.parquet(trial)
            expected_bytes, rows = self._size(trial), self.spark.read.schema(rows.schema).parquet(trial)
        return self._commit(None, rows, tuple(keys), self._count(expected_bytes))

    def _count(self, size: int) -> int:
        return 1 << max(0, (-(-size // self.bucket_bytes) - 1).bit_length())

    def _commit(self, before: Snapshot | None, rows: DataFrame, keys: tuple[str, ...], buckets: int, kept: DataFrame | None = None, kept_bytes: int = 0) -> Snapshot:
        write = f"{0 if before is None else before.number + 1:012d}-{uuid.uuid4().hex}"
        entries, size = self._stage(rows, keys, buckets, write)
        (entries if kept is None else kept.unionByName(entries)).coalesce(1).write.parquet(f"{self.path}/manifests/{write}")
        after = Snapshot(0 if before is None else before.number + 1, write, buckets, keys, rows.schema.toDDL(), kept_bytes + size)
        self._publish(after)
        return after

    def upsert(self, new: DataFrame, order: Sequence[str] = ()) -> Snapshot:
        """The last write wins by key (see ``upsert_by_key``); columns that only one side has are NULL on the
        other. Rewrites the touched buckets, or all of them where buckets have grown to SPLIT_AT times their
        size: their number is doubled then until they are back."""
        before = self.snapshot()
        if before is None:
            raise ValueError(f"{self.path} has no snapshot yet")
        live, keys = self.manifest(before), list(before.keys)
        if before.bytes > SPLIT_AT * self.bucket_bytes * before.buckets:
            return self._commit(before, upsert_by_key(self._rows(before, live), new, keys, order), before.keys, self._count(before.bytes))
        touched = [r.bucket for r in new.select(self._bucket(keys, before.buckets).alias("bucket")).distinct().collect()]
        hit = F.col("bucket").isin(touched) if touched else F.lit(False)
        old, kept = live.where(hit), live.where(~hit)
        replaced = sum(self._size(f"{self.path}/data/{r.folder}") for r in old.select("folder").collect())
        merged = upsert_by_key(self._rows(before, old), new, keys, order)
        return self._commit(before, merged, before.keys, before.buckets, kept, before.bytes - replaced)

    def expire(self, keep: int = 2) -> list[str]:
        """Remove what none of the newest ``keep`` snapshots names, files of interrupted writes included; the
        removed folders. Only while no writer is at work."""
        names = sorted(n for n in self._names("log") if n.isdigit())
        stay = [self.snapshot(int(n)) for n in names[-keep:]]
        folders = {r.folder for s in stay for r in self.manifest(s).select("folder").collect()}
        gone = [f"manifests/{m}" for m in self._names("manifests") if m not in {s.write for s in stay}] + [f"log/{n}" for n in names[:-keep]]
        for write in self._names("data"):
            inside = [f"{write}/{b}" for b in self._names(f"data/{write}") if b.startswith("bucket=")]
            gone += [f"data/{x}" for x in inside if x not in folders] if any(x in folders for x in inside) else [f"data/{write}"]
        for name in gone:
            fs, place = self._hadoop(f"{self.path}/{name}")
            fs.delete(place, True)
        return gone
