"""The bucketed table: last write wins, one changed row rewrites one bucket, interrupted and concurrent writes."""

import random

import pytest

from pitspark.sources import snapshots
from pitspark.sources.snapshots import BucketTable, ConcurrentUpsert

SCHEMA = "k long, s string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def contents(df):
    return sorted((tuple(r) for r in df.select("k", "s", "v").collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), bucket_bytes=1 << 20)
    t.create(frame(spark, [(i, None if i % 5 == 0 else "a", i) for i in range(200)]), ["k", "s"], expected_bytes=8 << 20)
    return t


def folders(t):
    return {r.bucket: r.folder for r in t.manifest(t.snapshot()).collect()}


def test_one_changed_row_rewrites_one_bucket(spark, table):
    before = folders(table)
    assert table.snapshot().buckets == 8 and len(before) == 8
    table.upsert(frame(spark, [(7, "a", -1)]))
    after = folders(table)
    assert sum(before[b] != after[b] for b in before) == 1
    want = [(i, None if i % 5 == 0 else "a", -1 if i == 7 else i) for i in range(200)]
    assert contents(table.read()) == sorted(want, key=str)
    assert contents(table.read(0)) == sorted([(i, None if i % 5 == 0 else "a", i) for i in range(200)], key=str)
    assert sum(r.rows for r in table.manifest(table.snapshot()).collect()) == 200


def test_upserts_match_a_dictionary(spark, table):
    rng = random.Random(1)
    want = {(i, None if i % 5 == 0 else "a"): i for i in range(200)}
    for step in range(4):
        new = [(rng.choice([*range(150, 260), None]), rng.choice(["a", "b", None]), 1000 * step + j) for j in range(30)]
        table.upsert(frame(spark, new), order=["v"])
        for k, s, v in new:
            want[k, s] = v  # v rises along a batch, so the last is the greatest
        assert contents(table.read()) == sorted(((k, s, v) for (k, s), v in want.items()), key=str)
    table.upsert(frame(spark, []))
    assert len(contents(table.read())) == len(want) and table.snapshot().number == 5


def test_interrupted_write_leaves_the_old_snapshot(spark, table, monkeypatch):
    old = contents(table.read())
    monkeypatch.setattr(BucketTable, "_publish", lambda self, snapshot: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.upsert(frame(spark, [(1, "a", -5), (900, "x", 1)]))
    monkeypatch.undo()
    assert table.snapshot().number == 0 and contents(table.read()) == old
    table.upsert(frame(spark, [(1, "a", -5)]))
    assert (1, "a", -5) in contents(table.read()) and (900, "x", 1) not in contents(table.read())
    removed = table.expire(1)
    assert removed and contents(table.read()) == sorted([r for r in old if r[:2] != (1, "a")] + [(1, "a", -5)], key=str)
    assert table.expire(1) == []


def test_second_writer_is_refused(spark, table, monkeypatch):
    stale = table.snapshot()
    table.upsert(frame(spark, [(1, "a", -1)]))
    first = contents(table.read())
    other = BucketTable(spark, table.path, 1 << 20)
    real = BucketTable.snapshot
    monkeypatch.setattr(BucketTable, "snapshot", lambda self, number=None: stale if self is other else real(self, number))
    with pytest.raises(ConcurrentUpsert):
        other.upsert(frame(spark, [(1, "a", -2)]))
    monkeypatch.undo()
    assert contents(table.read()) == first
    with pytest.raises(ConcurrentUpsert):
        table.create(frame(spark, []), ["k"])


def test_buckets_split_when_they_have_grown(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), bucket_bytes=4_000)
    t.create(frame(spark, [(i, "a", i) for i in range(10)]), ["k"])
    assert t.snapshot().buckets == 1
    rng = random.Random(3)
    t.upsert(frame(spark, [(i, str(rng.random()) * 3, rng.getrandbits(60)) for i in range(2_000)]))
    assert t.snapshot().bytes > 16_000
    t.upsert(frame(spark, [(5, "z", 5)]))
    assert t.snapshot().buckets > 4
    rows = contents(t.read())
    assert len(rows) == 2_000 and (5, "z", 5) in rows


def test_hot_key_column_and_empty_table(spark, tmp_path):
    """A third of the rows share one part of the key: the bucket is a hash of the whole key."""
    t = BucketTable(spark, str(tmp_path / "t"), bucket_bytes=1 << 20)
    t.create(frame(spark, [(1 if i % 3 == 0 else i, f"s{i}", i) for i in range(3_000)]), ["k", "s"], expected_bytes=8 << 20)
    sizes = [r.rows for r in t.manifest(t.snapshot()).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3_000 / 8
    e = BucketTable(spark, str(tmp_path / "e"))
    e.create(frame(spark, []), ["k"])
    assert e.read().count() == 0
    e.upsert(frame(spark, [(1, "a", 1)]))
    assert contents(e.read()) == [(1, "a", 1)] and snapshots.BUCKET_BYTES > 1 << 20
