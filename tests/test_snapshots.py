"""Tables replaced while they are read; backups, expiry, two writers, writers that fail."""

import os
import threading

import pytest
from probitas.sources import snapshots, writers
from pyspark.sql import functions as F


def rows(spark, n):
    """A version: 100 rows in four files that all name it."""
    return spark.range(0, 100, 1, 4).withColumn("version", F.lit(n))


def test_no_version_is_missing_or_mixed(spark, tmp_path):
    path, seen, failed, ended = str(tmp_path / "t"), [], [], threading.Event()
    snapshots.publish(rows(spark, 1), path)

    def reader():
        while not ended.is_set():
            try:
                got = snapshots.read(spark, path).groupBy("version").count().collect()
                seen.append([(r["version"], r["count"]) for r in got])
            except Exception as error:
                failed.append(error)

    def pointer():
        while not ended.is_set():
            try:
                assert snapshots._versions(spark, path)
            except Exception as error:
                failed.append(error)

    threads = [threading.Thread(target=f) for f in (reader, reader, pointer)]
    for t in threads:
        t.start()
    for n in range(2, 52):
        assert snapshots.publish(rows(spark, n), path) == n
    ended.set()
    for t in threads:
        t.join()
    assert not failed and len(seen) > 10
    assert all(len(v) == 1 and v[0][1] == 100 for v in seen)
    assert [v[0][0] for v in seen[:1]] <= [v[0][0] for v in seen[-1:]]


def test_backup_expiry_and_restore(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.expire(spark, path, 0) == 0
    for n in (1, 2, 3, 4):
        table = rows(spark, 1) if n == 1 else snapshots.read(spark, path).withColumn("version", F.col("version") + 1)
        assert snapshots.publish(table, path, expect=n - 1) == n
    assert [r["version"] for r in snapshots.history(spark, path).collect()] == [1, 2, 3, 4]
    rows(spark, 0).write.parquet(f"{path}/lost.unnamed")
    assert snapshots.expire(spark, path) == 0 and os.path.isdir(f"{path}/lost.unnamed")
    assert snapshots.expire(spark, path, -1) == 2
    left = os.listdir(path)
    assert len(left) == 3 and not [x for x in left if x.endswith(".unnamed")]
    assert snapshots.restore(spark, path, 1) == 5
    value = lambda v: {r["version"] for r in snapshots.read(spark, path, v).collect()}
    assert (value(1), value(4), value(5), value(None)) == ({1}, {4}, {1}, {1})
    with pytest.raises(FileNotFoundError, match="version 2"):
        snapshots.read(spark, path, 2)


def test_writers_that_lose(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.publish(rows(spark, 1), path)
    with pytest.raises(snapshots.StaleTable):
        snapshots.publish(rows(spark, 9), path, expect=0)
    with pytest.raises(Exception, match="no such luck"):
        snapshots.publish(rows(spark, 9).withColumn("x", F.raise_error(F.lit("no such luck"))), path)
    assert {r["version"] for r in snapshots.read(spark, path).collect()} == {1}
    assert snapshots.publish(rows(spark, 2).limit(0), path) == 2
    assert snapshots.read(spark, path).count() == 0 and snapshots.read(spark, path).columns == ["id", "version"]


def test_csv_is_never_missing(spark, tmp_path):
    path, failed, ended = tmp_path / "t.csv", [], threading.Event()
    writers.write_csv(spark.range(5), str(path))

    def reader():
        while not ended.is_set():
            try:
                assert path.read_text().startswith("id\n")
            except Exception as error:
                failed.append(error)

    thread = threading.Thread(target=reader)
    thread.start()
    for n in range(10):
        writers.write_csv(spark.range(n), str(path))
    ended.set()
    thread.join()
    assert not failed and spark.read.option("header", True).csv(str(path)).count() == 9
