"""Tables that are replaced without a gap: whole versions beside each other, and one small file that names the current one.

    snapshots.publish(df, "/tables/exam")        # df may read the table itself
    exam = snapshots.read(spark, "/tables/exam")

A version is complete before the pointer names it, and the pointer changes in one step, so a reader sees the old table or
the new one. The first version stays as the backup; later ones go when newer ones exist and their time has passed.

    <table>/CURRENT              {"versions": [{"version": 1, "folder": "v1-...", "at": ...}, ...]}, the last is current
    <table>/v<number>-<name>/    Parquet

The step is a rename over the old pointer where the store can (local files, HDFS), else one object's replacement. Two
writers at once: the later pointer wins as a whole, unless they name the version they expect.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .writers import file_system, rename_over

POINTER = "CURRENT"
KEEP_SECONDS = 86400.0
HISTORY = T.StructType([T.StructField("version", T.LongType()), T.StructField("folder", T.StringType()), T.StructField("at", T.DoubleType())])


class StaleTable(RuntimeError):
    """The table has moved on since the version that the writer expected."""


def _versions(spark: SparkSession, path: str) -> list[dict]:
    jvm, at, fs = file_system(spark, f"{path}/{POINTER}")
    try:
        stream = fs.open(at)
    except Exception as error:
        if "FileNotFoundException" in str(getattr(error, "java_exception", error)):
            return []
        raise
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))["versions"]
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, versions: list[dict]) -> None:
    jvm, at, fs = file_system(spark, f"{path}/{POINTER}")
    moves = fs.getUri().getScheme() in ("file", "hdfs", "viewfs", "abfs", "abfss")
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/.{POINTER}-{uuid.uuid4().hex}") if moves else at
    out = fs.create(target, True)
    out.write(bytearray(json.dumps({"versions": versions}).encode()))
    out.close()
    if moves:
        rename_over(spark, target, at)


def publish(df: DataFrame, path: str, expect: int | None = None, keep_seconds: float = KEEP_SECONDS) -> int:
    """Make the rows of ``df`` the table's new version and return its number. With ``expect``, the number of the version that
    ``df`` was made from (0: none): `StaleTable` where another one is current by then."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/{folder}.unnamed")
    versions = _versions(spark, path)
    now = versions[-1]["version"] if versions else 0
    jvm, at, fs = file_system(spark, f"{path}/{folder}.unnamed")
    if expect is not None and expect != now:
        fs.delete(at, True)
        raise StaleTable(f"{path} is at version {now}, not {expect}")
    name = f"v{now + 1}-{folder}"
    if not fs.rename(at, jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
        raise OSError(f"{path}/{name} could not be made")
    _point(spark, path, [*versions, {"version": now + 1, "folder": name, "at": time.time()}])
    expire(spark, path, keep_seconds)
    return now + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current version, or the one of a number (1 is the backup). A plan made once goes on reading its version."""
    versions = _versions(spark, path)
    found = [v for v in versions if version is None or v["version"] == version]
    if not found:
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version}".rstrip())
    return spark.read.parquet(f"{path}/{found[-1]['folder']}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, at) of the versions that can be read; ``at`` in seconds since 1970."""
    return spark.createDataFrame([[v["version"], v["folder"], v["at"]] for v in _versions(spark, path)], HISTORY)


def restore(spark: SparkSession, path: str, version: int) -> int:
    """An older version as a new one."""
    return publish(read(spark, path, version), path)


def expire(spark: SparkSession, path: str, keep_seconds: float = KEEP_SECONDS) -> int:
    """Forget the versions that were replaced more than ``keep_seconds`` ago, but the first, and return how many; folders that
    no pointer names and that are as old (of writers that failed) go too. The pointer changes before a file goes."""
    versions, oldest = _versions(spark, path), time.time() - keep_seconds
    live = [v for i, v in enumerate(versions) if i in (0, len(versions) - 1) or versions[i + 1]["at"] > oldest]
    if len(live) < len(versions):
        _point(spark, path, live)
    names = {v["folder"] for v in live}
    dead = {v["folder"] for v in versions} - names
    _, at, fs = file_system(spark, path)
    for status in fs.listStatus(at) if fs.exists(at) else []:
        name = status.getPath().getName()
        lost = name not in names and name != POINTER and (name.endswith(".unnamed") or name[:1] in "v.") and status.getModificationTime() / 1000 < oldest
        if name in dead or lost:
            fs.delete(status.getPath(), True)
    return len(dead)
