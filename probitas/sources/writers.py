"""Writers: append, whole-table replacement, one-file CSV, and the standard set of result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    """Append as JSON lines; a task's file becomes visible when its job commits."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def flat(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for CSV."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One CSV file with a header, also when there are no rows: written beside and moved over the old one in a single
    rename, so readers see the old file or the new one. For result tables of a size that one task can write."""
    df = flat(df.select(*columns) if columns else df)
    spark = df.sparkSession
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(staging)
    jvm, at, fs = _fs(spark, path)
    parts = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staging}/part-*"))]
    if parts:
        new = parts[0]
    else:
        new = jvm.org.apache.hadoop.fs.Path(f"{staging}/header")
        out = fs.create(new)
        out.write(bytearray((",".join(df.columns) + "\n").encode()))
        out.close()
    if fs.exists(at) and fs.getFileStatus(at).isDirectory():  # what another writer left there is no file to rename over
        fs.delete(at, True)
    rename_over(spark, new, at)
    fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(jvm, path, store) for files that are read while they are replaced: local ones without their checksums, which lie in
    a second file and so can not change in the same step."""
    jvm, at, fs = _fs(spark, path)
    return jvm, at, fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs


def rename_over(spark: SparkSession, source, target) -> None:  # noqa: ANN001
    """Move ``source`` to ``target``, over an old file in the same step where the store can."""
    jvm, _, fs = file_system(spark, target.toString())
    if fs.getUri().getScheme() == "file":  # FileContext would delete the old file first
        hidden = lambda p: jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.crc")
        for p in (source, target):
            fs.delete(hidden(p), False)
        if not fs.rename(source, target):
            raise OSError(f"{source.toString()} could not be moved to {target.toString()}")
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileContext
    context = files.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else files.getFileContext(conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(source, target, options)


def replace_table(df: DataFrame, path: str, keep_backup: bool = True) -> None:
    """Replace a Parquet table that ``df`` may itself read: the new version is complete before the old one moves aside,
    to ``path.bak`` (only the first time, so the backup is the original) or to a name that is deleted at last.

    A folder cannot be renamed over another: between two renames there is no table at ``path``. A failure there puts
    the old one back; after a crash there, the old one is at the name it moved to and the new one at
    ``path.staging-*``, both whole. `snapshots.publish` has no such gap."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    staging, old = f"{path}.staging-{name}", f"{path}.old-{name}"
    df.write.parquet(staging)
    jvm, at, fs = _fs(spark, path)
    file = jvm.org.apache.hadoop.fs.Path
    aside = None
    if fs.exists(at):
        aside = file(f"{path}.bak") if keep_backup and not fs.exists(file(f"{path}.bak")) else file(old)
        if not fs.rename(at, aside):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(file(staging), at):
        if aside is not None:
            fs.rename(aside, at)
        raise OSError(f"{staging} could not be moved to {path}")
    fs.delete(file(old), True)
    spark.catalog.refreshByPath(path)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Each result table under its name."""
    for name, df in tables.items():
        if kind == "csv":
            write_csv(df, f"{folder}/{name}.csv")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def pgm(pixels: list[int], rows: int, columns: int, note: str = "") -> bytes:
    """A grey picture with a note in its header, as binary PGM."""
    head = "P5\n" + "".join(f"# {line}\n" for line in note.splitlines()) + f"{columns} {rows}\n255\n"
    return head.encode() + bytes(pixels)


def write_pictures(df: DataFrame, folder: str, side: int) -> None:
    """(image_id, pixels, note) as Parquet of (image_id, content): pictures with their provenance inside."""
    note = F.coalesce("note", F.lit(""))
    head = F.concat(F.lit("P5\n# "), note, F.lit(f"\n{side} {side}\n255\n"))
    hexed = F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), "")
    df.select("image_id", F.concat(head.cast("binary"), F.unhex(hexed)).alias("content")).write.mode("overwrite").parquet(folder)
