"""What the operators share: the cluster's shared folder, staged tables, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let  # noqa: F401
from ..session import ship_package, small_batches

#: The characters between words: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: A table is broadcast only when its files on disk are known to be smaller than this.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (local tests) a temporary folder is made and set.
    """
    context = spark.sparkContext
    ship_package(spark)
    small_batches(spark)
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="probitas-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors.

    ``done`` are staged tables that nothing reads any more once this one is written: their folders are deleted.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path  # type: ignore[attr-defined]
    unstage(*done)
    return out


def set_aside(docs: DataFrame, used: Iterable[str], replaced: Iterable[str] = ()) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with the columns ``used`` and one struct of all others, so that an operator's own columns clash with none;
    and a function that takes the operator's result and the names of its new columns and gives back the columns of
    ``docs`` in their order (without those that it lacks or that are ``replaced``), then the new ones."""
    names = [c for c in docs.columns if c not in set(replaced)]
    used = [c for c in names if c in set(used)]
    rest = [c for c in names if c not in used]
    slim = docs.select(*[F.col(f"`{c}`") for c in used], F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True).alias("_" * (1 + max(map(len, ["", *rest]))))).alias("_rest"))

    def restore(out: DataFrame, *new: str) -> DataFrame:
        back = [F.col(f"`{c}`") if c in used else F.col("_rest").getField(c).alias(c) for c in names if c in rest or c in out.columns]
        return out.select(*back, *new)

    return slim, restore


def unstage(*done: DataFrame) -> None:
    """Delete the folders of staged tables."""
    for df in done:
        drop_folder(df.sparkSession, df.staged_at)


def release() -> None:
    """Give the memory that a Python worker no longer uses back to the system: the worker stays for later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def regrouped(batches: Iterable, size: int = 6 << 20) -> Iterable:
    """Arrow batches put together until they hold ``size`` bytes: fewer, larger ones where rows are short."""
    import pyarrow as pa

    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


#: A key is hot when it has more than this share of all rows: there are fewer such keys than its inverse.
HOT_SHARE = 1000


def join_unique(many: DataFrame, unique: DataFrame, on: str, rows: str) -> DataFrame:
    """Inner join of ``many`` with the staged ``unique``, one row a key, whose column ``rows`` (dropped) tells how many
    rows of ``many`` the key has.

    Keys of more than a 1000th of all rows are at most 1000 and meet by a broadcast, the others by a shuffle: a key
    of a third of all rows is no single task's work. ``many`` is read twice and should be staged.
    """
    total = unique.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) > max(total // HOT_SHARE, HOT_SHARE)
    hot = F.broadcast(unique.filter(is_hot))
    if hot.isEmpty():
        return many.join(unique.drop(rows), on)
    cold = many.join(hot.select(on), on, "left_anti").join(unique.filter(~is_hot).drop(rows), on)
    return cold.unionByName(many.join(hot.drop(rows), on))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, by the file system that holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(staged: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a staged table whose files are under ``limit`` bytes; else the table as it is,
    so that Spark joins it by a shuffle."""
    small = stored_bytes(staged.sparkSession, staged.staged_at) < limit
    return F.broadcast(staged) if small else staged


def buckets(spark: SparkSession, least: int = 64) -> int:
    """How many salts or cells: follows the shuffle partitions, which follow the data."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before this one in ``order``, without a one-task window.

    ``df`` must be staged (it is read twice). Rows are range-partitioned by a global sort and written; each
    file then needs only the total of the files before it.
    """
    sorted_ = stage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    spark = df.sparkSession
    per = sorted_.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = per.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per file of the sort: at most spark.sql.shuffle.partitions rows.
    return (
        sorted_.join(F.broadcast(before.drop("_sum")), "_part")
        .withColumn(name, (F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_part", "_before")
    )
