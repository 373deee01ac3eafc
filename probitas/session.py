"""One place for session settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "probitas", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI SQL, UTC and adaptive execution; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did; clusters get it by --py-files or an
    installation, and a path that does not exist there does no harm."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def small_batches(spark: SparkSession, rows: int = 1000, read: int = 256) -> None:
    """Whole texts go to Python in batches of at most ``rows`` rows and are read from Parquet ``read`` rows at a time: the
    memory of a worker and that of an executor's heap, where a column of a batch is one array, follow them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        if int(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))


def byte_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Rows go to Python in batches of at most so many bytes (one row at least): volumes and pictures are large."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; in a session of one machine
    without that setting, in a temporary folder."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="probitas-")
        context.setCheckpointDir(path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: plans that read it several times make it once."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
