"""Responses as a stream: parse and grade each file once, drop repeats, keep additive cells of the metrics.

Every point metric is a function of sums (counts, confidences, squared gaps, bins), so a batch adds its cells and
the metrics of all data come from summing cells. Intervals are for batch runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import parse_responses
from ..operators import metrics
from ..operators.grading import grade
from ..schemas import RESPONSES

KEYS = ["model", "task", "format"]
SUMS = ["n", "n_gradeable", "n_scored", "n_correct", "n_conf", "sum_conf", "sum_gap2", "n_open", "n_hallucinated", "n_should_abstain", "n_abstained"]


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_seen(stream: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """One response per (model, image_id, prompt_id). With ``delay`` the state forgets keys whose time is that
    far behind, and responses later than that are dropped (Spark counts them: numRowsDroppedByWatermark); without, it
    keeps all. Responses whose ``timestamp_utc`` is null or no time have no place in time: they are told apart by a state
    of their own that keeps all, so none is dropped as late; a key with and without a time counts as two."""
    keys = ["model", "image_id", "prompt_id"]
    if delay is None:
        return stream.dropDuplicates(keys)
    at = F.try_to_timestamp("timestamp_utc")
    timed = stream.filter(at.isNotNull()).withColumn("_at", at).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_at").unionByName(stream.filter(at.isNull()).dropDuplicates(keys))


def cells(graded: DataFrame) -> DataFrame:
    """Additive sums by model, task, format and confidence bin (-1 without one)."""
    use, open_, abstain = metrics.scored(), F.col("format") == "OE", metrics.should_abstain()
    conf = use & metrics.has_confidence()
    gap = F.col("conf_frac") - F.col("correct").cast("double")
    n = metrics.count_where
    return graded.groupBy(*KEYS, F.coalesce(F.when(conf, metrics.bin_index(F.col("conf_frac"))), F.lit(-1)).alias("bin")).agg(
        F.count("*").alias("n"), n(F.col("gradeable")).alias("n_gradeable"), n(use).alias("n_scored"), n(use & F.col("correct")).alias("n_correct"), n(conf).alias("n_conf"),
        F.sum(F.when(conf, F.col("conf_frac")).otherwise(0.0)).alias("sum_conf"), F.sum(F.when(conf, gap * gap).otherwise(0.0)).alias("sum_gap2"),
        n(open_).alias("n_open"), n(open_ & F.col("hallucination")).alias("n_hallucinated"), n(abstain).alias("n_should_abstain"), n(abstain & F.col("abstained")).alias("n_abstained"),
    )


def metrics_of(cells_: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, coverage, ece, brier, hallucination and abstention from cells of any number of batches."""
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    merged = cells_.groupBy(*KEYS, "bin").agg(*[F.sum(c).alias(c) for c in SUMS])
    bins = merged.filter("bin >= 0").groupBy(*keys, "bin").agg(F.sum("n_conf").alias("n"), F.sum("sum_conf").alias("c"), F.sum(F.when(F.col("bin") >= 0, F.col("n_correct"))).alias("y"))
    ece = bins.groupBy(*keys).agg((F.sum(F.abs(F.col("y") - F.col("c"))) / F.sum("n")).alias("ece"))
    out = merged.groupBy(*keys).agg(
        share("n_correct", "n_scored").alias("accuracy"), F.sum("n_scored").alias("n"), share("n_scored", "n_gradeable").alias("coverage"), share("sum_gap2", "n_conf").alias("brier"),
        share("n_hallucinated", "n_open").alias("hallucination_rate"), share("n_abstained", "n_should_abstain").alias("abstention_appropriateness"),
    )
    return out.join(ece, keys, "left")


def start(stream: DataFrame, manifest: DataFrame, cells_path: str, checkpoint: str, graded_path: str | None = None, delay: str | None = "1 hour", once: bool = True) -> StreamingQuery:
    """Run the ingest: each batch writes its cells under its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        graded = grade(parse_responses(batch), manifest)
        if graded_path:
            graded.write.mode("overwrite").parquet(f"{graded_path}/batch={number}")
        cells(graded).write.mode("overwrite").parquet(f"{cells_path}/batch={number}")

    writer = first_seen(stream, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
