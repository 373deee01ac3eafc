"""Observed counts against counted ones, in batches, streams and the run loop; sinks that fail; jobs that fail."""

import json
import time

import pytest
from probitas.sources import readers, runlog, runners
from pyspark.sql import functions as F


@pytest.mark.parametrize(("done", "total", "seconds", "want"), [(50, 200, 10.0, (5.0, 30.0)), (0, 10, 2.0, (0.0, None)), (10, 10, 2.0, (5.0, 0.0)), (12, 10, 2.0, (6.0, 0.0)), (3, None, 1.0, (3.0, None)), (5, 9, 0.0, (None, None))])
def test_pace(done, total, seconds, want):
    assert tuple(runlog.pace(done, total, seconds).values()) == want


def test_batch(spark, tmp_path):
    kept = []

    def fails(record):
        raise OSError("full")

    log = runlog.RunLog(fails, kept.append)
    df = spark.range(0, 1000, 1, 7).withColumn("odd", F.col("id") % 2 == 1)
    got = log.run("ids", df, lambda d: d.filter("id < 10").count(), total=4000, odd=F.count_if("odd"), top=F.max("id"))
    assert got == 10 and kept == log.records and len(log.failures) == 1
    (r,) = kept
    assert (r["rows"], r["status"], json.loads(r["metrics"])) == (1000, "ok", {"odd": 500, "top": 999})
    assert r["remaining_seconds"] == pytest.approx(3 * r["seconds"]) and r["rate"] == pytest.approx(1000 / r["seconds"])
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        log.run("bad", df, lambda d: d.select(F.sum(F.lit(1) / (F.col("id") - 5))).collect())
    assert log.records[-1]["status"] == "failed" and "DIVIDE_BY_ZERO" in log.records[-1]["error"]
    assert log.table(spark).select("name", "status").collect() == [("ids", "ok"), ("bad", "failed")]
    runlog.RunLog(runlog.table_sink(spark, str(tmp_path / "log"))).add("x", "batch", rows=3, seconds=1.5)
    assert spark.read.schema(runlog.RECORDS).json(str(tmp_path / "log")).select("name", "rows", "rate").collect() == [("x", 3, 2.0)]


def test_actions_without_counts(spark, monkeypatch):
    monkeypatch.setattr(runlog, "PATIENCE", 0.5)
    log = runlog.RunLog()
    assert log.run("none", spark.range(3), lambda d: 7) == 7
    assert log.records[0]["rows"] is None and log.records[0]["rate"] is None and isinstance(log.failures[0], TimeoutError)
    assert log.run("odd", spark.range(3), lambda d: d.count(), rows=F.count("id")) == 3  # a count of that name is taken
    assert len(log.records) == 2 and len(log.failures) >= 1


def test_tasks_are_watched(spark):
    log = runlog.RunLog()
    slow = spark.range(0, 40, 1, 40).mapInPandas(lambda batches: (time.sleep(0.1) or b for b in batches), "id long")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "mine")
    log.run("slow", slow, lambda d: d.write.format("noop").mode("overwrite").save(), every=0.2)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = [r for r in log.records if r["kind"] == "tasks"]
    assert seen and all(r["status"] == "running" and r["rows"] <= json.loads(r["metrics"])["tasks"] for r in seen)
    assert log.records[-1]["rows"] == 40 and not log.failures


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    log = runlog.RunLog()
    with log.streams(spark):
        stream = runlog.observed(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), "ids", even=F.count_if(F.col("id") % 2 == 0))
        stream.writeStream.queryName("numbers").format("parquet").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out")).awaitTermination()
        bad = spark.readStream.schema("id long").json(str(tmp_path / "in")).select(F.raise_error(F.lit("stop here")).cast("string").alias("id"))
        with pytest.raises(Exception, match="stop here"):
            bad.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start().awaitTermination()
    done = [r for r in log.records if r["name"] == "numbers" and r["rows"]]
    assert [r["batch"] for r in done] == [0, 1, 2] and sum(r["rows"] for r in done) == 30
    assert sum(json.loads(r["metrics"])["ids"]["even"] for r in done) == 15
    assert [r["status"] for r in log.records if r["error"]] == ["failed"]


def test_run_loop(spark, tmp_path):
    prompts = spark.createDataFrame([(f"p{i}", f"i{i}", f"q{i}", "/x.png") for i in range(6)], "prompt_id string, image_id string, prompt_text string, image_path string")
    log, models = runlog.RunLog(), [{"id": "m", "backend": "echo"}, {"id": "n", "backend": "echo"}]
    assert [s for _, s, _ in runners.run_models(prompts, models, str(tmp_path), log=log)] == ["ok", "ok"]
    assert [(r["name"], r["rows"], json.loads(r["metrics"])["errors"], r["remaining_seconds"]) for r in log.records] == [("m", 6, 0, 0.0), ("n", 6, 0, 0.0)]
    assert readers.read_all_responses(spark, str(tmp_path)).count() == 12
