"""The metric suite kept up to date by a stream: the cells of `metrics.cells`, labels too, as keyed state.

Each key (model, task, format and a salt, so that a key of most answers is many tasks' work) keeps in Spark's state store
its cells, the names of the answers that it has counted, by hour, and the latest time that it has seen. A batch writes
the cells that it changed, whole, and the answers that came too late, each under its number: a batch that runs again
starts from the same state and replaces what it wrote. The suite of all data is `metrics.suite` over the latest cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from .. import config as C
from ..functions.text import fold, parse_responses
from ..operators import metrics
from ..operators.grading import grade
from ..session import ship_package

KEYS = ["model", "task", "format"]
SUMS = metrics.SUMS
WHOLE = [c for c in SUMS if not c.startswith("sum_")]
KINDS = ", ".join(f"{c} {'long' if c in WHOLE else 'double'}" for c in SUMS)
OUT = f"kind string, model string, task string, format string, salt int, bin int, t string, p string, {KINDS}, image_id string, prompt_id string, timestamp_utc string"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]
HOUR = 3_600_000
#: Where a text is null: other texts begin with "=".
NONE = ""
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def contributions(graded: DataFrame, salts: int) -> DataFrame:
    """One row an answer: its key, its cell, what it adds to the cell's sums, its name and time."""
    use, open_, abstain = metrics.scored(), F.col("format") == "OE", metrics.should_abstain()
    conf = use & metrics.has_confidence()
    c, y = F.col("conf_frac"), F.col("correct").cast("double")
    wrong = conf & ~F.col("correct")
    one = lambda x: F.coalesce(x, F.lit(False)).cast("long")
    number = lambda where, x: F.when(where, x).otherwise(0.0)
    text = lambda name: F.when(use, F.concat(F.lit("="), fold(F.col(name)))).otherwise(NONE)
    adds: dict[str, Column] = {
        "n": F.lit(1).cast("long"), "n_gradeable": one(F.col("gradeable")), "n_scored": one(use), "n_correct": one(use & F.col("correct")), "n_conf": one(conf), "sum_conf": number(conf, c), "sum_gap2": number(conf, (c - y) * (c - y)),
        "n_wrong_conf": one(wrong), "sum_wrong_conf": number(wrong, c), "n_sure_wrong": one(wrong & (c >= C.HIGH_CONFIDENCE / 100.0)), "n_open": one(open_), "n_hallucinated": one(open_ & F.col("hallucination")),
        "n_should_abstain": one(abstain), "n_abstained": one(abstain & F.col("abstained")),
    }
    salt = F.pmod(F.xxhash64("image_id", "prompt_id"), F.lit(salts)).cast("int")
    at = F.coalesce(F.unix_millis(F.try_to_timestamp("timestamp_utc")), F.lit(-1).cast("long"))
    keys = [F.coalesce(k, F.lit("")).alias(k) for k in KEYS]
    name = F.unhex(F.md5(F.concat_ws("|", "image_id", "prompt_id")))
    return graded.select(*keys, salt.alias("salt"), F.coalesce(F.when(conf, metrics.bin_index(c)), F.lit(-1)).cast("int").alias("bin"), text("gt_label").alias("t"), text("pred_answer").alias("p"), *[x.alias(k) for k, x in adds.items()], name.alias("name"), at.alias("at"), "image_id", "prompt_id", "timestamp_utc")


class Known:
    """Names in sorted runs, each more than twice as long as the next: a name is merged a logarithmic number of times."""

    def __init__(self, names: np.ndarray) -> None:
        self.runs = [np.unique(names)] if len(names) else []

    def has(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), bool)
        for run in self.runs:
            out |= run[np.minimum(np.searchsorted(run, names), len(run) - 1)] == names
        return out

    def add(self, names: np.ndarray) -> None:
        """Names that were not known, each once."""
        self.runs.append(np.sort(names))
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]), kind="stable")]


class CellState(StatefulProcessor):
    """Counts each answer of a key once. An answer is late when its time is more than ``delay`` before the latest that the
    key had seen at the batch's begin; it is put out, not counted. Names are forgotten with their hour, ``delay`` later,
    and all of them when the key has had no answer for ``idle`` (a timer; none: no timers); answers without a time are
    never late, and their names are kept until then."""

    def __init__(self, delay: int, idle: int | None) -> None:
        self.delay, self.idle = delay, idle

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.cells = handle.getMapState("cells", "bin int, t string, p string", KINDS)
        self.seen = handle.getMapState("seen", "hour long", "names binary")
        self.clock = handle.getValueState("clock", "last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.clock.get()[0] if self.clock.exists() else -1
        names = {k[0]: np.frombuffer(v[0], "S16") for k, v in self.seen.iterator()}
        known = Known(np.concatenate([np.empty(0, "S16"), *names.values()]))
        fresh, changed, top = {}, {}, last
        for pdf in rows:
            at = pdf["at"].to_numpy(np.int64)
            late = (at >= 0) & (at < last - self.delay) if last >= 0 else np.zeros(len(at), bool)
            if late.any():
                yield self._late(key, pdf[late])
            own = np.array(list(pdf["name"]), "S16")
            first = np.zeros(len(own), bool)
            first[np.unique(np.where(late, b"", own), return_index=True)[1]] = True
            new = first & ~late & ~known.has(own)
            if not new.any():
                continue
            known.add(own[new])
            hours = np.where(at >= 0, at // HOUR, -1)
            for hour in np.unique(hours[new]).tolist():
                fresh.setdefault(hour, []).append(own[new & (hours == hour)])
            top = max(top, int(at[new].max()))
            added = pdf[new].groupby(["bin", "t", "p"])[SUMS].sum()
            for cell, sums in zip(added.index, added.to_numpy(float), strict=True):
                changed[cell] = changed.get(cell, 0) + sums
        out = []
        for cell, sums in changed.items():
            cell = (int(cell[0]), cell[1], cell[2])
            old = self.cells.getValue(cell) if self.cells.containsKey(cell) else None
            total = np.array(sums if old is None else sums + np.array(old, float))
            values = tuple(int(round(x)) if c in WHOLE else float(x) for c, x in zip(SUMS, total, strict=True))
            self.cells.updateValue(cell, values)
            out.append(("cell", *key, *cell, *values, None, None, None))
        for hour, parts in fresh.items():
            names[hour] = np.concatenate([names.get(hour, np.empty(0, "S16")), *parts])
            self.seen.updateValue((hour,), (names[hour].tobytes(),))
        if top > last:
            self.clock.update((top,))
        for hour in [h for h in names if 0 <= h and (h + 1) * HOUR <= top - self.delay]:
            self.seen.removeKey((hour,))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=OUT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.seen.clear()
        yield pd.DataFrame([("idle", *key, -1, NONE, NONE, *(0 if c in WHOLE else 0.0 for c in SUMS), None, None, None)], columns=OUT_NAMES)

    def close(self) -> None:
        pass

    @staticmethod
    def _late(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["bin", "t", "p", *SUMS, "image_id", "prompt_id", "timestamp_utc"]].copy()
        for c, v in zip(["kind", *KEYS, "salt"], ["late", *key], strict=True):
            out[c] = v
        return out[OUT_NAMES]


def start(stream: DataFrame, manifest: DataFrame, path: str, checkpoint: str, delay_ms: int = HOUR, idle_ms: int = 24 * HOUR, salts: int = 8, once: bool = True) -> StreamingQuery:
    """Run the stream of responses: ``path`` gets cell/batch=N, late/batch=N and idle/batch=N. ``once``: until all that
    there is has been read, without timers (those of processing time would never let it end)."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only store with maps and timers
    rows = contributions(grade(parse_responses(stream), manifest), salts)
    cells = rows.groupBy(*KEYS, "salt").transformWithStateInPandas(CellState(delay_ms, None if once else idle_ms), OUT, "Append", "None" if once else "ProcessingTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind in ("cell", "late", "idle"):
            part = batch.filter(F.col("kind") == kind).drop("kind")
            part = part.drop("image_id", "prompt_id", "timestamp_utc") if kind == "cell" else part.select(*KEYS, "salt", "image_id", "prompt_id", "timestamp_utc")
            part.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        batch.unpersist()

    writer = cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def latest_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells as the last batches left them, as `metrics.cells` gives them."""
    rows = spark.read.parquet(f"{path}/cell")
    last = rows.groupBy(*KEYS, "salt", "bin", "t", "p").agg(F.max_by(F.struct(*SUMS), "batch").alias("s"))
    label = lambda c: F.when(F.col(c) != NONE, F.substring(c, 2, 1 << 30)).alias(c)
    return last.select(*KEYS, F.when(F.col("bin") >= 0, F.col("bin")).alias("bin"), label("t"), label("p"), "s.*").groupBy(*KEYS, "bin", "t", "p").agg(*[F.sum(c).alias(c) for c in SUMS])


def late_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late")


def forget_commit(spark: SparkSession, checkpoint: str) -> int:
    """Undo the last batch's commit, as a crash between its writes and the commit does: the next start runs it again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in store.listStatus(folder) if f.getPath().getName().isdigit()]
    for name in (str(max(numbers)), f".{max(numbers)}.crc"):
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name), False)
    return max(numbers)
