"""The stream that keeps the suite's cells as state: repeats, replays, late answers, salts, timers."""

import hashlib
import time

import numpy as np
import pandas as pd
import pytest
from probitas.operators import metrics
from probitas.operators.grading import grade
from probitas.functions.text import parse_responses
from probitas.schemas import MANIFEST, RESPONSES
from probitas.streaming import ingest, live

KEYS = ["model", "task", "format"]


@pytest.fixture(scope="module")
def exam(spark):
    rows = [dict(image_id=f"i{i}", label_modality=("T1", "T2", "")[i % 3], label_plane="axial", is_negative_control=int(i % 7 == 0)) for i in range(20)]
    return spark.createDataFrame([[r.get(c) for c in MANIFEST.names] for r in rows], MANIFEST)


def answers(numbers, when="2026-01-01T10:00:00+00:00", tag=""):
    out = []
    for i in numbers:
        text = ("T1. Confidence: 90", "T2, confidence 40%", "I am not sure.", "FLAIR")[i % 4]
        out.append(dict(model="hot" if i % 3 else "m", image_id=f"i{i % 20}", prompt_id=f"{tag}p{i}", task="T1-MOD" if i % 5 else "T7-ABSTAIN", format="OE" if i % 2 else "MC", response=text, mc_options=[], timestamp_utc=when))
    return out


def land(spark, folder, name, rows):
    spark.createDataFrame([[r.get(c) for c in RESPONSES.names] for r in rows], RESPONSES).coalesce(1).write.json(f"{folder}/{name}")


def cells_of(df):
    names = [*KEYS, "bin", "t", "p", *live.SUMS]
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=repr)


def run(spark, exam, tmp, **options):
    live.start(ingest.read_stream(spark, f"{tmp}/in/*"), exam, f"{tmp}/out", f"{tmp}/ck", **options).awaitTermination(120)


def test_cells_equal_the_batch_suites(spark, exam, tmp_path):
    first, second = answers(range(60)), answers(range(40, 90), "2026-01-01T11:00:00+00:00")
    land(spark, f"{tmp_path}/in", "a", first + first[:7])
    run(spark, exam, tmp_path, salts=3)
    land(spark, f"{tmp_path}/in", "b", second + answers(range(200, 210), None) + answers(range(200, 205), "no time"))
    run(spark, exam, tmp_path, salts=3)
    number = live.forget_commit(spark, f"{tmp_path}/ck")  # the second batch runs again, with a third one
    old = answers(range(0, 90), "2025-01-01T00:00:00+00:00", "old ")
    land(spark, f"{tmp_path}/in", "c", old)
    run(spark, exam, tmp_path, salts=3)
    assert number >= 1
    once = {(r["image_id"], r["prompt_id"]): r for r in [*first, *second, *answers(range(200, 210))]}
    late = {r["prompt_id"] for r in live.late_answers(spark, f"{tmp_path}/out").collect()}
    # a key that had seen nothing before has no late answers
    once |= {(r["image_id"], r["prompt_id"]): r for r in old if r["prompt_id"] not in late}
    want = grade(parse_responses(spark.createDataFrame([[r.get(c) for c in RESPONSES.names] for r in once.values()], RESPONSES)), exam)
    assert len(late) > 60 and cells_of(live.latest_cells(spark, f"{tmp_path}/out")) == cells_of(metrics.cells(want, KEYS))
    assert spark.read.parquet(f"{tmp_path}/out/cell").select("salt").distinct().count() == 3


def test_idle_keys_forget_names(spark, exam, tmp_path):
    """A continuous run: after a while without answers the timer clears the names, so that a repeat counts again."""
    land(spark, f"{tmp_path}/in", "a", answers([1]))
    query = live.start(ingest.read_stream(spark, f"{tmp_path}/in/*"), exam, f"{tmp_path}/out", f"{tmp_path}/ck", idle_ms=1500, salts=1, once=False)
    try:
        end = time.time() + 60
        while time.time() < end and not (list((tmp_path / "out/idle").glob("*/*.parquet")) and spark.read.parquet(f"{tmp_path}/out/idle").count()):
            time.sleep(1)
    finally:
        query.stop()
    assert [tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out/idle").collect()] == [("hot", "T1-MOD", "OE")]
    assert [r["n"] for r in live.latest_cells(spark, f"{tmp_path}/out").collect()] == [1]


class Held(dict):
    """A state variable without Spark."""

    def exists(self):
        return () in self

    def get(self):
        return self[()]

    def update(self, value):
        self[()] = value

    def iterator(self):
        return iter(list(self.items()))

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__  # noqa: N815


def test_names_are_not_sorted_again_for_every_batch(monkeypatch):
    """Batches with repeats within them, of one another and of the last call: each answer counts once, and the names that
    sorts read grow as n log n, not with the number of batches."""
    read = [0]
    for name in ("sort", "unique", "union1d", "isin"):
        old = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *a, old=old, **k: (read.__setitem__(0, read[0] + sum(x.size for x in a if isinstance(x, np.ndarray))), old(*a, **k))[1])
    state = live.CellState(live.HOUR, None)
    state.cells, state.seen, state.clock = Held(), Held(), Held()
    rng, batch, batches = np.random.default_rng(5), 50, 400
    numbers = rng.integers(0, 15000, (2, batches, batch))
    for call in numbers:
        pdfs = [pd.DataFrame({"bin": b % 3, "t": "=a", "p": "=b", **{c: 1 for c in live.SUMS}, "name": [hashlib.md5(b"%d" % i).digest() for i in b], "at": live.HOUR * (1 + b % 2)}) for b in call]
        list(state.handleInputRows(("m", "t", "f", 0), iter(pdfs), None))
    want = np.unique(numbers)
    assert {k[0]: v[0] for k, v in state.cells.items()} == {i: int((want % 3 == i).sum()) for i in range(3)}
    assert sorted(x for v in state.seen.values() for x in np.frombuffer(v[0], "S16").tolist()) == sorted(np.array([hashlib.md5(b"%d" % i).digest() for i in want.tolist()], "S16").tolist())
    assert read[0] < 20 * numbers.size
