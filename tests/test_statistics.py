"""Statistics that a user brings: states made apart, merged, finished; hot groups; intervals."""

import sys

import numpy as np
import pandas as pd
import pytest
from probitas.operators import bootstrap, statistics
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Median:
    """Both middle values' mean; the state is a list of values."""

    def init(self):
        return []

    def update(self, state, rows, times):
        return state + [v for v, n in zip(rows["x"].tolist(), times.tolist(), strict=True) for _ in range(n) if v == v]

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        return float(np.median(state)) if state else None


def plain_f(rows, positive, beta):
    tp = sum(t == p == positive for t, p in rows)
    fn, fp = sum(t == positive != p for t, p in rows), sum(p == positive != t for t, p in rows)
    below = (1 + beta**2) * tp + beta**2 * fn + fp
    return (1 + beta**2) * tp / below if below else None


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    groups = ["hot"] * 900 + ["a"] * 40 + ["b"] + [None] * 5
    return [(g, None if i % 97 == 0 else float(rng.integers(0, 50)), str(rng.choice(["y", "n"])), str(rng.choice(["y", "n", "?"]))) for i, g in enumerate(groups)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, t string, p string").repartition(12).cache()


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("groups", [1, 4096])
def test_statistics_of_groups(frame, rows, monkeypatch, groups):
    monkeypatch.setattr(statistics, "GROUPS", groups)
    own = {r["g"]: r["value"] for r in statistics.aggregate(frame, ["g"], ["x"], Median()).collect()}
    assert own == {g: Median().finish([r[1] for r in rs if r[1] is not None]) for g, rs in by_group(rows).items()}
    quarter = {r["g"]: r["value"] for r in statistics.aggregate(frame, ["g"], ["x"], statistics.Quantile("x", 0.25)).collect()}
    assert quarter == {g: float(np.quantile(v, 0.25, method="inverted_cdf")) if (v := [r[1] for r in rs if r[1] is not None]) else None for g, rs in by_group(rows).items()}
    f2 = {r["g"]: r["value"] for r in statistics.aggregate(frame, ["g"], ["t", "p"], statistics.FScore("t", "p", "y", 2.0)).collect()}
    assert f2 == {g: pytest.approx(w) if (w := plain_f([r[2:] for r in rs], "y", 2.0)) is not None else None for g, rs in by_group(rows).items()}


def test_a_hot_group_is_many_tasks_work(spark, frame, monkeypatch):
    """Each task sums up its own rows of the hot group; only states meet."""
    seen = []
    merged = statistics._merged
    monkeypatch.setattr(statistics, "_merged", lambda rows, *a: (seen.append(rows), merged(rows, *a))[1])
    statistics.aggregate(frame, ["g"], ["x"], Median()).collect()
    first, second = (df.groupBy("_g").count().filter(F.col("_g").contains("hot")).first()["count"] for df in seen)
    assert first == 12 and 1 < second <= statistics.PARTS


def test_no_keys_and_no_rows(spark, frame, rows):
    assert statistics.aggregate(frame, [], ["x"], Median()).first()["value"] == Median().finish([r[1] for r in rows if r[1] is not None])
    assert statistics.aggregate(frame.limit(0), ["g"], ["x"], Median()).count() == 0


def test_merging_is_associative():
    s = statistics.Quantile("x", 0.5)
    parts = [s.update(s.init(), pd.DataFrame({"x": x}), np.array(n)) for x, n in (([1.0, 2.0], [3, 0]), ([5.0], [2]), ([2.0, np.nan], [4, 9]))]
    import copy

    a, b, c = (copy.copy(p) for p in parts)
    assert s.merge(s.merge(a, b), c) == s.merge(copy.copy(parts[0]), s.merge(copy.copy(parts[1]), copy.copy(parts[2])))
    assert s.finish(s.merge(s.merge(*map(copy.copy, parts[:2])), copy.copy(parts[2]))) == 2.0


def test_intervals_are_those_of_the_draws(frame):
    one, two = ({r["g"]: tuple(r) for r in statistics.aggregate_interval(frame.repartition(n), ["g"], ["x"], Median(), 80).collect()} for n in (1, 7))
    assert one == two
    cells = frame.groupBy("g", "x").agg(F.count("*").alias("m"))
    drawn = bootstrap.draw(cells, ["g"], ["x"], 80).filter("g = 'hot'").collect()
    values = [np.median([r["x"] for r in drawn if r["_rep"] == rep and r["x"] is not None for _ in range(r["_w"])]) for rep in range(80)]
    _, value, low, high = one["hot"]
    assert (low, high) == tuple(np.percentile(values, [2.5, 97.5])) and low <= value <= high
