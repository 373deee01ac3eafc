"""Multinomial bootstrap draws: exact quantiles, totals, distribution, blocks, and the intervals made from them."""

from fractions import Fraction
from math import comb

import numpy as np
import pytest
from probitas.operators import bootstrap, metrics
from probitas.plans import queries, reports
from pyspark.sql import functions as F


def exact_quantile(n, p, u):
    total, p, u = Fraction(0), Fraction(p), Fraction(u)
    for k in range(n + 1):
        total += comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= u:
            return k
    return n


@pytest.mark.parametrize("p", [0.001, 0.07, 0.5, 0.93, 0.9999])
def test_binomial_quantile(p):
    rng = np.random.default_rng(1)
    n, u = rng.integers(0, 130, 200), np.concatenate([rng.random(190), [1e-12, 1e-6, 1 - 1e-9, 1 - 1e-13, 0.4999, 0.5001, 0.2501, 0.7501, 0.999, 0.001]])
    assert bootstrap.binomial_quantile(n, p, u).tolist() == [exact_quantile(int(m), p, float(x)) for m, x in zip(n, u, strict=True)]


def test_binomial_quantile_of_many(monkeypatch):
    """Mean, deviation and order at sizes that tables do not reach; chunks give the same."""
    n, u = np.full(4001, 3_000_000_000), (np.arange(4001) + 0.5) / 4001
    k = bootstrap.binomial_quantile(n[:400], 0.3, u[::10][:400])
    assert (np.diff(k) >= 0).all() and abs((k.mean() - 0.9e9) / np.sqrt(0.63e9)) < 0.01 and abs(k.std() / np.sqrt(0.63e9) - 1) < 0.02
    n, u = np.arange(300), np.linspace(0.01, 0.99, 300)
    whole = bootstrap.binomial_quantile(n, 0.4, u)
    monkeypatch.setattr(bootstrap, "HELD", 200)
    assert (bootstrap.binomial_quantile(n, 0.4, u) == whole).all()


def test_log_factorial():
    import math

    x = np.array([0, 1, 5, 1022, 1023, 1024, 1025, 10**6, 10**9])
    assert np.allclose(bootstrap.log_factorial(x), [math.lgamma(i + 1) for i in x.tolist()], rtol=1e-14, atol=1e-13)


def test_draws_are_multinomial():
    m = np.array([5, 1, 30, 14])
    out = bootstrap.split_draws(m, np.full(6000, 50), 7, "g|", "0")
    assert (out.sum(axis=0) == 50).all()
    p = m / 50
    assert np.allclose(out.mean(axis=1), 50 * p, atol=4 * np.sqrt(50 * p * (1 - p) / 6000).max())
    want = 50 * (np.diag(p) - np.outer(p, p))
    assert np.allclose(np.cov(out), want, atol=0.6)
    assert (bootstrap.split_draws(m, np.full(6000, 50), 8, "g|", "0") != out).any()


@pytest.mark.parametrize("block", [2, 1024])
def test_draw_splits_between_blocks_then_cells(spark, monkeypatch, block):
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    rows = [(g, None if i == 0 else i, 1 + i % 4) for g in ("a", "b", None) for i in range(9 if g != "b" else 1)]
    cells = spark.createDataFrame(rows, "g string, v int, m long")
    one, two = (sorted((tuple(r) for r in bootstrap.draw(cells.repartition(n), ["g"], ["v"], 200).collect()), key=repr) for n in (1, 5))
    assert one == two
    totals, by_cell = {}, {}
    for g, v, _, rep, w in one:
        totals[g, rep] = totals.get((g, rep), 0) + w
        by_cell[g, v] = by_cell.get((g, v), 0) + w
    size = {g: sum(r[2] for r in rows if r[0] == g) for g in ("a", "b", None)}
    assert totals == {(g, rep): size[g] for g in size for rep in range(200)}
    for g, v, m in rows:
        assert abs(by_cell[g, v] / 200 - m) < 5 * np.sqrt(m / 200)


def test_mean_interval(spark):
    df = spark.createDataFrame([("g", float(i % 3 == 0), f"s{i % 11}") for i in range(300)] + [("g", None, "s1"), ("h", 1.0, None)], "g string, x double, s string")
    a, b = ({r["g"]: r for r in bootstrap.mean_interval(df.repartition(n), ["g"], F.col("x"), 400).collect()} for n in (2, 7))
    assert a == b and a["h"]["ci_lo"] == a["h"]["ci_hi"] == 1 and a["g"]["n"] == 300
    a = a["g"]
    assert a["ci_lo"] < a["mean"] < a["ci_hi"] and a["ci_hi"] - a["ci_lo"] == pytest.approx(3.92 * np.sqrt(a["mean"] * (1 - a["mean"]) / 300), rel=0.15)
    c = bootstrap.mean_interval(df, ["g"], F.col("x"), 400, cluster=F.col("s")).collect()
    assert len(c) == 1 and c[0]["ci_lo"] <= c[0]["mean"] <= c[0]["ci_hi"] and c[0]["n"] == 300


def test_clusters_are_drawn_whole(spark):
    """Two clusters of unequal size: a replicate's mean is one of three values."""
    df = spark.createDataFrame([("g", 1.0, "a")] * 30 + [("g", 0.0, "b")] * 10, "g string, x double, s string")
    cells = df.groupBy("g", "s").agg(F.sum("x").alias("sum"), F.count("*").alias("n")).groupBy("g", "sum", "n").agg(F.count("*").alias("m"))
    stats = bootstrap.draw(cells, ["g"], ["sum", "n"], 400).groupBy("_rep").agg((F.sum(F.col("_w") * F.col("sum")) / F.sum(F.col("_w") * F.col("n"))).alias("x")).groupBy("x").count().collect()
    assert {r["x"] for r in stats} == {0.0, 0.75, 1.0} and all(abs(r["count"] / 400 - (0.5 if r["x"] == 0.75 else 0.25)) < 0.09 for r in stats)


def test_intervals_cover(spark):
    """Of 150 samples of a known rate, some 95 % of the intervals hold it."""
    rng = np.random.default_rng(9)
    rows = [(f"g{g:03d}", float(i < k)) for g in range(150) for k in [rng.binomial(400, 0.3)] for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double")
    ends = bootstrap.mean_interval(df, ["g"], F.col("x"), 300).collect()
    assert 0.9 <= np.mean([r["ci_lo"] <= 0.3 <= r["ci_hi"] for r in ends]) <= 0.99


GRADED = "model string, gt_label string, pred_answer string, correct boolean, answered boolean, gradeable boolean, conf_frac double, format string, hallucination boolean, is_negative_control boolean, task string, abstained boolean"


def test_suite_intervals_are_those_of_rows_drawn(spark):
    """Each metric's interval against the same metric over rows repeated as often as their cell was drawn."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(160):
        t, p = rng.choice(["a", "B", "c"]), rng.choice(["a", "b", "c", "d"])
        conf = None if rng.random() < 0.2 else float(rng.integers(0, 11)) / 10
        rows.append(("m", str(t), str(p), str(t).lower() == p, bool(rng.random() < 0.9), bool(rng.random() < 0.9), conf, str(rng.choice(["MC", "OE"])), bool(rng.random() < 0.3), bool(rng.random() < 0.2), "T1-MOD", bool(rng.random() < 0.5)))
    df = spark.createDataFrame(rows, GRADED)
    got = bootstrap.suite_intervals(df, ["model"], 60).first().asDict()
    drawn = bootstrap.draw(bootstrap.populations(df, ["model"]), ["model", "pop"], ["t", "p", "c", "y"], 60).collect()
    stats = {}
    for rep in range(60):
        pick = lambda pop: [r for r in drawn if r["_rep"] == rep and r["pop"] == pop for _ in range(r["_w"])]  # noqa: E731, B023
        s, c = pick("scored"), pick("confidence")
        classes = sorted({r["t"] for r in s} | {r["p"] for r in s})
        true = [k for k in classes if any(r["t"] == k for r in s)]
        tp = {k: sum(r["t"] == r["p"] == k for r in s) for k in classes}
        values = {
            "accuracy": np.mean([r["y"] for r in s]), "balanced_acc": np.mean([tp[k] / sum(r["t"] == k for r in s) for k in true]),
            "macro_f1": np.mean([2 * tp[k] / (sum(r["t"] == k for r in s) + sum(r["p"] == k for r in s)) for k in classes]), "brier": np.mean([(r["c"] - r["y"]) ** 2 for r in c]),
            "hallucination": np.mean([r["y"] for r in pick("open")]), "abstention": np.mean([r["y"] for r in pick("abstain")]),
        }
        edges = np.linspace(0, 1, 11)
        at = np.minimum(np.searchsorted(edges, [r["c"] for r in c], side="right") - 1, 9)
        values["ece"] = sum(abs(sum(r["y"] - r["c"] for r, b in zip(c, at, strict=True) if b == i)) for i in range(10)) / len(c)
        for k, v in values.items():
            stats.setdefault(k, []).append(v)
    want = {f"{k}_ci_{end}": np.percentile(v, q) for k, v in stats.items() for end, q in (("lo", 2.5), ("hi", 97.5))}
    assert got.pop("model") == "m" and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_rows_are_scanned_once(spark, tmp_path):
    rows = [("m", "a", "a", True, True, True, 0.5, "OE", False, False, "T1-MOD", False)] * 5
    spark.createDataFrame(rows, GRADED).write.parquet(f"{tmp_path}/g")
    plan = bootstrap.populations(spark.read.parquet(f"{tmp_path}/g"), ["model"])
    plan.collect()
    assert plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet") == 1


def test_intervals_and_figures_read_the_rows_once(spark, sf):
    """Answers are parsed and graded once: by the cells, which are kept, or by the one pass over the bins."""
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id")
    g = queries.graded(spark, sf)
    once = reads(g)
    assert once > 0 and reads(reports.reliability_figure(g)) == once
    assert reads(bootstrap.mean_interval(g.filter(metrics.scored()), ["model"], F.col("correct"), 20)) == 0
    assert reads(bootstrap.suite_intervals(g, ["model"], 20, pops=["open"])) == 0
