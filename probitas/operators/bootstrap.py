"""Bootstrap intervals: exact multinomial draws over cells of equal rows, and NumPy's own for small groups."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import fold
from ..session import ship_package, staged

#: Cells of a group that one task draws at a time.
BLOCK = 1024
#: Probabilities of a binomial that are held at a time.
HELD = 1 << 20
_SMALL = np.array([math.lgamma(i + 1) for i in range(1024)])


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x! of whole numbers: a table, and Stirling's series beyond it."""
    big = np.maximum(x, 1023).astype(float)
    series = big * np.log(big) - big + 0.5 * np.log(2 * np.pi * big) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(x < 1024, _SMALL[np.minimum(x, 1023)], series)


def binomial_quantile(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The smallest k at which the distribution function of Binomial(n, p) is at least u, for each n and u.

    Only the values within nine deviations (and ten) of the mean are summed: what lies beyond has less weight than a
    double can tell. The work for a draw is some 18 deviations, so it grows with the root of n."""
    out = np.zeros(len(n), np.int64)
    if p >= 1:
        return n.astype(np.int64)
    at = np.argsort(n, kind="stable")
    reach = lambda m: 9 * math.sqrt(m * p * (1 - p)) + 10
    while len(at):
        width = int(2 * reach(int(n[at[-1]]))) + 2
        some, at = at[: max(1, HELD // width)], at[max(1, HELD // width) :]
        lo, hi = int(n[some[0]]), int(n[some[-1]])
        k = np.arange(max(0, math.floor(lo * p - reach(lo))), min(hi, math.ceil(hi * p + reach(hi))) + 1)
        m = n[some][:, None]
        inside = k <= m
        rest = np.where(inside, m - k, 0)
        log = log_factorial(m) - log_factorial(k) - log_factorial(rest) + k * math.log(p) + rest * math.log1p(-p)
        total = np.cumsum(np.where(inside, np.exp(log), 0.0), axis=1)
        out[some] = np.minimum(k[0] + (total < u[some][:, None]).sum(axis=1), n[some])
    return out


def uniforms(seed: int, group: str, part: str, first: int, end: int, replicates: int) -> np.ndarray:
    """A number between 0 and 1 for each replicate's split of [first, end): 52 bits of an md5, so that any engine gets
    the same."""
    digests = (hashlib.md5(f"{seed}|{group}|{part}|{first}|{end}|{r}".encode()).hexdigest()[:13] for r in range(replicates))
    return (np.array([int(d, 16) for d in digests], float) + 0.5) / (1 << 52)


def split_draws(weights: np.ndarray, totals: np.ndarray, seed: int, group: str, part: str) -> np.ndarray:
    """Multinomial counts (cells x replicates) of ``totals`` draws each: a range's draws are split binomially between
    its halves, down to single cells."""
    upto = np.concatenate([[0], np.cumsum(weights)])
    out = np.zeros((len(weights), len(totals)), np.int64)
    todo = [(0, len(weights), totals)]
    while todo:
        first, end, n = todo.pop()
        if end - first == 1:
            out[first] = n
            continue
        middle = (first + end) // 2
        p = float(upto[middle] - upto[first]) / float(upto[end] - upto[first])
        left = binomial_quantile(n, p, uniforms(seed, group, part, first, end, len(n)))
        todo += [(first, middle, left), (middle, end, n - left)]
    return out


def draw_counts(cells: DataFrame, keys: list[str], order: list[str], replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = C.BOOTSTRAP_SEED) -> DataFrame:
    """``cells`` (keys, order, m: how many rows are alike) with ``_w``: how often rows of the cell are drawn, by
    replicate. Each replicate draws as many rows of a group as it has, with replacement: exactly, not by Poisson.

    The work is cells x replicates, whatever the number of rows. A group's draws are first split between blocks of
    BLOCK cells, then each block's between its cells, in a task of its own. ``keys`` and ``order`` name a cell; which
    draws it gets depends on them and on the seed alone.
    """
    ship_package(cells.sparkSession)
    group = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(""))
    numbered = cells.withColumn("_g", group).withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy(*order)) - 1).withColumn("_b", F.floor(F.col("_i") / BLOCK))
    blocks = numbered.groupBy("_g", "_b").agg(F.sum("m").alias("m"))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        totals = np.full(replicates, pdf["m"].sum(), np.int64)
        return pd.DataFrame({"_g": pdf["_g"], "_b": pdf["_b"], "_n": list(split_draws(pdf["m"].to_numpy(), totals, seed, pdf["_g"].iloc[0], "blocks"))})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        counts = split_draws(pdf["m"].to_numpy(), np.asarray(pdf["_n"].iloc[0], np.int64), seed, pdf["_g"].iloc[0], str(pdf["_b"].iloc[0]))
        return pd.DataFrame({"_g": pdf["_g"], "_i": pdf["_i"], "_w": list(counts)})

    dealt = numbered.select("_g", "_b", "_i", "m").join(blocks.groupBy("_g").applyInPandas(between, "_g string, _b long, _n array<long>"), ["_g", "_b"])
    # by a number of partitions: a block is little data and much work, so small partitions are not to be put together
    dealt = dealt.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_g", "_b")
    counts = dealt.groupBy("_g", "_b").applyInPandas(within, "_g string, _i int, _w array<long>")
    return numbered.join(counts, ["_g", "_i"]).select(*cells.columns, "_w")


def draw(cells: DataFrame, keys: list[str], order: list[str], replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = C.BOOTSTRAP_SEED) -> DataFrame:
    """`draw_counts` by ``_rep``: the cells that a replicate draws at all, ``_w`` times each."""
    return draw_counts(cells, keys, order, replicates, seed).select(*cells.columns, F.posexplode("_w").alias("_rep", "_w")).filter("_w > 0")


def interval(stats: DataFrame, keys: list[str], stat: str, level: float = C.BOOTSTRAP_LEVEL) -> DataFrame:
    low = (1 - level) / 2
    return stats.groupBy(*keys).agg(F.percentile(stat, F.lit(low)).alias("ci_lo"), F.percentile(stat, F.lit(1 - low)).alias("ci_hi"))


def mean_interval(df: DataFrame, keys: list[str], value: Column, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = C.BOOTSTRAP_SEED, cluster: Column | None = None) -> DataFrame:
    """(keys, mean, n, ci_lo, ci_hi) of the mean of ``value``, nulls left out.

    With ``cluster`` whole clusters are drawn, as many as there are: clusters of equal sum and size are one cell."""
    rows = df.select(*keys, value.cast("double").alias("_s"), *([] if cluster is None else [cluster.alias("_key")])).filter(F.col("_s").isNotNull())
    if cluster is not None:
        rows = rows.filter(F.col("_key").isNotNull()).groupBy(*keys, "_key").agg(F.sum("_s").alias("_s"), F.count("*").alias("_n"))
    else:
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    cells = staged(rows.groupBy(*keys, "_s", "_n").agg(F.count("*").alias("m")), "cells")  # draws and means read it, the rows are read once
    drawn = draw(cells, keys, ["_s", "_n"], replicates, seed)
    stats = drawn.groupBy(*keys, "_rep").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("_stat"))
    point = cells.groupBy(*keys).agg((F.sum(F.col("_s") * F.col("m")) / F.sum(F.col("_n") * F.col("m"))).alias("mean"), F.sum(F.col("_n") * F.col("m")).alias("n"))
    return point.join(interval(stats, keys, "_stat"), keys)


def populations(graded: DataFrame, keys: list[str], pops: list[str] | None = None) -> DataFrame:
    """Cells (keys, pop, t, p, c, y, m) of the rows that metrics are means over: scored ones by labels and correctness,
    those with a confidence by it and correctness, open ones by hallucination, those to abstain on by abstention; all or
    only ``pops``. One pass over the rows."""
    from .metrics import has_confidence, keyed, scored, should_abstain

    def cell(pop: str, where: Column, t: Column | None = None, p: Column | None = None, c: Column | None = None, y: Column | None = None) -> Column:
        text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
        return F.when(where, F.struct(F.lit(pop).alias("pop"), (text if t is None else t).alias("t"), (text if p is None else p).alias("p"), (number if c is None else c.cast("double")).alias("c"), y.cast("double").alias("y")))

    correct = F.col("correct")
    of = {
        "scored": (scored(), fold(F.col("gt_label")), fold(F.col("pred_answer")), None, correct), "confidence": (scored() & has_confidence(), None, None, F.col("conf_frac"), correct),
        "open": (F.col("format") == "OE", None, None, None, F.col("hallucination")), "abstain": (should_abstain(), None, None, None, F.col("abstained")),
    }
    each = F.array_compact(F.array(*[cell(pop, *x) for pop, x in of.items() if pops is None or pop in pops]))
    cells = keyed(graded, keys).select(*keys, F.explode(each).alias("_c")).select(*keys, "_c.*").filter("y is not null")
    return cells.groupBy(*keys, "pop", "t", "p", "c", "y").agg(F.count("*").alias("m"))


def suite_intervals(graded: DataFrame, keys: list[str], replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = C.BOOTSTRAP_SEED, pops: list[str] | None = None) -> DataFrame:
    """(keys, NAME_ci_lo, NAME_ci_hi) of accuracy, balanced_acc, macro_f1, ece, brier, hallucination and abstention: one
    pass over the rows, one draw for all metrics of a population, one chain of aggregates."""
    from .metrics import bin_index

    cells = staged(populations(graded, keys, pops), "cells")  # draws read it several times, the rows are read once
    drawn = draw(cells, [*keys, "pop"], ["t", "p", "c", "y"], replicates, seed)
    whole = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")))
    none = F.filter(whole, lambda x: F.lit(False))
    bins = F.when(F.col("pop") == "confidence", F.array(F.struct(F.lit("bin").alias("kind"), bin_index(F.col("c")).cast("string").alias("name")))).otherwise(none)
    labels = F.when(F.col("pop") == "scored", F.transform(F.array_distinct(F.array("t", "p")), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("name")))).otherwise(none)
    w, y, c = F.col("_w"), F.col("y"), F.col("c")
    is_t, is_p = F.col("part.name").eqNullSafe(F.col("t")), F.col("part.name").eqNullSafe(F.col("p"))
    total = lambda where: F.sum(F.when(where, w).otherwise(0))
    per = drawn.withColumn("part", F.explode(F.concat(whole, bins, labels))).groupBy(*keys, "pop", "_rep", F.col("part.kind").alias("kind"), F.col("part.name").alias("name")).agg(
        F.sum(w).alias("n"), F.sum(w * y).alias("sy"), F.sum(w * c).alias("sc"), F.sum(w * (c - y) * (c - y)).alias("gap"), total(is_t & is_p).alias("tp"), total(is_t & ~is_p).alias("fn"), total(is_p & ~is_t).alias("fp")
    )
    all_, bin_, label = (F.col("kind") == k for k in ("all", "bin", "label"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    share = lambda name: F.sum(F.when(all_, F.col(name))) / F.sum(F.when(all_, F.col("n")))
    stats = per.groupBy(*keys, "pop", "_rep").agg(
        share("sy").alias("mean"), share("gap").alias("brier"), (F.sum(F.when(bin_, F.abs(F.col("sy") - F.col("sc")))) / F.sum(F.when(bin_, F.col("n")))).alias("ece"), F.avg(F.when(label, recall)).alias("balanced_acc"), F.avg(F.when(label, f1)).alias("macro_f1"),
    )
    low = (1 - C.BOOTSTRAP_LEVEL) / 2
    of = {"accuracy": ("scored", "mean"), "balanced_acc": ("scored", "balanced_acc"), "macro_f1": ("scored", "macro_f1"), "ece": ("confidence", "ece"), "brier": ("confidence", "brier"), "hallucination": ("open", "mean"), "abstention": ("abstain", "mean")}
    ends = [F.percentile(F.when(F.col("pop") == pop, F.col(stat)), F.lit(q)).alias(f"{name}_ci_{end}") for name, (pop, stat) in of.items() if pops is None or pop in pops for end, q in (("lo", low), ("hi", 1 - low))]
    return stats.groupBy(*keys).agg(*ends)


def exact_interval(df: DataFrame, keys: list[str], value: str, order: list[str], stat: Callable[[np.ndarray], float] = np.mean, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = C.BOOTSTRAP_SEED, cluster: str | None = None) -> DataFrame:
    """Draws with a seeded generator inside each group, in the order of ``order``: the same numbers as the usual
    NumPy recipe, with any ``stat``. A group must fit in one task; use ``mean_interval`` for large ones."""
    low, high = 50 * (1 - C.BOOTSTRAP_LEVEL), 50 * (1 + C.BOOTSTRAP_LEVEL)

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable").dropna(subset=[value])
        x = group[value].to_numpy(float)
        row = group.iloc[:1][keys].copy()
        rng = np.random.default_rng(seed)
        if not len(x):
            return row.iloc[:0].assign(stat=0.0, ci_lo=0.0, ci_hi=0.0)
        if cluster:
            names = np.unique(group[cluster].to_numpy())
            by = {c: x[group[cluster].to_numpy() == c] for c in names}
            stats = [stat(np.concatenate([by[c] for c in rng.choice(names, size=len(names), replace=True)])) for _ in range(replicates)]
        else:
            stats = [stat(rng.choice(x, size=len(x), replace=True)) for _ in range(replicates)]
        return row.assign(stat=float(stat(x)), ci_lo=float(np.percentile(stats, low)), ci_hi=float(np.percentile(stats, high)))

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "stat double, ci_lo double, ci_hi double"])
    columns = list(dict.fromkeys([*keys, value, *order, *([cluster] if cluster else [])]))
    return df.select(*columns).groupBy(*keys).applyInPandas(draw, schema)
