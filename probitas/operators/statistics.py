"""Statistics that users bring, as mergeable aggregates, and bootstrap intervals of them.

A statistic is an object with four methods, so that parts of a group can be summed up apart, by any task, in any order:

    init()                      the state of no rows
    update(state, rows, times)  the state with the rows of a pandas frame, each as often as ``times`` says
    merge(a, b)                 the state of both
    finish(state)               the number, or None where there is none

Tasks keep a state for each group that they meet, and pass states on instead of rows; the states of a group are merged
one after another, in two rounds, so that a group which all tasks have met is no single task's list.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import ship_package
from .bootstrap import draw_counts

#: A task passes its states on when it keeps so many groups.
GROUPS = 4096
#: Parts that the states of one group are merged in before the last round.
PARTS = 16


class Statistic(Protocol):
    def init(self) -> Any: ...
    def update(self, state: Any, rows: pd.DataFrame, times: np.ndarray) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> float | None: ...


class Quantile:
    """The smallest value that at least a share ``q`` of the rows do not exceed; nulls are left out. The state counts
    equal values."""

    def __init__(self, column: str, q: float = 0.5) -> None:
        self.column, self.q = column, q

    def init(self) -> Counter:
        return Counter()

    def update(self, state: Counter, rows: pd.DataFrame, times: np.ndarray) -> Counter:
        for value, n in zip(rows[self.column], times.tolist(), strict=True):
            if n and value == value and value is not None:
                state[value] += n
        return state

    def merge(self, a: Counter, b: Counter) -> Counter:
        a.update(b)
        return a

    def finish(self, state: Counter) -> float | None:
        if not state:
            return None
        values = sorted(state)
        upto = np.cumsum([state[v] for v in values])
        return float(values[int(np.searchsorted(upto, self.q * upto[-1]))])


class FScore:
    """The F-score of one answer: ``beta`` times as much weight on what it should find as on what it finds rightly."""

    def __init__(self, truth: str, answer: str, positive: str, beta: float = 1.0) -> None:
        self.truth, self.answer, self.positive, self.beta = truth, answer, positive, beta

    def init(self) -> np.ndarray:
        return np.zeros(3, np.int64)

    def update(self, state: np.ndarray, rows: pd.DataFrame, times: np.ndarray) -> np.ndarray:
        t, p = ((rows[c] == self.positive).to_numpy(bool) for c in (self.truth, self.answer))
        return state + [times[t & p].sum(), times[t & ~p].sum(), times[~t & p].sum()]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> float | None:
        hit, missed, wrong = state.tolist()
        square = self.beta * self.beta
        below = (1 + square) * hit + square * missed + wrong
        return (1 + square) * hit / below if below else None


def _merged(rows: DataFrame, by: list[str], keys: list[str], statistic: Statistic, schema: str) -> DataFrame:
    """States with equal ``by`` merged to one, one after another: a task holds the states of one group at a time."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, row, states = None, None, None
        for pdf in frames:
            out = []
            for at, state, *key in zip(pdf["_at"], pdf["_state"], *(pdf[c] for c in [*by, *keys]), strict=True):
                more = pickle.loads(state)
                if at == last:
                    states = [statistic.merge(a, b) for a, b in zip(states, more, strict=True)]
                    continue
                if last is not None:
                    out.append((*row, pickle.dumps(states)))
                last, states = at, more
                row = key
            if out:
                yield pd.DataFrame(out, columns=[*by, *keys, "_state"])
        if last is not None:
            yield pd.DataFrame([(*row, pickle.dumps(states))], columns=[*by, *keys, "_state"])

    at = F.concat_ws("|", *by)
    return rows.withColumn("_at", at).repartition(*by).sortWithinPartitions("_at").mapInPandas(merge, schema)


def _states(rows: DataFrame, keys: list[str], statistic: Statistic, slots: int) -> DataFrame:
    """(keys, _g, _state) from (keys, statistic's columns, _times: how often the row counts, for each of ``slots``)."""
    ship_package(rows.sparkSession)
    types = dict(rows.dtypes)
    kinds = "".join(f", `{k}` {types[k]}" for k in keys)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % PARTS
        held: dict[str, tuple] = {}

        def flushed() -> pd.DataFrame:
            return pd.DataFrame([(g, part, *row, pickle.dumps(states)) for g, (row, states) in held.items()], columns=["_g", "_part", *keys, "_state"])

        for pdf in frames:
            for g, some in pdf.groupby("_g", sort=False):
                if g not in held:
                    if len(held) >= GROUPS:
                        yield flushed()
                        held.clear()
                    held[g] = (tuple(some[k].iloc[0] for k in keys), [statistic.init() for _ in range(slots)])
                row, states = held[g]
                times = np.stack([np.asarray(x, np.int64) for x in some["_times"]])
                held[g] = (row, [statistic.update(s, some, times[:, i]) for i, s in enumerate(states)])
        if held:
            yield flushed()

    group = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys], F.lit(""))
    parts = rows.withColumn("_g", group).mapInPandas(partial, f"_g string, _part int{kinds}, _state binary")
    some = _merged(parts, ["_g", "_part"], keys, statistic, f"_g string, _part int{kinds}, _state binary")
    return _merged(some.drop("_part"), ["_g"], keys, statistic, f"_g string{kinds}, _state binary")


def aggregate(df: DataFrame, keys: list[str], columns: list[str], statistic: Statistic) -> DataFrame:
    """(keys, value) of a statistic over the ``columns`` of each group's rows; null keys are a group. An empty table
    gives no rows."""
    rows = df.select(*keys, *columns, F.array(F.lit(1).cast("long")).alias("_times"))
    return _finished(_states(rows, keys, statistic, 1), keys, statistic)


def aggregate_interval(df: DataFrame, keys: list[str], columns: list[str], statistic: Statistic, replicates: int = C.BOOTSTRAP_REPLICATES, seed: int = C.BOOTSTRAP_SEED, level: float = C.BOOTSTRAP_LEVEL) -> DataFrame:
    """(keys, value, ci_lo, ci_hi) of a statistic: rows alike in ``columns`` are one cell, whose draws of all replicates
    meet the statistic together. Replicates without a number are left out."""
    cells = df.groupBy(*keys, *columns).agg(F.count("*").alias("m"))
    drawn = draw_counts(cells, keys, columns, replicates, seed)
    rows = drawn.select(*keys, *columns, F.concat(F.array(F.col("m").cast("long")), F.col("_w")).alias("_times"))
    return _finished(_states(rows, keys, statistic, replicates + 1), keys, statistic, level)


def _finished(states: DataFrame, keys: list[str], statistic: Statistic, level: float | None = None) -> DataFrame:
    @F.pandas_udf("value double, ci_lo double, ci_hi double")
    def finish(column: pd.Series) -> pd.DataFrame:
        out = []
        for raw in column:
            value, *rest = (statistic.finish(s) for s in pickle.loads(raw))
            rest = [x for x in rest if x is not None]
            ends = np.percentile(rest, [50 * (1 - level), 50 * (1 + level)]).tolist() if rest and level else [None, None]
            out.append((value, *ends))
        return pd.DataFrame(out, columns=["value", "ci_lo", "ci_hi"], dtype="Float64")

    done = states.select(*keys, finish("_state").alias("_f"))
    ends: list[Column] = [F.col("_f.ci_lo").alias("ci_lo"), F.col("_f.ci_hi").alias("ci_hi")] if level else []
    return done.select(*keys, F.col("_f.value").alias("value"), *ends)
