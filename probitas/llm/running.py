"""Running totals within groups of any size: no group is one task's work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Totals are taken modulo 2 ** 60: counts and lengths never reach it, hashes wrap.
MASK = (1 << 60) - 1


def running(df: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``before_<v>`` for each of ``values``: the sum of v over the rows of the same group before this one.

    ``group`` has no nulls; ``order`` names columns, or ``-name`` for descending, and null comes first. Values are not
    negative and below 2 ** 60. Rows equal in group and order are taken in any order. ``df`` should be staged: the
    global sort reads it twice. Each task sums its sorted rows; only a group that began in an earlier task needs that
    task's total: the driver sees one row a task.
    """
    spark = df.sparkSession
    keys = [F.col(group), *(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order)]
    new = [f"before_{v}" for v in values]
    names = [*df.columns, *new, "_part", "_seq", "_head"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` long" for c in new), "_part int, _seq long, _head boolean"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, last = TaskContext.get().partitionId(), 0, None, None
        carry = np.zeros(len(values), np.uint64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(batch.schema.get_field_index(group))
            fresh = np.ones(n, bool)
            fresh[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            head, fresh_first = g[0].as_py(), last is None or g[0].as_py() != last
            first = head if first is None else first
            starts = np.flatnonzero(fresh)
            at = np.repeat(starts, np.diff([*starts, n]))
            out = []
            for i, v in enumerate(values):
                x = batch.column(batch.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(np.uint64)
                total = np.concatenate([[np.uint64(0)], np.cumsum(x)])
                before = total[:-1] - total[at]
                if not fresh_first:
                    before[: starts[1] if len(starts) > 1 else n] += carry[i]
                carry[i] = before[-1] + x[-1]
                out.append(pa.array((before & np.uint64(MASK)).astype(np.int64)))
            last = g[n - 1].as_py()
            heads = pc.equal(g, pa.scalar(first, g.type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), heads], names)
            seq += n

    done = stage(df.orderBy(*keys).mapInArrow(add, schema), "running")
    ends = F.struct(*[(F.col(b) + F.col(v)).alias(b) for b, v in zip(new, values, strict=True)])
    edges = done.groupBy("_part").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by(ends, "_seq").alias("end")).orderBy("_part").collect()
    shift, last, carry = [], None, [0] * len(values)
    for e in edges:
        joins = last is not None and e["first"] == last
        if joins:
            shift.append((e["_part"], *carry))
        through = joins and e["first"] == e["last"]
        carry = [(int(x) + (c if through else 0)) & MASK for x, c in zip(e["end"], carry, strict=True)]
        last = e["last"]
    out = done
    if shift:
        moved = spark.createDataFrame(shift, ", ".join(["_part int", *(f"`_s{i}` long" for i in range(len(new)))]))
        out = done.join(F.broadcast(moved), "_part", "left")  # one row a task at most
        out = out.withColumns({b: (F.col(b) + F.when(F.col("_head"), F.coalesce(f"_s{i}", F.lit(0))).otherwise(0)).bitwiseAND(F.lit(MASK)) for i, b in enumerate(new)})
    out = out.select(*df.columns, *new)
    out.staged_at = done.staged_at  # type: ignore[attr-defined]
    return out
