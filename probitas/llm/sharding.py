"""Longest-processing-time sharding: whole groups, largest first, each to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, buckets, join_unique, set_aside, stage


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one ``size`` each shard gets, when each in turn goes to the shard of
    the smallest (load, number). ``loads`` is brought up to date.

    A heap hands out the last few; a long run of equal groups is first brought near its end by arithmetic,
    which gives what the heap would give: the ``count`` smallest of all loads[j] + i * size.
    """
    got = [0] * len(loads)
    if count > 4 * len(loads):
        low, high = min(loads), max(loads) + size * count
        taken = lambda top: sum(max(0, (top - x) // size + 1) for x in loads)
        while low < high:  # the largest level that hands out fewer than count
            mid = (low + high + 1) // 2
            low, high = (mid, high) if taken(mid) < count else (low, mid - 1)
        got = [max(0, (low - x) // size + 1) for x in loads]
        if sum(got) >= count:
            got = [0] * len(loads)
    heap = [(x + n * size, j) for j, (x, n) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, j = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, j))
        got[j] += 1
    for j, n in enumerate(got):
        loads[j] += n * size
    return got


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    Law ``bytes``: documents of equal text (a null counts as the empty text) are one group and stay together;
    groups go, by falling total size, to the shard with the smallest load. Sizes are UTF-8 bytes plus 1, so
    empty texts count too. Ties: equal sizes are ordered by their text's hash, equal loads by shard number.
    Rows that repeat entirely are kept and get slots of their own; an empty table gives an empty result;
    other columns pass through (those named like the new ones are replaced).

    Only the histogram (size, number of groups) passes through one task, as a stream with eight loads as its
    state. Ranks inside a size and slots inside a shard are counted by salted cells, so neither a common size
    nor a shard is ever one task.
    """
    spark = docs.sparkSession
    n = buckets(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    slim, restore = set_aside(docs, [doc_id, text], new)
    docs = slim.withColumns(
        {"_key": F.unhex(F.sha2(body, 256)), "size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary"))}
    )
    groups = docs.groupBy("_key").agg(F.sum("size").alias("_total"), F.count("*").alias("_rows"))
    salted = stage(groups.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(n)).cast("int")), "groups")
    cells = salted.groupBy("_total", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_total").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("_total", "_salt", before.alias("_before"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * shards
        for b in batches:
            ends = []
            for size, count in zip(b["_total"], b["_n"], strict=True):
                got, end, row = deal(loads, int(size), int(count)), 0, []
                for x in got:
                    end += x
                    row.append(end)
                ends.append(row)
            yield pd.DataFrame({"_total": b["_total"], "_ends": ends})

    histogram = salted.groupBy("_total").agg(F.count("*").alias("_n")).orderBy(F.desc("_total")).coalesce(1)
    dealt = stage(histogram.mapInPandas(assign, "_total long, _ends array<long>"), "dealt")
    rank = F.row_number().over(Window.partitionBy("_total", "_salt").orderBy("_key")) + F.col("_before")
    placed = (
        salted.join(cells, ["_total", "_salt"])
        .withColumn("_rank", rank)
        .join(broadcast_if_small(dealt), "_total")
        .select("_key", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int").alias("shard"), "_rows")
    )
    out = join_unique(docs, stage(placed, "placed"), "_key", "_rows").withColumn("_cell", F.pmod(F.xxhash64(F.col(doc_id), F.col("_key")), F.lit(n)).cast("int"))
    per = out.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # shards * n rows, whatever the input.
    per = F.broadcast(per.select("shard", "_cell", first.alias("_first")))
    slot = F.col("_first") + F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(doc_id, "_key")) - 1
    out = out.join(per, ["shard", "_cell"]).withColumns({"slot": slot.cast("long"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return restore(out, *new)
