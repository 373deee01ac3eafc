"""Benchmark decontamination: short test items inside long documents; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, set_aside, stage
from .quality import words_of

SHINGLE = 5
#: An item counts as contained from this share of its shingles, in hundredths.
SHARE = 80


def _shingles(words: Column, k: int, join, empty: str) -> Column:
    """``join`` of each k words, bound to one evaluation of ``words`` wherever the optimiser may move it."""

    def each(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(F.sequence(F.lit(0), n - k), lambda i: join([F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, full).when(n > 0, F.array(join([F.concat_ws(" ", w)]))).otherwise(F.array().cast(empty))

    return let(words, each)


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of all shingles of ``k`` words; fewer words are one shingle, no words none."""
    return _shingles(words, k, lambda ws: F.xxhash64(*ws), "array<long>")


def shingle_texts(words: Column, k: int = SHINGLE) -> Column:
    """The shingles themselves, words joined by one blank."""
    return _shingles(words, k, lambda ws: F.concat_ws(" ", *ws), "array<string>")


def size_part(n: Column) -> Column:
    """Partitions of sizes by powers of two."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def windows(words: Column, k: int, hashed: bool) -> Column:
    """All runs of ``k`` words as texts, or their hashes; none where there are fewer."""
    text = lambda ws: F.concat_ws(" ", *ws)
    kind = "array<long>" if hashed else "array<string>"
    each = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(text([F.get(w, i + j) for j in range(k)])) if hashed else text([F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast(kind))
    return let(words, each)


def find_contained(docs: DataFrame, items: DataFrame, share: int = SHARE, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of each document that holds ``share`` percent of an item's
    distinct 5-word shingles (words lower-cased), anywhere in its whole text. Rows equal in the columns ``ids``, which
    the result has in place of doc_id, are one document.

    An item is its item_id and its set of shingles: texts of one item_id are items apart, with a row each, unless
    their sets are equal. An item of fewer than five words is one shingle of so many words; documents are searched
    for runs of these lengths too, where there are such items.

    Sketches: an item of q shingles keeps its ``q - ceil(share * q) + 1`` smallest hashes. A document that
    holds enough of the item lacks fewer shingles than that, so it holds at least one hash of the sketch:
    the search loses nothing. Documents are partitioned by size; a partition probes only with hashes below
    the largest sketch value of those items that can fit in it, and a probe meets only items that a document of
    its size can hold. Candidates are verified on the shingles' text.

    Null or wordless texts and items match nothing. Repeated rows give one pair; empty tables give no pairs.
    """
    items = items.select("item_id", words_of(F.lower("text")).alias("_w"))
    items = items.select("item_id", F.array_sort(F.array_distinct(shingle_texts(F.col("_w")))).alias("_s"), F.least(F.size("_w"), F.lit(SHINGLE)).alias("_k")).filter(F.size("_s") > 0)
    items = items.withColumn("_item", F.sha2(F.concat_ws("\n", "_s"), 256)).dropDuplicates(["item_id", "_item"])
    items = stage(items.withColumns({"n_shingles": F.size("_s").cast("long"), "_part": size_part(F.size("_s"))}), "items")
    least = F.ceil(F.col("n_shingles") * share / 100)
    hashed = items.select("item_id", "_item", "_k", "n_shingles", "_part", least.alias("_least"), F.array_sort(shingle_hashes_of("_s")).alias("_h"))
    sketch = hashed.select("item_id", "_item", "_k", "_part", "_least", F.explode(F.slice("_h", F.lit(1), (F.col("n_shingles") - F.col("_least") + 1).cast("int"))).alias("_hash"))
    sketch = stage(sketch, "sketch")
    # One row per power of two up to the longest item, at most 63, and number of words up to five.
    limits = sketch.groupBy("_part", "_k").agg(F.min("_least").alias("low"), F.max("_hash").alias("top")).collect()
    short = sorted({x["_k"] for x in limits if x["_k"] < SHINGLE})

    def every(words: Column, hashed: bool) -> Column:
        whole = shingle_hashes(words) if hashed else shingle_texts(words)
        return F.concat(whole, *[windows(words, k, hashed) for k in short]) if short else whole

    # no filter on the words or their shingles, nor an inner explode that implies one: it would be pushed below
    # the split and make it anew
    probe = docs.select(*ids, words_of(F.lower("text")).alias("_words"))
    n = F.greatest(F.size("_words") - (SHINGLE - 1), F.least(F.size("_words"), F.lit(1)))
    tops = [F.when(n >= x.low, F.lit(x.top)) for x in limits] + [F.lit(None).cast("long")] * 2
    probe = probe.select(*ids, n.alias("_n"), F.greatest(*tops).alias("_top"), F.explode_outer(every(F.col("_words"), True)).alias("_hash")).filter(F.col("_hash") <= F.col("_top"))
    met = probe.join(broadcast_if_small(sketch), "_hash").filter(F.col("_n") >= F.col("_least"))
    pairs = stage(met.select(*ids, "item_id", "_item").distinct(), "candidates")

    found = docs.join(broadcast_if_small(pairs.select(*ids).distinct().transform(stage, "found")), list(ids), "left_semi")
    lines = found.select(*ids, F.explode_outer(F.array_distinct(every(words_of(F.lower("text")), False))).alias("_text"))
    wanted = stage(items.select("item_id", "_item", "n_shingles", F.explode("_s").alias("_text")), "wanted")
    # an item without an id is an item like others
    same = [F.col(f"h.{c}") == F.col(f"p.{c}") for c in (*ids, "_item")] + [F.col("h.item_id").eqNullSafe(F.col("p.item_id"))]
    hits = lines.join(broadcast_if_small(wanted), "_text").alias("h").join(broadcast_if_small(pairs).alias("p"), same, "left_semi")
    counted = hits.groupBy(*ids, "item_id", "_item", "n_shingles").agg(F.countDistinct("_text").alias("n_shared"))
    return counted.filter(100 * F.col("n_shared") >= share * F.col("n_shingles")).drop("_item")


def shingle_hashes_of(shingles: str) -> Column:
    """Hashes of shingle texts that equal those made from the words."""
    parts = lambda s: let(F.split(s, " "), lambda w: F.when(F.size(w) == SHINGLE, F.xxhash64(*[F.get(w, F.lit(j)) for j in range(SHINGLE)])).otherwise(F.xxhash64(s)))
    return F.transform(shingles, parts)


def remove_contaminated(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """``docs`` without those that hold an item of the benchmark; rows with a null id are kept, as is a row whose id
    only another, contaminated text has. Other columns pass through, whatever their names."""
    slim, restore = set_aside(docs, ["doc_id", "text"])
    slim = slim.withColumn("_key", F.xxhash64("text"))
    found = stage(find_contained(slim, items, share, ("doc_id", "_key")).select("doc_id", "_key").distinct(), "leaks")
    return restore(slim.join(broadcast_if_small(found), ["doc_id", "_key"], "left_anti"))
