"""A content-addressed store of token ids: rolling-hash chunks kept once, recipes, Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets, join_unique, new_folder, regrouped, release, stage
from .hashing import U, mix
from .tokens import default_path, load

#: Chunks end where the rolling hash of the last ROLL ids has its low MASK_BITS bits zero: some 300 ids on average,
#: and within the two bounds.
ROLL, MASK_BITS, LEAST, MOST = 16, 8, 64, 2048
END_ID = 1
#: Documents of a block of the manifest's tree.
BLOCK = 1024
#: Words that a worker remembers (some 75 MB).
WORDS = 1_500_000


#: Hashed values of small ids, and how many ids are hashed at once.
GEAR, BLOCK_IDS = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)), 1 << 15


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash over the ROLL ids before has its low bits zero."""
    out = [np.empty(0, np.int64)]
    for at in range(0, len(ids) - ROLL, BLOCK_IDS):
        near = ids[at : at + BLOCK_IDS + ROLL]
        gear = np.zeros(len(near) + 1, np.uint64)
        np.cumsum(GEAR[near] if ids.dtype == np.uint16 else mix(near.astype(np.uint64) + U(1)), out=gear[1:])
        roll = mix(gear[ROLL:] - gear[:-ROLL])[: BLOCK_IDS if at + BLOCK_IDS < len(ids) - ROLL else None]
        out.append(np.flatnonzero((roll & U((1 << MASK_BITS) - 1)) == 0) + (at + ROLL))
    return np.concatenate(out)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream; they depend on nearby ids only."""
    return bounded(marks(ids).tolist() if len(ids) > ROLL else [], len(ids))


def cuts_of(streams: list[np.ndarray]) -> Iterator[list[int]]:
    """``cuts`` of each of many streams."""
    flat = np.concatenate([np.empty(0, np.uint16), *streams])
    ends = np.cumsum([len(x) for x in streams])
    starts = ends - [len(x) for x in streams]
    found = marks(flat)
    low, high = np.searchsorted(found, starts + ROLL), np.searchsorted(found, ends, "right")
    for start, end, i, j in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
        yield bounded((found[i:j] - start).tolist() if end - start > ROLL else [], end - start)


def bounded(ends: list[int], n: int) -> list[int]:
    """Those of ``ends`` that keep chunks of ``n`` ids within the bounds, others where a chunk would be too long, and ``n``."""
    out, past = [], 0
    for end in [*ends, n]:
        while end - past > MOST:
            past += MOST
            out.append(past)
        if end - past >= LEAST and end < n:
            past = end
            out.append(past)
    return [*out, n] if n > past or not out else out


def listed(column: pa.Array) -> list:
    """The values of a column of texts or bytes, or of numbers without nulls; `to_pylist` takes some two microseconds for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def merkle(hashes: list[bytes]) -> bytes:
    """The root over the chunks' hashes: pairs are hashed level by level, an odd one moves up."""
    while len(hashes) > 1:
        hashes = [hashlib.blake2b(b"".join(hashes[i : i + 2]), digest_size=16).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0] if hashes else b""


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of all ``docs`` (doc_id, text) under ``path``.

    * ``chunks``: hash, n_ids and payload (little-endian ids, uint16 where the vocabulary allows, else uint32) of each
      distinct chunk, once. A task sends a payload once; equal ones meet by hash and one is kept.
    * ``recipes``: the documents in ascending doc_id order (nulls first, repeats of an id by their content): part and
      seq, their place; at, the ids before it in its part; n_tokens; hashes and sizes of its chunks; root, the Merkle
      root over the hashes. A file holds one part, parts ascend.
    * ``manifest``: by part its start (ids before it), n_docs, n_ids and root, over its documents' roots by blocks of
      BLOCK; and a row without part for the corpus, with the root over the parts.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    schema = "doc_id long, n_tokens long, hash binary, payload binary, hashes array<binary>, sizes array<int>, root binary, deal long"
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.int64())
    names = [c.split()[0] for c in schema.split(", ")]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer, WORDS)
        sent: set[bytes] = set()
        for batch in regrouped(batches):
            streams = [np.append(ids, tok.kind(end_id)) for ids in tok.ids_of(listed(batch.column(1)))]
            chunks: tuple[list, ...] = ([], [], [])
            docs_of: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids, ends in zip(batch.column(0).to_pylist(), streams, cuts_of(streams), strict=True):
                raw, width = ids.tobytes(), ids.itemsize
                hashes, sizes, past = [], [], 0
                for end in ends:
                    payload = raw[past * width : end * width]
                    h = hashlib.blake2b(payload, digest_size=16).digest()
                    hashes.append(h)
                    sizes.append(end - past)
                    if h not in sent:
                        if len(sent) > 1_000_000:  # forgetting costs a repeated payload, not a wrong result
                            sent.clear()
                        sent.add(h)
                        for column, x in zip(chunks, (end - past, h, payload), strict=True):
                            column.append(x)
                    past = end
                for column, x in zip(docs_of, (doc_id, len(ids), hashes, sizes, merkle(hashes)), strict=True):
                    column.append(x)
            deal = [int.from_bytes(h[:7], "big") for h in chunks[1]] + [int.from_bytes(root[:7], "little") ^ (doc_id or 0) for doc_id, root in zip(docs_of[0], docs_of[4], strict=True)]
            no_chunk, no_doc = [None] * len(streams), [None] * len(chunks[0])
            columns = (no_doc + docs_of[0], chunks[0] + docs_of[1], chunks[1] + no_chunk, chunks[2] + no_chunk, no_doc + docs_of[2], no_doc + docs_of[3], no_doc + docs_of[4], deal)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)
        release()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            hashes = listed(batch.column(2))
            keep = [h is None or h != x for h, x in zip(hashes, [last, *hashes], strict=False)]
            last = hashes[-1] if hashes else last
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["deal"])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(chunked, schema).repartition(buckets(spark, 8), "deal")
    kept = dealt.sortWithinPartitions("hash").mapInArrow(once, schema.replace(", deal long", ""))
    # the chunks, and the recipes on their way to their order
    kept.write.option("compression", "zstd").parquet(f"{path}/chunks")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = at + np.cumsum(n) - n
            place = [pa.array(np.full(len(n), part), pa.int32()), pa.array(np.arange(seq, seq + len(n)), pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*place, *batch.columns], RECIPE_NAMES)
            seq, at = seq + len(n), at + int(n.sum())

    recipes = spark.read.parquet(f"{path}/chunks").filter("payload is null").select("doc_id", "n_tokens", "hashes", "sizes", "root")
    recipes.orderBy("doc_id", "root").mapInArrow(numbered, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    parts = part_roots(spark.read.schema(RECIPES).parquet(f"{path}/recipes"))
    # one row a part: as many as spark.sql.shuffle.partitions at most
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    parts = parts.withColumn("start", before).select(*MANIFEST_NAMES)
    whole = parts.transform(corpus_root)
    parts.unionByName(whole).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/manifest")


RECIPES = "part int, seq long, at long, doc_id long, n_tokens long, hashes array<binary>, sizes array<int>, root binary"
RECIPE_NAMES = [c.split()[0] for c in RECIPES.split(", ")]
MANIFEST_NAMES = ["part", "start", "n_docs", "n_ids", "root"]


def _tree(order: str, leaf: Column) -> Column:
    """The hash over the leaves of a group, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), leaf.alias("h")))), lambda x: x["h"]), ""), 256)


def part_roots(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_ids, root) of recipes: blocks of BLOCK documents are hashed, then the blocks of each part."""
    leaf = F.sha2(F.concat_ws(":", F.hex("root"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("at").cast("string"), F.col("n_tokens").cast("string")), 256)
    blocks = recipes.groupBy("part", F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids"), _tree("seq", leaf).alias("hash"))
    return blocks.groupBy("part").agg(F.sum("n").alias("n_docs"), F.sum("ids").alias("n_ids"), _tree("block", F.col("hash")).alias("root"))


def corpus_root(parts: DataFrame) -> DataFrame:
    one = parts.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"), _tree("part", F.concat_ws(":", "root", F.col("start").cast("string"))).alias("root"))
    return one.select(F.lit(None).cast("int").alias("part"), F.lit(0).cast("long").alias("start"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.coalesce("n_ids", F.lit(0)).cast("long").alias("n_ids"), "root")


def crc32_shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The crc32 register ``crc`` after as many zero bytes: crc32(x + y) is crc32(x) shifted by the length of y, xor
    crc32(y). Polynomials modulo the crc's, in reversed bits, multiplied by x ** (8 * zeros), all at once."""
    out, power, bits = crc.astype(np.uint32), np.uint32(1 << 23), zeros.astype(np.uint64)  # 1 << 23: x ** 8
    while bits.any():
        out = np.where(bits & U(1), _times(out, power), out)
        power = _times(np.array([power]), power)[0]
        bits = bits >> U(1)
    return out


def _times(a: np.ndarray, b: np.uint32) -> np.ndarray:
    """Products of the polynomials ``a`` and ``b``; the highest bit is the coefficient of x ** 0."""
    out = np.zeros_like(a)
    for i in range(31, -1, -1):
        if int(b) >> i & 1:
            out ^= a
        a = (a >> np.uint32(1)) ^ np.where(a & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks, root) of each document, from the files.

    Every stored chunk is read and held against its hash; every recipe takes its chunks' digests by hash. Any
    difference raises: a chunk that is missing or not of its content, a recipe whose root, size or number of chunks
    is not that of its chunks, recipes that do not give their part's root in the manifest, parts that do not give the
    corpus's.
    """
    chunks = spark.read.parquet(f"{path}/chunks").filter("payload is not null")
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    manifest = spark.read.schema("part int, start long, n_docs long, n_ids long, root string").parquet(f"{path}/manifest")
    parts = manifest.filter("part is not null")
    check_manifest(recipes, parts, manifest)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for h, n, payload in zip(*(listed(c) for c in batch.columns), strict=True):
                if hashlib.blake2b(payload, digest_size=16).digest() != h:
                    raise ValueError(f"chunk {h.hex()} does not have the content it is named by")
                width = len(payload) // n
                crcs.append(zlib.crc32(payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["hash", "held", "crc"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk of each recipe, with the bytes of the document after it."""
        for batch in batches:
            part, seq, whole, roots = (listed(batch.column(i)) for i in (0, 1, 4, 7))
            lists, sizes = batch.column(5), batch.column(6)
            hashes, each, first = listed(lists.flatten()), sizes.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            if not np.array_equal(first, sizes.offsets.to_numpy() - sizes.offsets[0].as_py()):
                raise ValueError(f"a recipe of part {part[0]} does not have a size for each chunk")
            held = np.diff(total[first]).tolist()
            for i, root in enumerate(roots):
                if merkle(hashes[first[i] : first[i + 1]]) != root or held[i] != whole[i]:
                    raise ValueError(f"recipe {seq[i]} of part {part[i]} does not give its root")
            row = np.repeat(np.arange(len(roots)), np.diff(first))
            after = 4 * (total[first[1:]][row] - total[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), lists.flatten(), sizes.flatten(), pa.array(after)], ["part", "seq", "hash", "n_ids", "after"])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = crc32_shifted(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(crc.astype(np.int64))], ["part", "seq", "crc"])

    held = chunks.select("hash", F.col("n_tokens").alias("n_ids"), "payload").mapInArrow(verify, "hash binary, held long, crc long")
    used = stage(recipes.mapInArrow(places, "part int, seq long, hash binary, n_ids int, after long"), "places")
    held = stage(used.groupBy("hash").agg(F.count("*").alias("rows")).join(held, "hash"), "held")
    found = join_unique(used, held, "hash", "rows").filter(F.col("held") == F.col("n_ids")).select("part", "seq", "crc", "after")
    crcs = found.mapInArrow(shifted, "part int, seq long, crc long").groupBy("part", "seq").agg(F.bit_xor("crc").alias("ids_crc32"), F.count("*").alias("n_chunks"))
    out = recipes.select("part", "seq", "at", "doc_id", "n_tokens", F.size("hashes").cast("long").alias("_n"), F.lower(F.hex("root")).alias("root")).join(crcs, ["part", "seq"], "left")
    missing = F.raise_error(F.concat(F.lit("a chunk is missing of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    n_chunks = F.when(F.col("_n").eqNullSafe(F.col("n_chunks")), F.col("_n")).otherwise(missing.cast("long"))
    # one row a part
    out = out.join(F.broadcast(parts.select("part", "start")), "part")
    return out.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", F.when(n_chunks > 0, F.col("ids_crc32")).alias("ids_crc32"), n_chunks.cast("int").alias("n_chunks"), "root")


def check_manifest(recipes: DataFrame, parts: DataFrame, manifest: DataFrame) -> None:
    """Raise where the recipes are not those of the manifest, or its parts not those of its corpus row."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    found = part_roots(recipes).withColumn("start", before).select(*MANIFEST_NAMES)
    for name, a, b in (("recipes", found, parts), ("parts", corpus_root(parts), manifest.filter("part is null"))):
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in MANIFEST_NAMES]
        differ = a.alias("a").join(b.alias("b"), F.col("a.part").eqNullSafe(F.col("b.part")), "full").filter(~(same[0] & same[1] & same[2] & same[3] & same[4]))
        if not differ.isEmpty():
            raise ValueError(f"the {name} are not those of the manifest")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, ids): the streams themselves, rebuilt from recipes and chunks."""
    held = spark.read.parquet(f"{path}/chunks").filter("payload is not null").select("hash", F.col("payload").alias("held"))
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    each = recipes.select("part", "seq", "doc_id", F.posexplode(F.arrays_zip("hashes", "sizes")).alias("number", "c")).select("part", "seq", "doc_id", "number", F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("n_ids"))
    parts = each.join(held, "hash").groupBy("part", "seq", "doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "n_ids", "held"))).alias("parts"))

    def glue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.concatenate([np.frombuffer(p["held"], "<u2" if len(p["held"]) == 2 * p["n_ids"] else "<u4").astype(np.int64) for p in ps]) for ps in b["parts"]]
            yield pd.DataFrame({"part": b["part"], "seq": b["seq"], "doc_id": b["doc_id"].astype("Int64"), "ids": ids})

    return parts.mapInPandas(glue, "part int, seq long, doc_id long, ids array<long>")


def store_documents(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a store and return the digests read back from it.

    A null text is the empty text (one end id). Repeated rows keep entries of their own, null ids come first, other
    columns are not read; an empty table gives an empty store and result.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "store")
    write_store(docs, path, tokenizer, end_id)
    return read_digests(spark, path)
