"""Which hashes of a document occur in another document too: the filter before every exact comparison.

A document's hashes (anchors of its windows, or signatures of its set) are many, and most occur nowhere else.
They travel as six bytes each in blobs, one per map batch and bucket, and only shared ones come back as rows.
A hash that several documents of a batch have is known to be shared there, so the batch sends it once: a hash
that a third of all documents have costs its bucket one entry per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, join_unique, release, stage
from .hashing import U

SCHEMA = "bucket int, kind int, batch long, doc_id long, key long, hashes binary, owners binary"
NAMES = ["bucket", "kind", "batch", "doc_id", "key", "hashes", "owners"]
TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
#: kinds of rows: hashes on their way to a bucket; a document's shared hashes; the documents of a batch
SENT, FOUND, DOCS = 0, 1, 2
#: A batch sends its blobs when so many hashes have come together.
BATCH_HASHES = 400_000
#: The owner of a hash that several documents of a batch have; a batch has fewer documents.
MANY = np.uint16(0xFFFF)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


def shared_hashes(docs: DataFrame, of: Callable[[bytes], np.ndarray]) -> DataFrame:
    """Staged (doc_id, key, shared): per document the low 32 bits of those of its hashes ``of(text as UTF-8)``
    that some other document has too, as a list of little-endian blobs; documents without any have no row.

    ``docs`` has doc_id, key (any long that tells apart rows of one doc_id) and text. Hashes are compared by
    32 bits and their bucket; a chance match passes here and is refused by the exact step that follows.
    """
    n = 4 * buckets(docs.sparkSession, 16)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        ids: list[tuple[int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            count = np.diff(np.concatenate([np.flatnonzero(first), [len(h)]]))
            several = np.repeat(count > 1, count)
            rows: list[tuple] = []
            # shared within the batch: told to each document at once
            mine = np.argsort(owner[several], kind="stable")
            low, who = (h[several] & U(0xFFFFFFFF)).astype(np.uint32)[mine], owner[several][mine]
            for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1) if len(who) else []:
                d = ids[who[part[0]]]
                rows.append((-1 - int(number % n), FOUND, number, d[0], d[1], low[part].tobytes(), None))
            # each hash once, to its bucket; the owner of one that several have is not needed
            h, owner = h[first], np.where(count > 1, MANY, owner[first])
            bucket = ((h >> U(32)) % U(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(n + 1))
            low = (h & U(0xFFFFFFFF)).astype(np.uint32)
            for b in range(n):
                part = order[edge[b] : edge[b + 1]]
                if len(part):
                    rows.append((b, SENT, number, None, None, low[part].tobytes(), owner[part].tobytes()))
            rows.append((-1 - int(number % n), DOCS, number, None, None, np.array(ids, np.int64).tobytes(), None))
            return _batch(rows)

        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                got = np.unique(of(text.encode()))
                if len(got):
                    held.append(got)
                    ids.append((doc_id, key))
                    size += len(got)
                if size > BATCH_HASHES or len(held) == MANY - 1:
                    yield flush()
                    held, ids, size, number = [], [], 0, number + 1
        if held:
            yield flush()
        del held
        release()

    def match(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        batch = table.column("batch").to_pylist()
        h = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
        owner = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("owners").to_pylist()])
        row = np.repeat(np.arange(len(h)), [len(x) for x in h])
        h = np.concatenate(h)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        known = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hit = order[known]
        hit = hit[owner[hit] != MANY]
        hit = hit[np.argsort(row[hit], kind="stable")]
        cut = np.flatnonzero(np.diff(row[hit]) != 0) + 1
        rows = [(-1, FOUND, batch[row[p[0]]], None, None, h[p].tobytes(), owner[p].tobytes()) for p in np.split(hit, cut) if len(p)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, TYPES, strict=True)], names=NAMES)

    def assemble(table: pa.Table) -> pa.Table:
        """A batch's shared hashes, by document: its size is bounded by the batch's."""
        lists: dict[tuple[int, int], list[bytes]] = {}
        kinds, ids, keys, hashes, owners = (table.column(c).to_pylist() for c in ("kind", "doc_id", "key", "hashes", "owners"))
        names = np.frombuffer(next(h for k, h in zip(kinds, hashes, strict=True) if k == DOCS), np.int64).reshape(-1, 2).tolist()
        away = [(np.frombuffer(o, np.uint16), np.frombuffer(h, np.uint32)) for k, o, h in zip(kinds, owners, hashes, strict=True) if k == FOUND and o is not None]
        if away:
            owner, h = (np.concatenate(x) for x in zip(*away, strict=True))
            order = np.argsort(owner, kind="stable")
            owner, h = owner[order], h[order]
            for p in np.split(np.arange(len(h)), np.flatnonzero(np.diff(owner.astype(np.int64))) + 1) if len(h) else []:
                lists.setdefault(tuple(names[owner[p[0]]]), []).append(h[p].tobytes())
        for k, d, key, o, h in zip(kinds, ids, keys, owners, hashes, strict=True):
            if k == FOUND and o is None:
                lists.setdefault((d, key), []).append(h)
        return pa.table([pa.array([d for d, _ in lists], pa.int64()), pa.array([k for _, k in lists], pa.int64()), pa.array(list(lists.values()), pa.list_(pa.binary()))], names=["doc_id", "key", "shared"])

    found = docs.select("doc_id", "key", "text").mapInArrow(send, SCHEMA).repartition(n, "bucket").groupBy("bucket").applyInArrow(match, SCHEMA)
    found = stage(found, "shared")

    sharing = found.filter(F.col("batch").isNotNull() & (F.col("kind") != SENT)).groupBy("batch").applyInArrow(assemble, "doc_id long, key long, shared array<binary>")
    return stage(sharing, "sharing", [found])


def is_shared(h: np.ndarray, shared: list[bytes]) -> np.ndarray:
    return np.isin((h & U(0xFFFFFFFF)).astype(np.uint32), np.frombuffer(b"".join(shared), np.uint32))


def first_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``key`` (a hash of the text, null as empty), and the staged (doc_id, key) of rows whose
    text is that of a smaller doc_id: found by a partial aggregation over 32-byte hashes."""
    docs = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    digest = stage(docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "digest")
    least = digest.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("rows")).filter(F.col("least") < F.col("most"))
    least = stage(least.drop("most"), "least")
    copies = join_unique(digest, least, "sha", "rows").filter(F.col("doc_id") > F.col("least")).select("doc_id", "key").distinct()
    return docs, stage(copies, "copies", [digest, least])
