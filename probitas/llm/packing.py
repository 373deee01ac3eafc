"""Retrieval packing: each window is filled with the seed's nearest unused neighbours by BM25."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, buckets, join_unique, regrouped, release, running_total, stage
from .hashing import U, mix
from .tokens import default_path, load

WINDOW, END_ID = 4096, 2
#: Token ids of one index shard on average; a shard is the work and the memory of one task.
SHARD_IDS = 1 << 20
#: Bytes of texts that are put together, and characters that are numbered together: a worker holds some 40 times as much.
TEXT_BYTES = 2 << 20
#: The router: at most some SAMPLE documents (those of the smallest hashes) give CLUSTERS centres in DIMENSIONS.
SAMPLE, CLUSTERS, DIMENSIONS = 2048, 16, 1024
K1, B = 1.2, 0.75


class Router:
    """Where a document's nearest texts are likely to be: its cluster, its length, its smallest term hash.

    Clusters are spherical k-means over hashed term counts of a bounded sample. A cell is (cluster, length to a
    quarter of a power of two, longest first, 8 bits of the smallest hash of the terms): near copies and texts of the
    same words and length share it, and neighbouring cells hold what is nearly so.
    """

    def __init__(self, sample: list[np.ndarray]) -> None:
        x = np.stack([np.bincount(s & (DIMENSIONS - 1), minlength=DIMENSIONS) for s in sample]) if sample else np.zeros((1, DIMENSIONS))
        self.weight = np.log1p(len(x) / (1.0 + (x > 0).sum(0))).astype(np.float32)
        x = self.unit(x)
        rng = np.random.default_rng(0)
        centres = x[:1]
        while len(centres) < min(CLUSTERS, max(1, len(x) // 64)):
            far = np.clip(1 - (x @ centres.T).max(1), 0, None).astype(np.float64) ** 2
            if not far.sum():
                break
            centres = np.concatenate([centres, x[rng.choice(len(x), 1, p=far / far.sum())]])
        for _ in range(12):
            of = (x @ centres.T).argmax(1)
            centres = np.stack([x[of == k].sum(0) if (of == k).any() else centres[k] for k in range(len(centres))])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        self.centres = centres.astype(np.float32)

    def unit(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts.astype(np.float32)) * self.weight
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def cells(self, streams: list[np.ndarray], terms: list[np.ndarray]) -> np.ndarray:
        cluster = np.empty(len(streams), np.int64)
        for i in range(0, len(streams), 256):
            counts = np.stack([np.bincount(s & (DIMENSIONS - 1), minlength=DIMENSIONS) for s in streams[i : i + 256]])
            cluster[i : i + 256] = (self.unit(counts) @ self.centres.T).argmax(1)
        length = np.array([int(4 * np.log2(len(s))) if len(s) else 0 for s in streams])
        least = np.array([int(mix(t.astype(np.uint64) + U(1)).min() >> U(56)) if len(t) else 0 for t in terms])
        return (cluster << 32) + ((255 - length) << 8) + least


class Index:
    """A BM25 inverted index over one shard's documents; terms are token ids, weights use corpus counts."""

    def __init__(self, streams: list[np.ndarray], frequency: np.ndarray, corpus_docs: int, average: float) -> None:
        self.size = len(streams)
        terms, counts, owner = [], [], []
        for d, ids in enumerate(streams):
            t, n = np.unique(ids, return_counts=True)
            terms.append(t.astype(np.int64))
            counts.append(n)
            owner.append(np.full(len(t), d))
        self.terms = terms
        length = np.array([len(s) for s in streams])
        term, n, doc = np.concatenate(terms), np.concatenate(counts), np.concatenate(owner)
        self.idf = np.log1p((corpus_docs - frequency + 0.5) / (frequency + 0.5))
        weight = self.idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[doc] / max(average, 1)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(len(frequency) + 1))

        # all scores at once by a matrix product where that is less work than a query for each window
        used = np.unique(term)
        queries = max(1, int(length.sum()) // WINDOW) * len(term) / max(1, self.size)
        self.scores = None
        if self.size * len(used) < 1 << 22 and self.size**2 * len(used) / 2e10 < queries * 2.5e-6:
            held = np.zeros((2, self.size, len(used)), np.float32)
            at = np.searchsorted(used, term)
            held[0, doc, at], held[1, doc, at] = 1, weight
            self.scores = held[0] @ held[1].T

    def score(self, seed: int) -> np.ndarray:
        if self.scores is not None:
            return self.scores[seed]
        score = np.zeros(self.size, np.float32)
        for a, b in zip(self.first[self.terms[seed]], self.first[self.terms[seed] + 1], strict=True):
            score[self.doc[a:b]] += self.weight[a:b]
        return score

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents by falling score against all terms of the seed; equal scores by number."""
        return np.argsort(-self.score(seed), kind="stable")

    def nearest(self, seed: int, unused: np.ndarray, most: int = 64) -> Iterator[int]:
        """The unused ones of the neighbours, the first ``most`` without sorting all."""
        free = np.flatnonzero(unused)
        score = self.score(seed)[free]
        if len(free) > 2 * most:
            top = score >= np.partition(score, len(score) - most)[len(score) - most]
            yield from free[top][np.argsort(-score[top], kind="stable")].tolist()
            free, score = free[~top], score[~top]
        yield from free[np.argsort(-score, kind="stable")].tolist()


def fill(lengths: list[int], index: Index, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    The longest unused document is the seed of a window; its nearest unused neighbours follow while there is room, and
    the one that meets the end is cut there: its rest opens the next window, as that one's seed. So only the last
    sequence of a shard is short.
    """
    order = sorted(range(len(lengths)), key=lambda d: (-lengths[d], d))
    unused = np.ones(len(lengths), bool)
    sequence = room = 0
    at = offset = 0
    carry: tuple[int, int] | None = None
    while True:
        if carry is None:
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                return
            seed, done = order[at], 0
            unused[seed] = False
        else:
            seed, done = carry
        carry = None
        queue: Iterator[int] | None = None
        doc = seed
        offset, room = 0, window
        while True:
            n = min(room, lengths[doc] - done)
            yield doc, done, n, sequence, offset
            offset, room, done = offset + n, room - n, done + n
            if done < lengths[doc]:
                carry = (doc, done)
                break
            if not room:
                break
            if queue is None:
                queue = index.nearest(seed, unused)
            doc = next(queue, -1)  # none of them was used since the window began but by itself
            if doc < 0:
                return
            unused[doc], done = False, 0
        sequence += 1


def sampled_router(docs: DataFrame, tokenizer: str, count: int) -> Router:
    """The router of a corpus of ``count`` documents, from some SAMPLE of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        for batch in batches:
            ids = [x.astype("<u4").tobytes() for x in tok.ids_of(batch.column(1).to_pylist(), TEXT_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["name", "ids"])

    name = F.xxhash64("doc_id", "text")
    # each row with the same chance, by its content: about SAMPLE of them, whatever the number of documents
    below = -(1 << 63) + int((1 << 64) * min(1.0, SAMPLE / max(1, count))) - 1
    rows = docs.select(name.alias("name"), "text").filter(F.col("name") <= below).mapInArrow(each, "name long, ids binary").orderBy("name").limit(2 * SAMPLE).toPandas()
    return Router([np.frombuffer(b, "<u4").astype(np.int64) for b in rows["ids"]])


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, router: Router) -> DataFrame:
    """Staged (doc_id, n, cell, ids, seen): each document's ids with its end id, as little-endian bytes, and its cell;
    a row without n for each task has in ``seen`` the number of its documents that hold each token id."""
    names = ["doc_id", "n", "cell", "ids", "seen"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer)
        end = tok.kind(end_id)
        seen = np.zeros(len(tok.ends), np.uint32)
        for batch in regrouped(batches, TEXT_BYTES):
            streams = [np.append(ids, end) for ids in tok.ids_of(batch.column(1).to_pylist(), TEXT_BYTES)]
            terms = [np.unique(s) for s in streams]
            if max(end_id, *(int(t[-1]) for t in terms)) >= len(seen):
                seen = np.concatenate([seen, np.zeros(end_id + 1, np.uint32)])
            seen += np.bincount(np.concatenate(terms), minlength=len(seen)).astype(np.uint32)
            columns = ([len(s) for s in streams], router.cells(streams, terms), [s.tobytes() for s in streams], [None] * len(streams))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, None, seen.tobytes()), kinds, strict=True)], names)
        release()

    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n long, cell long, ids binary, seen binary"), "ids")


def term_counts(ids: DataFrame) -> np.ndarray:
    """In how many documents each token id occurs, over the whole corpus."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen = np.frombuffer(body, np.uint32)
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    per = ids.filter("seen is not null").select("seen").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = per.toPandas()  # at most one row per entry of the vocabulary
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1)
    out[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def deal(ids: DataFrame, shard_docs: int | None, shard_ids: int) -> DataFrame:
    """``ids`` with ``shard``: cells in order fill shards of ``shard_ids`` ids (or of ``shard_docs`` documents), and a
    cell of many shards is dealt among them by content: no cell, source or group of copies makes a large shard."""
    size = F.lit(1).cast("long") if shard_docs else F.col("n")
    cells = stage(ids.groupBy("cell").agg(F.sum(size).alias("total"), F.count("*").alias("rows")), "cells")
    cells = stage(running_total(cells, ["cell"], "total", "before"), "cells", [cells])
    hinted = broadcast_if_small(cells)
    joined = ids.join(hinted.drop("rows"), "cell") if hinted is not cells else join_unique(ids, cells, "cell", "rows")
    place = F.col("before") + F.pmod(F.xxhash64("doc_id", "ids"), F.col("total"))
    return joined.select("doc_id", "n", "ids", F.floor(place / (shard_docs or shard_ids)).cast("long").alias("shard"))


def pack_documents(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, shard_docs: int | None = None, with_ids: bool = False, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` the ids.

    The inverted index is sharded by content: documents of one cluster and about one length lie together, longest
    first, as a greedy packing of the whole corpus would come to them; inverse document frequencies and the average
    length come from the whole corpus. A seed is asked for in its own shard. A null text is empty: its end id alone
    is packed. Repeated rows are packed each; ties go by doc_id and content; other columns are not read. An empty
    table gives no pieces. Only the last sequence of each shard is short of ``window``.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    router = sampled_router(docs, tokenizer, docs.count())
    staged = tokenised(docs, tokenizer, end_id, router)
    ids = staged.filter("n is not null").drop("seen")
    count, total = ids.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = spark.sparkContext.broadcast(term_counts(staged))  # one number per entry of the vocabulary
    average = total / max(1, count)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        doc_ids, sizes, shard = (table.column(c).to_pylist() for c in ("doc_id", "n", "shard"))
        streams = [np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4") for b, n in zip(table.column("ids").to_pylist(), sizes, strict=True)]
        out = [(doc_ids[d], s, n, zlib.crc32((part := streams[d][s : s + n].astype("<u4")).tobytes()), sizes[d], (shard[0] << 32) + q, o, part.tolist() if with_ids else None) for d, s, n, q, o in fill(sizes, Index(streams, frequency.value, count, average), window)]
        kinds = [*[pa.int64()] * 7, pa.list_(pa.int64())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        release()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<long>"
    shards = -(-count // shard_docs) if shard_docs else -(-total // shard_ids)
    dealt = deal(ids, shard_docs, shard_ids).repartition(max(shards // 16, buckets(spark, 8)), "shard")
    packed = dealt.groupBy("shard").applyInArrow(pack, schema)
    return packed if with_ids else packed.drop("ids")
