"""Suffix-array dedup of bytes: a logarithmic family of sorted suffix levels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import broadcast_if_small, buckets, set_aside, stage
from .hashing import BYTE_VALUES, U, anchor_of_windows, minimizers, window_hashes
from .shared import first_copies, is_shared, shared_hashes

#: Bytes of a match, and of the anchors by which windows meet: every window of WIDTH holds WIDTH - GRAM + 1.
WIDTH, GRAM = 50, 20
SPAN = WIDTH - GRAM + 1
#: Suffixes of one batch of the family.
BATCH_SUFFIXES = 1 << 18
#: Bytes of windows that a task holds to settle equal ones.
STRETCH_BYTES = 16 << 20


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = window_hashes(BYTE_VALUES[np.frombuffer(data, np.uint8)], GRAM)
    return (h, *minimizers(h, SPAN))


def anchor_hashes(data: bytes) -> np.ndarray:
    h, _, chosen = anchors(data)
    return h[chosen]


class Level:
    """A suffix array over batches merged so far: distinct suffixes in the order of their first WIDTH bytes, each with
    the smallest document that it begins in. ``key`` holds these bytes, so equal keys are equal strings."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, batches: int = 1) -> None:
        self.key, self.doc, self.batches = key, doc, batches

    def __len__(self) -> int:
        return len(self.key)

    def merge(self, later: Level) -> Level:
        """Both levels in one order. Of an equal suffix the place in this, the earlier one, stays: a stable sort of two
        sorted runs is their merge."""
        key, doc = np.concatenate([self.key, later.key]), np.concatenate([self.doc, later.doc])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = ~follows(key)
        return Level(key[first], doc[first], self.batches + later.batches)


def follows(key: np.ndarray) -> np.ndarray:
    """Which of the sorted keys equal the one before."""
    return np.concatenate([[False], key[1:] == key[:-1]])


class Family:
    """Levels of geometric sizes over the batches of one text buffer.

    A new batch gets its suffix array, is merge-scanned against each level for suffixes that begin in a smaller
    document, and enters as a level of its own; two levels of as many batches merge into one of twice as many.
    """

    def __init__(self, text: np.ndarray) -> None:
        self.levels: list[Level] = []
        self.view = sliding_window_view(text, WIDTH)

    def add(self, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Index the suffixes at ``place`` of ``doc`` (ascending, none below an earlier batch's); whether each
        equals a suffix of a smaller document on WIDTH bytes."""
        # strings of one width compare as unsigned bytes, zeros included
        key = self.view[place].view(f"S{WIDTH}")[:, 0]
        order = np.argsort(key, kind="stable")
        key, d = key[order], doc[order]
        same = follows(key)
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))  # the smallest document's suffix
        found = np.zeros(len(place), bool)
        found[order[d > d[lead]]] = True
        new = Level(key[~same], d[~same])
        index = np.flatnonzero(~same)
        for level in self.levels:
            # the scan of two sorted runs: where each distinct suffix of the batch would stand in the level
            at = np.searchsorted(level.key, new.key)
            hits = np.flatnonzero(at < len(level))
            hits = hits[level.key[at[hits]] == new.key[hits]]
            self._mark(found, order, index, hits, level.doc[at[hits]], d)
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1].batches == self.levels[-2].batches:
            later, earlier = self.levels.pop(), self.levels.pop()
            self.levels.append(earlier.merge(later))
        return found

    @staticmethod
    def _mark(found, order, index, hits, docs, d) -> None:
        """All suffixes of the batch's groups ``hits`` that belong to a document above ``docs``."""
        end = np.concatenate([index[1:], [len(order)]])
        count = end[hits] - index[hits]
        at = np.repeat(index[hits] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        found[order[at[d[at] > np.repeat(docs, count)]]] = True


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with key; staged copies (doc_id, key); staged (doc_id, key, runs): starts and counts of windows
    that begin in a smaller document, as little-endian int64 pairs."""
    n = 4 * buckets(docs.sparkSession, 16)
    docs, copies = first_copies(docs)
    single = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WIDTH)).select("doc_id", "key", "text").join(broadcast_if_small(copies), ["doc_id", "key"], "left_anti")
    sharing = shared_hashes(single, anchor_hashes)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of shared anchors. Equal runs of windows in one stretch of a task's rows are settled at
        once: the smallest document's goes on, the others are repeats of it."""
        seen: dict[bytes, tuple] = {}
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = rows + [(*v[:4], v[4], body) for body, v in seen.items()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], ["doc_id", "key", "start", "count", "bucket", "body"])

        for batch in batches:
            for doc_id, key, text, shared in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "key", "text", "shared")), strict=True):
                data = text.encode()
                h, low, chosen = anchors(data)
                at = anchor_of_windows(h, low, chosen)
                begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                end = np.concatenate([begin[1:], [len(at)]])
                mine = is_shared(h[chosen[at[begin]]], shared)
                bucket = ((h[chosen[at[begin]]] >> U(32)) % U(n)).astype(np.int64)
                for b, e, k in zip(begin[mine].tolist(), end[mine].tolist(), bucket[mine].tolist(), strict=True):
                    body = data[b : e + WIDTH - 1]
                    here = (doc_id, key, b, e - b, k)
                    there = seen.get(body)
                    if there is None:
                        seen[body] = here
                        size += len(body)
                    elif there[0] == doc_id:  # a document does not repeat itself
                        rows.append((*here, body))
                    else:
                        if here[0] < there[0]:
                            seen[body], here = here, there
                        rows.append((*here[:4], -1 - here[0] % n, None))
                if size > STRETCH_BYTES or len(rows) > 200_000:
                    yield flush()
                    seen, rows, size = {}, [], 0
        yield flush()

    def index(table: pa.Table) -> pa.Table:
        names = ["doc_id", "key", "start", "count"]
        if table.column("bucket")[0].as_py() < 0:
            return table.select(names)
        table = table.sort_by([("doc_id", "ascending"), ("key", "ascending"), ("start", "ascending")])
        doc, key, start, count = (table.column(c).to_numpy() for c in names)
        bodies = table.column("body").to_pylist()
        offset = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])[:-1]
        text = np.frombuffer(b"".join(bodies), np.uint8)
        edge = np.concatenate([[0], np.cumsum(count)])
        family, found = Family(text), np.zeros(edge[-1], bool)
        row = 0
        while row < len(count):
            to = max(row + 1, int(np.searchsorted(edge, edge[row] + BATCH_SUFFIXES, "right")) - 1)
            which = np.repeat(np.arange(row, to), count[row:to])
            step = np.arange(edge[row], edge[to]) - edge[which]
            found[edge[row] : edge[to]] = family.add(offset[which] + step, doc[which])
            row = to
        which = np.repeat(np.arange(len(count)), count)
        at = np.flatnonzero(found)
        cut = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(which[at]) > 0)]) if len(at) else np.empty(0, bool)
        first = np.flatnonzero(cut)
        size = np.diff(np.concatenate([first, [len(at)]]))
        w = which[at[first]]
        return pa.table([pa.array(doc[w]), pa.array(key[w]), pa.array(start[w] + at[first] - edge[w]), pa.array(size.astype(np.int64))], names=names)

    # joined by a shuffle at any size: both sides grow with the corpus
    parts = single.join(sharing, ["doc_id", "key"]).mapInArrow(contexts, "doc_id long, key long, start long, count long, bucket int, body binary")
    runs = parts.repartition(n, "bucket").groupBy("bucket").applyInArrow(index, "doc_id long, key long, start long, count long")
    # A document's runs: bounded by its own length.
    per = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    return docs, copies, stage(per, "runs")


def remove_repeats(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256; with ``rewrite`` text becomes what is left
    (decoded with replacement where a cut splits a character), else it is dropped.

    Every byte covered by a 50-byte string that also starts in a document of a smaller doc_id is removed,
    judged on the input. A null text counts as empty and stays null when rewritten. Rows with a null doc_id
    neither lose bytes nor make others lose them; rows of equal doc_id do not remove each other. Empty tables
    give an empty result; other columns pass through, those of the new names are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    slim, restore = set_aside(docs, ["doc_id", "text"], new)
    fields = [f for f in slim.schema.fields if rewrite or f.name != "text"]
    slim, copies, runs = find_repeats(slim)
    joined = slim.join(broadcast_if_small(copies.withColumn("copy", F.lit(True)).transform(stage, "copies")), ["doc_id", "key"], "left").join(runs, ["doc_id", "key"], "left")
    schema = StructType([*fields, *(StructField(c, StringType() if c == "kept_sha256" else LongType()) for c in new)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, copy, runs in zip(column("text").to_pylist(), column("copy").to_pylist(), column("runs").to_pylist(), strict=True):
                data = (text or "").encode()
                spans = [(0, len(data))] if copy and len(data) >= WIDTH else []
                if runs and not spans:
                    first, end = run_spans(runs, WIDTH)
                    spans = list(zip(first.tolist(), end.tolist(), strict=True))
                left, past = [], 0
                for a, b in spans:
                    left.append(data[past:a])
                    past = b
                kept = b"".join([*left, data[past:]])
                for c, x in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), None if text is None else kept.decode(errors="replace") if rewrite else None), strict=True):
                    c.append(x)
            columns = {f.name: column(f.name) for f in fields}
            if rewrite:
                columns["text"] = pa.array(out[4], pa.string())
            columns |= {n: pa.array(c, pa.int64()) for n, c in zip(["n_bytes", "n_removed", "n_spans"], out, strict=False)}
            yield pa.RecordBatch.from_pydict(columns | {"kept_sha256": pa.array(out[3], pa.string())})

    return restore(joined.mapInArrow(cut, schema), *new)


def run_spans(runs: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of window starts to the maximal spans that they cover."""
    start = np.array([r["start"] for r in runs])
    end = start + np.array([r["count"] for r in runs]) - 1 + width
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(start[1:] > reach[:-1])
    return start[np.concatenate([[0], cut + 1])], reach[np.concatenate([cut, [len(reach) - 1]])]
