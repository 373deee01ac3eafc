"""Substring dedup of words: edges of a de Bruijn graph, compacted to paths, checked by source coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import broadcast_if_small, set_aside, stage
from .hashing import U, anchor_of_windows, minimizers, mix, window_hashes, word_hashes
from .shared import first_copies, is_shared, shared_hashes
from .suffix import run_spans

#: Words of an edge (a window), and of the anchors by which windows are found to be repeated at all.
WIDTH, GRAM = 50, 16
SPAN = WIDTH - GRAM + 1


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = window_hashes(values, GRAM)
    return (h, *minimizers(h, SPAN))


def anchor_hashes(data: bytes) -> np.ndarray:
    h, _, chosen = anchors(word_hashes(data)[0])
    return h[chosen]


def edges_of(docs: DataFrame) -> DataFrame:
    """(edge, next, check, doc_id, key, pos, source_doc, source_pos) of the windows that may repeat.

    An edge is a 50-word k-mer, from the node of its first 49 words to that of its last; ``next`` is the edge
    that follows in the text, ``check`` a second, independent fingerprint. An edge that several documents of a
    batch have is sent for the smallest one; the others come with that one as their source.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for doc_id, key, text, shared in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "key", "text", "shared")), strict=True):
                values = word_hashes(text.encode())[0]
                h, low, chosen = anchors(values)
                if not len(low):
                    continue
                at = anchor_of_windows(h, low, chosen)
                pos = np.flatnonzero(is_shared(h[chosen], shared)[at])
                edge = window_hashes(values, WIDTH)
                check = window_hashes(mix(values + U(0x51ED2701)), WIDTH)
                follow = np.concatenate([edge[1:], [U(0)]])
                same = np.full(len(pos), doc_id)
                parts.append((edge[pos], follow[pos], check[pos], same, np.full(len(pos), key), pos))
            if not parts:
                continue
            edge, follow, check, doc, key, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, doc, edge))
            edge, follow, check, doc, key, pos = (x[order] for x in (edge, follow, check, doc, key, pos))
            repeat = np.concatenate([[False], (edge[1:] == edge[:-1])])
            lead = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(edge))))
            # the same document again is no repeat of itself: it goes on like the first
            local = repeat & (doc > doc[lead]) & (check == check[lead])
            kinds = [x.view(np.int64) for x in (edge, follow, check)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, kinds), pa.array(doc), pa.array(key), pa.array(pos), pa.array(doc[lead], mask=~local), pa.array(pos[lead], mask=~local)],
                ["edge", "next", "check", "doc_id", "key", "pos", "source_doc", "source_pos"],
            )

    return docs.mapInArrow(each, "edge long, next long, check long, doc_id long, key long, pos long, source_doc long, source_pos long")


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with key; staged copies (doc_id, key); staged (doc_id, key, runs) of windows that also start in
    a smaller document."""
    docs, copies = first_copies(docs)
    single = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * WIDTH - 1)).select("doc_id", "key", "text").join(broadcast_if_small(copies), ["doc_id", "key"], "left_anti")
    sharing = shared_hashes(single, anchor_hashes)
    # joined by a shuffle at any size: both sides grow with the corpus
    edges = stage(edges_of(single.join(sharing, ["doc_id", "key"])), "edges")
    sent = edges.filter(F.col("source_doc").isNull())
    # The repeated edges: their first source, and whether the graph branches after them.
    graph = sent.groupBy("edge").agg(
        F.min(F.struct("doc_id", "pos", "check")).alias("first"), F.max("doc_id").alias("most"), F.min("next").alias("next_low"), F.max("next").alias("next_high")
    ).filter(F.col("first.doc_id") < F.col("most"))
    found = sent.drop("source_doc", "source_pos").join(graph, "edge").filter((F.col("doc_id") > F.col("first.doc_id")) & (F.col("check") == F.col("first.check")))
    found = found.select("doc_id", "key", "pos", F.col("first.doc_id").alias("source_doc"), F.col("first.pos").alias("source_pos"), (F.col("next_low") != F.col("next_high")).alias("branches"))
    local = edges.filter(F.col("source_doc").isNotNull()).select("doc_id", "key", "pos", "source_doc", "source_pos", F.lit(False).alias("branches"))
    every = found.unionByName(local)
    # A nonbranching path goes on while its own and its source's coordinates advance together.
    along = Window.partitionBy("doc_id", "key").orderBy("pos")
    before = lambda c: F.lag(c).over(along)
    goes_on = (F.col("pos") == before("pos") + 1) & (F.col("source_doc") == before("source_doc")) & (F.col("source_pos") == before("source_pos") + 1) & ~before("branches")
    paths = every.withColumn("cut", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("cut").over(along))
    paths = paths.groupBy("doc_id", "key", "path").agg(F.min("pos").alias("start"), F.count("*").alias("count"), F.min("source_doc").alias("source_doc"), F.min("source_pos").alias("source_start"))
    # A document's paths: bounded by its own length.
    per = paths.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "count", "source_doc", "source_start")).alias("runs"))
    return docs, copies, stage(per, "runs")


def remove_repeats(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256; with ``rewrite`` text becomes the kept words joined by one
    blank, else it is dropped.

    A window is 50 consecutive words `[^\\x20\\x09-\\x0D]+` of one document; each word covered by a window that
    also starts in a document of a smaller doc_id is removed, judged on the input. A null text has no words
    (and stays null when rewritten). Null doc_ids neither lose words nor make others lose them; rows of equal
    doc_id do not remove each other. Empty tables give an empty result; other columns pass through, those of
    the new names are replaced.
    """
    new = ["n_words", "n_removed", "kept_sha256"]
    slim, restore = set_aside(docs, ["doc_id", "text"], new)
    fields = [f for f in slim.schema.fields if rewrite or f.name != "text"]
    slim, copies, runs = find_repeats(slim)
    joined = slim.join(broadcast_if_small(copies.withColumn("copy", F.lit(True)).transform(stage, "copies")), ["doc_id", "key"], "left").join(runs, ["doc_id", "key"], "left")
    schema = StructType([*fields, *(StructField(c, StringType() if c == "kept_sha256" else LongType()) for c in new)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            out: tuple[list, ...] = ([], [], [], [])
            for text, copy, runs in zip(column("text").to_pylist(), column("copy").to_pylist(), column("runs").to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes: blanks are exactly \x20 and \x09-\x0D
                kept = [] if copy and len(words) >= WIDTH else words
                if runs and kept:
                    kept, past = [], 0
                    for a, b in zip(*(x.tolist() for x in run_spans(runs, WIDTH)), strict=True):
                        kept += words[past:a]
                        past = b
                    kept += words[past:]
                body = b" ".join(kept)
                for c, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), None if text is None or not rewrite else body.decode()), strict=True):
                    c.append(x)
            columns = {f.name: column(f.name) for f in fields}
            if rewrite:
                columns["text"] = pa.array(out[3], pa.string())
            columns |= {"n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept_sha256": pa.array(out[2], pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return restore(joined.mapInArrow(cut, schema), *new)
