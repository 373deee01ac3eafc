"""License scans: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import regrouped, release, stage
from .hashing import FOLDED_VALUES, POWERS, U, WORD_BASE, mix

# --- fixed values: phrases of the contract, and public license wordings -------------------------------------------------
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

#: A template is found where a block holds this share of its distinct words.
SHARE = Fraction(4, 5)
#: The smallest block size; sizes are powers of two.
LEAST = 8
#: Long texts are cut between words into pieces of about so many bytes for hashing.
PIECE = 1 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
NO_WORD = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
FOLD_BYTES = np.arange(256, dtype=np.uint8)
FOLD_BYTES[65:91] += 32


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z in lower case."""
    return WORD.findall((text or "").translate(LOWER))


def block_size(n_words: int) -> int:
    """The power of two, LEAST at least, that holds as many words. A template of this size that stands whole in a text
    lies in one of the blocks of twice the size that begin at its multiples."""
    return max(LEAST, 1 << (max(n_words, 1) - 1).bit_length())


def needed(n_distinct: int, share: Fraction = SHARE) -> int:
    """How many distinct words a block must share with a template of so many."""
    return -(-n_distinct * share.numerator // share.denominator)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: a 64-bit hash with A-Z folded, first byte, end byte."""
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    inside[1:-1] = IS_WORD[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    up, down = POWERS.upto(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(FOLDED_VALUES[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * WORD_BASE), first, end


class Vocabulary:
    """The words of templates and phrases, numbered; `find` tells where they stand in a text."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        raw = [w.encode() for w in words]
        self.lengths = np.array([len(w) for w in raw])
        self.width = int(self.lengths.max())
        self.bytes = np.zeros((len(raw), self.width), np.uint8)
        for i, w in enumerate(raw):
            self.bytes[i, : len(w)] = np.frombuffer(w, np.uint8)
        h, first, end = _word_hashes(b" ".join(raw))
        assert len(h) == len(raw)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def find(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """(words in ``data``, places of known words, their numbers). Hashes propose, the bytes decide."""
        n, at, ids, start = 0, [], [], 0
        while start < len(data):
            cut = NO_WORD.search(data, start + PIECE) if len(data) - start > PIECE else None
            stop = cut.start() if cut else len(data)
            piece = data[start:stop]
            h, first, end = _word_hashes(piece)
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[k] == h)
            word = self.order[k[hit]]
            if len(hit):
                f, size = first[hit], end[hit] - first[hit]
                right = size == self.lengths[word]
                a = np.concatenate([FOLD_BYTES[np.frombuffer(piece, np.uint8)], np.zeros(self.width, np.uint8)])
                own = a[f[:, None] + np.arange(self.width)]
                own[np.arange(self.width) >= size[:, None]] = 0
                right &= (own == self.bytes[word]).all(axis=1)
                at.append(hit[right] + n)
                ids.append(word[right])
            n, start = n + len(h), stop
        none = np.empty(0, np.int64)
        return n, np.concatenate([none, *at]), np.concatenate([none, *ids])


def blocks_of(at: np.ndarray, ids: np.ndarray, size: int, least: int, known: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(block number, distinct known words) of the blocks of 2 * ``size`` words, one at every ``size`` words, that hold
    at least ``least`` of the words marked in ``known``: fewer cannot meet any template of the size."""
    use = known[ids]
    at, ids = at[use] // size, ids[use]
    both = np.unique(np.concatenate([at, at[at > 0] - 1]) * len(known) + np.concatenate([ids, ids[at > 0]]))
    number = both // len(known)
    edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
    return [(int(number[a]), both[a:b] % len(known)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a >= least]


def read_words(docs: DataFrame, templates: list[tuple[str, str]], phrases: list[tuple[str, str]] = PHRASES, share: Fraction = SHARE) -> tuple[DataFrame, list[str]]:
    """One row for each of ``docs`` (doc_id, text): doc_id, n_words, the phrases' places, the known words that it
    holds, its blocks (size, number, words) that may meet a template; and the known words, by their numbers."""
    sets = [(label, words_of(text)) for label, text in templates]
    spoken = [(words_of(p), label) for p, label in phrases]
    vocabulary = sorted({w for _, ws in sets for w in ws} | {w for ws, _ in spoken for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    classes: dict[int, tuple[int, np.ndarray]] = {}
    for _, ws in sets:
        size, own = block_size(len(ws)), set(ws)
        least, known = classes.get(size, (1 << 30, np.zeros(len(vocabulary), bool)))
        known[[number[w] for w in own]] = True
        classes[size] = (min(least, needed(len(own), share)), known)
    phrase_ids = [([number[w] for w in ws], label) for ws, label in spoken]
    fields = pa.struct([("size", pa.int32()), ("number", pa.int64()), ("words", pa.list_(pa.int32()))])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "held", "blocks"]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, held array<int>, blocks array<struct<size: int, number: bigint, words: array<int>>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(vocabulary)
        for batch in regrouped(batches, 2 << 20):
            cols: list[list] = [[] for _ in range(6)]
            ends, sizes, numbers, lengths, flat = [0], [], [], [0], []
            for text in batch.column(1):
                n, at, ids = vocab.find(text.as_buffer().to_pybytes() if text.is_valid else b"")
                places, labels = [], set()
                for ws, label in phrase_ids:
                    found = at[ids == ws[0]]
                    for i, w in enumerate(ws[1:], 1):
                        found = np.intersect1d(found, at[ids == w] - i, assume_unique=True)
                    if len(found):
                        places.append(found)
                        labels.add(label)
                base = np.concatenate(places) if places else None
                row = (n, 0, None, None) if base is None else (n, len(base), int(base.min()), int(base.max()))
                for c, v in zip(cols, (*row, sorted(labels), np.unique(ids).tolist()), strict=True):
                    c.append(v)
                for size, (least, known) in classes.items():
                    for k, ws in blocks_of(at, ids, size, least, known):
                        sizes.append(size)
                        numbers.append(k)
                        flat.append(ws)
                        lengths.append(lengths[-1] + len(ws))
                ends.append(len(sizes))
            words = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *flat]).astype(np.int32)))
            blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(numbers, pa.int64()), words], fields=list(fields)))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), blocks], names)
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema), vocabulary


def join_templates(read: DataFrame, vocabulary: list[str], templates: list[tuple[str, str]], share: Fraction = SHARE) -> DataFrame:
    """(rid, size, number, template, shared, contained) of each block and template that meets the share, by prefix,
    length and positional filters over words in ascending order of how many documents hold them; sets decide.

    A block that shares ``need`` words with a template has one of the template's first n - need + 1 words among its own
    first; only these meet, by equal words, in a join with the index of the templates. ``read`` is staged, with a rid.
    The index has a row for each word of a template's prefix: a parameter's size, not the data's.
    """
    spark = read.sparkSession
    # one row a known word at most
    counts = dict(read.select(F.explode("held").alias("w")).groupBy("w").count().collect())
    order = sorted(range(len(vocabulary)), key=lambda w: (counts.get(w, 0), vocabulary[w]))
    rank = [0] * len(order)
    for r, w in enumerate(order):
        rank[w] = r
    number = {w: i for i, w in enumerate(vocabulary)}
    rows, least = [], {}
    for t, (_, text) in enumerate(templates):
        ws = words_of(text)
        own = sorted(rank[number[w]] for w in set(ws))
        size, need = block_size(len(ws)), needed(len(own), share)
        least[size] = min(need, least.get(size, need))
        rows += [(size, r, t, i, len(own), need, own) for i, r in enumerate(own[: len(own) - need + 1])]
    index = spark.createDataFrame(rows, "size int, rank int, template int, i int, n_template int, need int, own array<int>")
    least_of = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("size"))
    ranks = F.lit(rank)
    blocks = read.select("rid", F.explode("blocks").alias("b")).select("rid", F.col("b.size").alias("size"), F.col("b.number").alias("number"), F.array_sort(F.transform("b.words", lambda w: F.get(ranks, w))).alias("words"))
    prefixes = blocks.withColumn("n", F.size("words")).select("*", F.posexplode(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.col("n") - least_of + 1))).alias("j", "rank"))
    met = prefixes.join(F.broadcast(index), ["size", "rank"]).filter((F.col("n") >= F.col("need")) & (F.col("j") <= F.col("n") - F.col("need")))
    met = met.filter(1 + F.least(F.col("n_template") - 1 - F.col("i"), F.col("n") - 1 - F.col("j")) >= F.col("need"))
    shared = met.withColumn("shared", F.size(F.array_intersect("words", "own"))).filter(F.col("shared") >= F.col("need"))
    # a pair may meet at several prefix words: the same row each time
    return shared.select("rid", "size", "number", "template", "shared", (F.col("shared") / F.col("n_template")).alias("contained"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] = PHRASES, share: Fraction = SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each of ``docs``.

    ``labels``: those of phrases and of the ``templates`` that a block holds by ``share``; ``score``: 1 with a phrase,
    else the largest contained share among these templates, else 0. Each row is judged alone: null and empty texts have
    no words, repeats and null ids stay, other columns are not read, an empty table gives no rows. Memory follows one
    text and PIECE bytes of hashes, whatever its length.
    """
    templates = TEMPLATES if templates is None else templates
    read, vocabulary = read_words(docs, templates, phrases, share)
    read = stage(read.withColumn("rid", F.monotonically_increasing_id()), "license_words")
    names = F.lit([label for label, _ in templates])
    found = join_templates(read, vocabulary, templates, share).groupBy("rid").agg(F.collect_set(F.get(names, F.col("template"))).alias("found"), F.max("contained").alias("best"))
    out = read.select("rid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").join(found, "rid", "left")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    every = F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"), joined(every).alias("labels"), score.alias("score"))


def sql(templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] = PHRASES, share: Fraction = SHARE) -> str:
    """The same over a table ``documents`` in DuckDB: every block against every template of its size."""
    templates = TEMPLATES if templates is None else templates
    lit = lambda w: "'" + w.replace("'", "''") + "'"
    words = lambda x: rf"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    rows = []
    for label, text in templates:
        ws = words_of(text)
        own = sorted(set(ws))
        rows.append(f"({lit(label)}, {block_size(len(ws))}, {needed(len(own), share)}, [{', '.join(map(lit, own))}])")
    spoken = [f"({lit(label)}, [{', '.join(map(lit, words_of(p)))}])" for p, label in phrases]
    return f"""
with t(label, size, need, own) as (values {', '.join(rows)}),
p(label, said) as (values {', '.join(spoken)}),
d as (select row_number() over () as rid, doc_id, {words('text')} as ws from documents),
places as (select rid, label, place from (select rid, ws, label, said, unnest(range(len(ws))) as place from d, p where len(ws) >= len(said)) x where list_slice(ws, place + 1, place + len(said)) = said),
base as (select rid, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from places group by rid),
blocks as (select rid, size, list_distinct(list_slice(ws, k * size + 1, k * size + 2 * size)) as held from (select rid, ws, size, unnest(range(cast(ceil(len(ws) / size) as bigint))) as k from d, (select distinct size from t) s) x),
found as (select rid, list(distinct label) as labels, max(shared / n) as best from (select rid, label, len(own) as n, need, len(list_intersect(held, own)) as shared from blocks join t using (size)) x where shared >= need group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from d left join base using (rid) left join found using (rid)
"""
