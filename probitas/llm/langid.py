"""Hierarchical language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import broadcast_if_small, stage
from .hashing import U

#: Families of common language codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Features: hashed counts of 1- to 4-byte strings of the lower-cased text.
BINS = 4096
ORDERS = (1, 2, 3, 4)
#: At most so many labelled documents per language are learnt from, those of the smallest hash of their id.
TRAIN_PER_LANG = 300
#: Parts in which the sample of a language is picked first: its last step reads at most SALTS * TRAIN_PER_LANG rows.
SALTS = 64
LETTER = re.compile(r"[^\W\d_]")
_SALT = [U(x) for x in (0x8F1BBCDC, 0x5A827999, 0x6ED9EBA1, 0xCA62C1D6)]


def features(text: str) -> np.ndarray:
    """The text's unit vector of square-rooted n-gram shares; the whole text is read."""
    a = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
    total = np.zeros(BINS)
    gram = np.zeros(len(a), np.uint64)
    for k in ORDERS:
        if len(a) < k:
            break
        gram = (gram[: len(a) - k + 1] << U(8)) | a[k - 1 :]
        bins = ((gram + _SALT[k - 1]) * U(0x9E3779B97F4A7C15)) >> U(64 - 12)
        total += np.bincount(bins.view(np.int64), minlength=BINS) / (len(a) - k + 1)
    out = np.sqrt(total)
    return out / (np.linalg.norm(out) or 1)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 1000, settled: float = 2e-3) -> tuple[np.ndarray, float]:
    """A linear SVM of squared hinge loss by accelerated gradient steps; y is +1 or -1, classes weigh alike. It ends when
    the gradient has fallen to the share ``settled`` of the first one (at the latest after ``steps``)."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y = y.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate, first = np.float32(1 / (1 / c + 2 * 2.0)), None
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = v / np.float32(c) - 2 * ((weight * y * slack) @ x)
        size = float(np.linalg.norm(gradient))
        first = first or size
        if size <= settled * first:
            w = v
            break
        new = v - rate * gradient
        v = new + np.float32(step / (step + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


class Model:
    """Family scorers (one against the rest), and one scorer for each pair of languages in a family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        family = [FAMILY_OF.get(lang, lang) for lang in langs]
        self.families = sorted(set(family))
        self.members = {f: [lang for lang in self.langs if FAMILY_OF.get(lang, lang) == f] for f in self.families}
        f, one = np.array(family), np.array(langs)
        self.family_svm = [fit_svm(x, np.where(f == k, 1.0, -1.0)) for k in self.families] if len(self.families) > 1 else []
        self.pair_svm = {}
        for k in self.families:
            for a, b in combinations(self.members[k], 2):
                use = (one == a) | (one == b)
                self.pair_svm[a, b] = fit_svm(x[use], np.where(one[use] == a, 1.0, -1.0))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """The language, and the product of the family's share and the language's share of its pairs' votes."""
        sure = lambda w: float(1 / (1 + np.exp(-np.clip(4 * (v @ w[0] + w[1]), -50, 50))))
        p, family = 1.0, self.families[0] if self.families else ""
        if self.family_svm:
            each = [sure(w) for w in self.family_svm]
            best = int(np.argmax(each))
            family, p = self.families[best], each[best] / sum(each)
        members = self.members[family]
        if len(members) == 1:
            return members[0], p
        votes = dict.fromkeys(members, 0.0)
        for (a, b), w in self.pair_svm.items():
            if a in votes:
                s = sure(w)
                votes[a] += s
                votes[b] += 1 - s
        lang = max(members, key=lambda m: votes[m])
        return lang, p * votes[lang] / (len(members) - 1)


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model | None:
    """Learn from documents with text and lang whose crc32(doc_id as text) mod 4 is not 2.

    The sample is bounded by ``per_lang`` documents a language, those of the smallest hash of (doc_id, text
    length), picked in two steps so that a language of most rows is not one task's work. Executors make the
    feature vectors; the driver gets 16 KB a sampled document. None where nothing is labelled.
    """
    salt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)).cast("int")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"), salt.alias("_salt"))
    for keys in (["lang", "_salt"], ["lang"]):
        ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))).filter(F.col("_n") <= per_lang)
    ids = stage(ids.select("doc_id", F.col("lang").alias("_lang")).distinct(), "sample")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[bool(LETTER.search(t)) for t in b["text"]]]
            yield pd.DataFrame({"lang": b["lang"], "doc_id": b["doc_id"], "v": [features(t).astype(np.float32).tobytes() for t in b["text"]]})

    sampled = docs.select("doc_id", "lang", "text").join(broadcast_if_small(ids), (docs.doc_id == ids.doc_id) & (docs.lang == ids._lang), "left_semi")
    got = sampled.filter(F.col("text").isNotNull()).mapInPandas(vectors, "lang string, doc_id long, v binary").dropDuplicates(["lang", "doc_id"]).toPandas().sort_values(["lang", "doc_id"])
    if not len(got):
        return None
    return Model(np.stack([np.frombuffer(v, np.float32) for v in got["v"]]).astype(np.float64), list(got["lang"]))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred and score.

    Trains first where no model is given. A null text, one without a letter, or a corpus without labels gives
    ``und`` with score 0. A null doc_id is not held out and not learnt from. Rows are independent: repeats,
    long texts and hot sources cost no shuffle; empty tables give an empty result; columns of the new names
    are replaced, others pass through.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    model = model or train(docs)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                lang, score = ("und", 0.0) if model is None or not t or not LETTER.search(t) else model.predict(features(t))
                langs.append(lang)
                scores.append(score)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(each, schema).withColumn("held_out", held_out(F.col("doc_id")))
