"""The corpus pipeline, stage by stage, against plain versions; the contract of its module."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from probitas.llm import packing, pii, queries, tokens
from test_operators import components_of, sets_of, words
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def folder(spark, texts, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(*r, len(r[1] or "")) for r in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_run(texts, items):
    """(doc_id, text) that the last stage packs."""
    docs = [r for r in texts if r[1] and re.search(r"[^\W\d_]", r[1])]
    sets, seen, kept = sets_of(docs, 5), set(), []
    for row, (d, _), c in zip(docs, sets, components_of(sets, 80), strict=True):
        if d is None or (d == c and row not in seen):
            kept.append(row)
        seen.add(row)

    def shingles(t):
        ws = words((t or "").lower())
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    wanted = [s for _, t in items if (s := shingles(t))]
    clean = [r for r in kept if r[0] is None or not any(100 * len(q & shingles(r[1])) >= 80 * len(q) for q in wanted)]
    return [(r[0], pii.redact(r[1], pii.find_spans(r[1])[1])) for r in clean]


def test_stages(spark, folder, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontaminate", "personal_data", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        sizes.append(docs.count())
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = plain_run(texts, items)
    assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(want)
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())


def test_run(spark, folder, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    t = Tokenizer.from_file(tokens.default_path())
    want = Counter((d, len(t.encode(x, add_special_tokens=False).ids) + 1) for d, x in plain_run(texts, items))
    out = corpus_pipeline.run(spark, folder).collect()
    got = Counter()
    for r in out:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == Counter({k: k[1] * n for k, n in want.items()})


def test_run_on_nothing(spark, none, sf, tmp_path):
    none.selectExpr("doc_id", "text", "lang", "source", "0L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_stages_keep_foreign_columns(spark, folder):
    """Columns named like the operators' own come back as they went in, by every stage that returns documents."""
    from pyspark.sql import functions as F

    names = ["score", "held_out", "lang_pred", "spans", "n_email", "n_added", "key", "_key", "_rest", "component", "n_shingles", "item_id"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 40").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == docs.count()


def test_texts_are_read_in_small_batches(spark, folder):
    """A column of a batch is one array of an executor's heap: 4096 whole texts were one."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(key)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.STAGES[0][1](spark, docs, folder).count()
    assert int(spark.conf.get(key)) <= 256
    spark.conf.set(key, "100")
    corpus_pipeline.STAGES[0][1](spark, docs, folder).count()
    assert spark.conf.get(key) == "100"
    spark.conf.unset(key)


def test_packing_numbers_few_texts_together(texts, monkeypatch):
    """What a packing worker holds follows TEXT_BYTES, not the whole batch; the ids are the same."""
    bodies = [t for _, t, *_ in texts] * 3
    tok = tokens.WordTokenizer(tokens.default_path())
    want = [x.tolist() for x in tok.ids_of(bodies)]
    held, numbered = [], tokens.WordTokenizer.numbered

    def noted(self, spaced):
        held.append(sum(map(len, spaced)))
        return numbered(self, spaced)

    class Docs:
        """Takes the function that a task would run."""

        def select(self, *columns):
            return self

        def mapInArrow(self, each, schema):
            self.each = each
            return self

    monkeypatch.setattr(tokens.WordTokenizer, "numbered", noted)
    monkeypatch.setattr(packing, "stage", lambda df, name: df)
    monkeypatch.setattr(packing, "TEXT_BYTES", 20_000)
    each = packing.tokenised(Docs(), tokens.default_path(), 2, packing.Router([])).each
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int64()), pa.array(part, pa.string())], ["doc_id", "text"]) for part in (bodies[:100], bodies[100:])]
    got = [np.frombuffer(b, tok.kind).tolist() for out in each(iter(batches)) for b in out.column(3).to_pylist() if b is not None]
    assert got == [[*w, 2] for w in want]
    assert max(held) <= 20_000 + max(len(tok.spaced(b)) for b in bodies)
