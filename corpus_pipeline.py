"""A training corpus from raw documents: language, near copies, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.llm import decontam, jaccard, langid, packing, pii
from probitas.llm.common import set_aside, stage
from probitas.session import ship_package, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, no letter, nothing labelled); lang becomes the predicted one.

    Each row is judged alone: repeats, ties and null ids stay as they are; other columns pass through, whatever
    their names. An empty table stays empty."""
    slim, restore = set_aside(docs, ["doc_id", "text", "lang"])
    out = langid.identify(slim).filter(F.col("lang_pred") != "und")
    return restore(out.withColumn("lang", F.col("lang_pred")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets alike to 0.8 or more: the smallest doc_id.

    Null and wordless texts are like none and stay, as do null ids; a row that repeats entirely stays once; other
    texts of one doc_id are judged apart. Columns pass through; an empty table stays empty."""
    return jaccard.keep_one(docs, k=5, share=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: 0.8 of its five-word shingles, anywhere in the whole text.

    Null texts, null ids and, where the benchmark is empty, all rows stay; repeats are judged alike; columns pass
    through."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars, where there is one, follows the new text.

    A null text stays null; no row goes; other columns pass through, whatever their names."""
    slim, restore = set_aside(docs, ["doc_id", "text", "n_chars"])
    out = pii.scan(slim, rewrite=True)
    return restore(out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 4096 ids; a null text is its end id alone, repeated rows are packed each,
    other columns are not read."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]

#: SQL has no tokenizer, no classifier and no packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
