"""Reproducible samples, first rows of keys, and top rows: by hash order, so any engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hash_order
from ..functions.text import wrap

AUDIT_BLANKS = ["human_pred_answer", "human_confidence", "human_abstained", "human_findings", "parser_agrees_answer", "parser_agrees_confidence", "parser_agrees_abstain", "human_notes"]


def random_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: a top-n of hashes, so no full sort."""
    order = hash_order(seed, *[F.col(k).cast("string") for k in keys])
    return df.withColumn("_o", order).orderBy("_o", *keys).limit(n).drop("_o")


def stratified_sample(df: DataFrame, n: int, strata: list[str], keys: list[str], seed: int = 42) -> DataFrame:
    """An equal number of rows of each stratum, one at least, and ``n`` in all at most."""
    strata_count = df.select(*strata).distinct().agg(F.count("*")).scalar()
    order = hash_order(seed, *[F.col(k).cast("string") for k in keys])
    ranked = df.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", *keys))).filter(F.col("_n") <= n)
    picked = ranked.filter(F.col("_n") <= F.greatest(F.lit(1), F.floor(F.lit(n) / strata_count)))
    return picked.orderBy("_n", "_o").limit(n).drop("_o", "_n")


def audit_sheet(sample: DataFrame, columns: list[str], blanks: list[str] | None = None) -> DataFrame:
    """The listed columns that there are, and empty ones for a reader to fill."""
    return sample.select(*[c for c in columns if c in sample.columns], *[F.lit("").alias(c) for c in (AUDIT_BLANKS if blanks is None else blanks)])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key; ties are the caller's to order away."""
    by = [F.desc(c) for c in order] if last else [F.asc(c) for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def subsample_subjects(df: DataFrame, subject: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of ``n`` subjects; of all subjects where there are no more."""
    chosen = random_sample(df.select(subject).distinct(), n, [subject], seed)
    return df.join(chosen, subject, "left_semi")


def top_rows(df: DataFrame, by: list[str], k: int, descending: bool = False) -> DataFrame:
    first, *rest = by
    return df.orderBy(F.desc(first) if descending else F.asc(first), *rest).limit(k)


def failure_gallery(graded: DataFrame, n: int = 6, seed: int = 42) -> DataFrame:
    """Confidently wrong open answers; wrong ones where there are none; some of each task, ``n`` in all."""
    open_ = graded.filter((F.col("format") == "OE") & F.col("response").isNotNull())
    sure = open_.filter("confidently_wrong")
    any_sure = sure.agg(F.count("*") > 0).scalar()
    pool = open_.filter(F.when(any_sure, F.col("confidently_wrong")).otherwise(~F.col("correct")))
    return stratified_sample(pool, n, ["task"], ["model", "prompt_id"], seed)


def caption(response: Column, width: int = 58, lines: int = 5) -> Column:
    """A statement under a picture: its first lines, or a note that there is none."""
    return F.coalesce(F.nullif(F.array_join(wrap(response, width, lines), "\n"), F.lit("")), F.lit("(no statement)"))


def noise_example(graded: DataFrame) -> DataFrame:
    """The surest claim that a noise picture is a brain scan; noise by its path first, then any control."""
    pool = graded.filter(F.col("is_negative_control") & (F.col("task") == "T3-ISBRAIN") & (F.col("pred_answer") == "yes") & F.col("confidence").isNotNull())
    noisy = F.lower("image_path").rlike("noise|gaussian|salt")
    return pool.orderBy(noisy.desc(), F.desc("confidence"), "model", "prompt_id").limit(1)
