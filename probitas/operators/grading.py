"""Grading of parsed answers against the exam's labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import fold, labels_match

LABELS = ["label_modality", "label_plane", "label_tumor_present", "label_laterality", "slice_tumor_present", "slice_laterality", "is_negative_control"]


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds missing columns as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def _value(column: str) -> Column:
    v = fold(F.col(column))
    return F.when(~v.isin("", "nan"), v)


def ground_truth(task: Column) -> Column:
    """The label of a task: slice labels before subject labels; empty where there is none. An image that the
    exam does not list counts as a brain scan without labels."""
    return (
        F.when(task == "T4-TUMOR", F.coalesce(_value("slice_tumor_present"), _value("label_tumor_present"), F.lit("")))
        .when(task == "T5-LAT", F.coalesce(_value("slice_laterality"), _value("label_laterality"), F.lit("")))
        .when(task == "T1-MOD", F.coalesce(_value("label_modality"), F.lit("")))
        .when(task == "T2-PLANE", F.coalesce(_value("label_plane"), F.lit("")))
        .when(task == "T3-ISBRAIN", F.when(F.col("is_negative_control"), "no").otherwise("yes"))
        .when(task == "T7-ABSTAIN", C.UNSURE)
        .otherwise("")
    )


def hallucinates() -> Column:
    """An open answer that claims what the subject's label denies."""
    task, pred = F.col("task"), F.col("pred_answer")
    claims = F.arrays_overlap("asserted_findings", F.array(*[F.lit(x) for x in C.GRADED_FINDINGS]))
    tumor, side = F.lower(F.coalesce("label_tumor_present", F.lit("no"))), F.lower(F.coalesce("label_laterality", F.lit("none")))
    wrong_side = (tumor == "yes") & ~side.isin("unknown", "none") & (pred != side) & ~pred.isin("none", C.UNSURE, C.UNPARSEABLE)
    rule = (
        F.when(task == "T4-TUMOR", (tumor == "no") & claims)
        .when(task == "T5-LAT", ((tumor == "no") & claims) | wrong_side)
        .when(task == "T7-ABSTAIN", claims & (pred != C.UNSURE))
        .otherwise(False)
    )
    return (F.coalesce("format", F.lit("OE")) == "OE") & rule


def grade(parsed: DataFrame, manifest: DataFrame) -> DataFrame:
    """``parsed`` with gt_label, gradeable, correct, answered, hallucination, appropriate_abstention,
    confidently_wrong, conf_frac, is_negative_control.

    A left join on image_id: Spark broadcasts the exam when its statistics allow and shuffles it otherwise. The
    exam must have one row per image.
    """
    exam = ensure_columns(manifest, {c: "int" if c == "is_negative_control" else "string" for c in LABELS}).select("image_id", *LABELS)
    df = parsed.drop(*LABELS).join(exam, "image_id", "left")
    df = df.withColumn("is_negative_control", F.coalesce(F.col("is_negative_control").cast("int") != 0, F.lit(False)))
    df = df.withColumn("gt_label", ground_truth(F.col("task")))
    df = df.withColumns({"gradeable": ~fold(F.col("gt_label")).isin(*C.NO_LABEL), "answered": ~F.col("abstained") & (F.col("pred_answer") != C.UNPARSEABLE)})
    df = df.withColumn("correct", F.col("answered") & labels_match(F.col("pred_answer"), F.col("gt_label")))
    return df.withColumns(
        {
            "hallucination": hallucinates(),
            "appropriate_abstention": F.col("abstained") & (F.col("is_negative_control") | (F.col("task") == "T7-ABSTAIN")),
            "confidently_wrong": (F.coalesce("confidence", F.lit(0)) >= C.HIGH_CONFIDENCE) & F.col("answered") & ~F.col("correct"),
            "conf_frac": F.col("confidence").cast("double") / F.lit(100.0),
        }
    ).drop(*[c for c in LABELS if c != "is_negative_control"])


def duplicated_images(manifest: DataFrame) -> DataFrame:
    """image_ids that an exam lists more than once: must be empty before grading."""
    return manifest.groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1")
