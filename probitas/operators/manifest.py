"""The labelled exam from slice provenance, demographics and segmentation labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.pixels import area_threshold
from ..schemas import MANIFEST
from .grading import ensure_columns
from .sampling import first_per_key

SLICE_COLUMNS = ["slice_tumor_present", "slice_tumor_area_px", "slice_tumor_area_frac", "slice_laterality"]


def build(provenance: DataFrame, demographics: DataFrame | None = None, subject_laterality: DataFrame | None = None, slices: DataFrame | None = None, area_px: int = C.AREA_THRESHOLD_PX) -> DataFrame:
    """One row per image with the exam's columns.

    Controls have no tumour; tumour datasets take laterality from ``subject_laterality`` (subject_id,
    laterality; unknown where missing), healthy ones have none; others keep their own labels. Rows without id
    or path go; of repeated ids the first by (path, subject) stays. Side tables join on their key.
    """
    p = ensure_columns(provenance, {"is_negative_control": "boolean", "label_tumor_present": "string", "label_modality": "string", "label_plane": "string", "label_laterality": "string", "label_lobe": "string", "resolution": "string", "slice_frac": "double"})
    people = demographics if demographics is not None else p.limit(0).select("subject_id", F.lit("").alias("demo_sex"), F.lit(0.0).alias("demo_age"))
    sides = subject_laterality if subject_laterality is not None else p.limit(0).select("subject_id", F.lit("").alias("laterality"))
    control = F.coalesce("is_negative_control", F.lit(False))
    kind = F.when(control, "control").when(F.col("dataset") == "brats", "tumor").when(F.col("dataset").isin("ixi", "oasis"), "healthy").otherwise("other")
    own = lambda c: F.coalesce(c, F.lit("unknown"))
    df = first_per_key(p.filter("image_id is not null and path is not null"), ["image_id"], ["path", "subject_id"])
    df = df.join(people.dropDuplicates(["subject_id"]), "subject_id", "left").join(sides.dropDuplicates(["subject_id"]), "subject_id", "left").withColumn("_kind", kind)
    df = df.withColumns(
        {
            "label_modality": F.when(F.col("_kind").isin("tumor", "healthy"), F.col("modality")).otherwise(own("label_modality")),
            "label_plane": F.when(F.col("_kind").isin("tumor", "healthy"), F.col("plane")).otherwise(own("label_plane")),
            "label_tumor_present": F.when(F.col("_kind") == "tumor", "yes").when(F.col("_kind").isin("healthy", "control"), "no").otherwise(own("label_tumor_present")),
            "label_laterality": F.when(F.col("_kind") == "tumor", F.coalesce("laterality", F.lit("unknown"))).when(F.col("_kind").isin("healthy", "control"), "none").otherwise(own("label_laterality")),
            "demo_sex": F.when(F.col("_kind") == "healthy", F.col("demo_sex")),
            "demo_age": F.when(F.col("_kind") == "healthy", F.col("demo_age")),
            "is_negative_control": control.cast("int"),
        }
    ).drop("_kind", "laterality")
    df = with_slice_labels(df, slices, area_px) if slices is not None else ensure_columns(df, {f.name: f.dataType.simpleString() for f in MANIFEST.fields if f.name in SLICE_COLUMNS})
    return df.select(*MANIFEST.names)


def with_slice_labels(manifest: DataFrame, slices: DataFrame, area_px: int = C.AREA_THRESHOLD_PX) -> DataFrame:
    """``manifest`` with slice labels by image_id, anew each time; images without one are unknown, with area -1.
    ``slices``: image_id, slice_tumor_present, slice_tumor_area_px, slice_tumor_area_frac, slice_laterality."""
    found = slices.select("image_id", *SLICE_COLUMNS).dropDuplicates(["image_id"])
    df = manifest.drop(*SLICE_COLUMNS).join(found, "image_id", "left")
    present, side = area_threshold(F.coalesce("slice_tumor_present", F.lit("unknown")), F.coalesce("slice_tumor_area_px", F.lit(-1)), F.coalesce("slice_laterality", F.lit("unknown")), area_px)
    return df.withColumns({"slice_tumor_present": present, "slice_laterality": side, "slice_tumor_area_px": F.coalesce("slice_tumor_area_px", F.lit(-1)).cast("int")})


def slice_labels(mask: Column) -> tuple[Column, Column, Column]:
    """(present, area, fraction to six digits) of a mask; unknown without one."""
    from ..functions.pixels import area_px

    area = area_px(mask)
    fraction = F.round(area.cast("double") / F.size(mask), 6)
    return F.when(mask.isNull(), "unknown").when(area > 0, "yes").otherwise("no"), F.coalesce(F.when(mask.isNotNull(), area), F.lit(-1)).cast("int"), F.when(mask.isNotNull() & (F.size(mask) > 0), fraction)


def expand_slices(volumes: DataFrame, planes: list[str], fractions: list[float]) -> DataFrame:
    """Each volume by plane and fraction: literal arrays are exploded, nothing is joined."""
    return volumes.withColumn("plane", F.explode(F.array(*[F.lit(p) for p in planes]))).withColumn("slice_frac", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))


def composition(manifest: DataFrame) -> DataFrame:
    """Images, subjects, modalities, planes and tumour counts by dataset."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # a label has few values
    return (
        manifest.filter("dataset is not null")
        .groupBy("dataset")
        .agg(
            F.count("*").alias("n_images"), F.countDistinct("subject_id").alias("n_subjects"), listed("label_modality").alias("modalities"),
            F.count(F.when(F.col("label_tumor_present") == "yes", 1)).alias("tumor_yes"), F.count(F.when(F.col("label_tumor_present") == "no", 1)).alias("tumor_no"), listed("label_plane").alias("planes"),
        )
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
