"""Fixed schemas of the relations."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()), "doubles": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(n, kinds[t]) for n, t in (x.split() for x in ddl.split(","))])


PROVENANCE = _struct(
    "image_id string, subject_id string, dataset string, modality string, plane string, slice_frac double, volume_path string, volume_sha256_prefix string,"
    "original_shape ints, voxel_size_mm doubles, output_size ints, original_slice_resolution string, intensity_clip doubles, path string,"
    "is_negative_control boolean, negative_control_type string, label_tumor_present string, label_modality string, label_plane string, label_laterality string, resolution string"
)
MANIFEST = _struct(
    "image_id string, path string, dataset string, subject_id string, modality string, plane string, slice_frac double, label_modality string, label_plane string,"
    "label_tumor_present string, label_laterality string, label_lobe string, demo_sex string, demo_age double, is_negative_control int, resolution string,"
    "slice_tumor_present string, slice_tumor_area_px int, slice_tumor_area_frac double, slice_laterality string"
)
PROMPTS = _struct(
    "prompt_id string, image_id string, task string, phrasing string, format string, prompt_text string, system_prompt string, mc_options strings, mc_option_order ints, mc_correct_letter string, image_path string"
)
RESPONSES = _struct(
    "model string, image_id string, prompt_id string, task string, phrasing string, format string, mc_options strings, mc_option_order ints, mc_correct_letter string, image_path string, response string, gen_seconds double, timestamp_utc string"
)
REGISTRY = _struct("id string, label string, tier string, backend string, family string, params_b double, optional boolean, ablation_only boolean")
