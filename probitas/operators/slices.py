"""Pictures of planes of volumes: each volume is read once for all its planes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import png, resample
from ..session import byte_batches, ship_package

#: The axis that a plane fixes.
PLANES = {"sagittal": 0, "coronal": 1, "axial": 2}
SCHEMA = "image_id string, path string, plane string, slice_frac double, slice_index int, rows int, columns int, raw binary, content binary, provenance string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def windowed(voxels: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """Grey levels of a whole volume: clipped to two percentiles, scaled to 0..255, the fraction cut off; a flat window
    gives zeros."""
    x = voxels.astype(float)
    a, b = np.percentile(x, low), np.percentile(x, high)
    return np.zeros(x.shape, np.uint8) if b <= a else ((np.clip(x, a, b) - a) / (b - a) * 255).astype(np.uint8)


def plane_of(levels: np.ndarray, plane: str, fraction: float) -> tuple[np.ndarray, int]:
    """The picture of a plane and its place: the fraction of the axis, halves to even, within the volume."""
    axis = PLANES[plane]
    at = min(max(int(round(fraction * levels.shape[axis])), 0), levels.shape[axis] - 1)
    return np.take(levels, at, axis), at


def extract(volumes: DataFrame, wanted: DataFrame, side: int = 512, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """SCHEMA rows, one a picture: ``wanted`` (path, image_id, plane, slice_frac) of ``volumes`` (rows of the volume
    source).

    ``raw`` has the plane's grey levels row by row, ``content`` a PNG of ``side`` x ``side`` with its provenance inside.
    The planes asked of a volume are a small list beside its path, so voxels are shuffled at most once; a volume that is
    none, or of which nothing is wanted, gives no picture; nor does a plane that there is not.
    """
    ship_package(volumes.sparkSession)
    byte_batches(volumes.sparkSession)
    planes = wanted.filter(F.col("plane").isin(*PLANES) & F.col("slice_frac").isNotNull()).groupBy("path").agg(F.collect_list(F.struct("image_id", "plane", "slice_frac")).alias("planes"))
    met = volumes.filter(F.col("error").isNull()).join(planes, "path").select("path", "shape", "voxel_size_mm", "sha256_prefix", "data", "planes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, shape, size, prefix = (batch.column(j)[i].as_py() for j in range(4))
                levels = windowed(batch.column(4)[i].values.to_numpy().reshape(shape), low, high)
                rows = []
                for p in sorted(batch.column(5)[i].as_py(), key=lambda p: (p["plane"], p["slice_frac"], p["image_id"] or "")):
                    picture, at = plane_of(levels, p["plane"], p["slice_frac"])
                    note = json.dumps({"image_id": p["image_id"], "plane": p["plane"], "slice_frac": p["slice_frac"], "volume_path": path, "volume_sha256_prefix": prefix, "original_shape": shape, "voxel_size_mm": size, "output_size": [side, side], "original_slice_resolution": f"{picture.shape[1]}x{picture.shape[0]}", "intensity_clip": [low, high]})
                    rows.append((p["image_id"], path, p["plane"], p["slice_frac"], at, *picture.shape, picture.tobytes(), png.encode(resample.letterbox(picture, side, side), note), note))
                kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    return met.mapInArrow(cut, SCHEMA)
