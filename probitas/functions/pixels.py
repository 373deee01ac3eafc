"""Slices, windows and masks on array columns; batches of arrays go through Arrow only where NumPy must."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def slice_index(fraction: Column, size: Column) -> Column:
    """The plane's index: fraction of the size, halves to even, clipped to the volume."""
    return F.greatest(F.lit(0), F.least(F.bround(fraction * size).cast("int"), size - 1)).cast("int")


def percentile(values: Column, q: float) -> Column:
    """The linear-interpolation percentile (0 to 100) of an array."""
    s = F.array_sort(values)
    at = (F.size(values) - 1) * (q / 100.0)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(values) - 1))
    return a.cast("double") + (b.cast("double") - a.cast("double")) * (at - low)


def window_to_bytes(values: Column, low: float = 1.0, high: float = 99.0) -> Column:
    """Clip to the percentile window, scale to 0..255 and cut off the fraction; a flat window gives zeros."""
    bounds = F.array(F.struct(percentile(values, low).alias("a"), percentile(values, high).alias("b")))

    def scaled(w: Column) -> Column:
        each = lambda v: F.floor((F.greatest(w["a"], F.least(w["b"], v.cast("double"))) - w["a"]) / (w["b"] - w["a"]) * 255).cast("int")
        return F.when(w["b"] > w["a"], F.transform(values, each)).otherwise(F.transform(values, lambda v: F.lit(0)))

    return F.element_at(F.transform(bounds, scaled), 1)


def plane_slice(volume: Column, shape: Column, plane: Column, index: Column) -> Column:
    """A plane of a volume stored x-major (x, y, z): axial fixes z, sagittal x, coronal y; else null."""
    nx, ny, nz = (F.get(shape, F.lit(i)) for i in range(3))
    grid = lambda outer, inner, at: F.flatten(F.transform(F.sequence(F.lit(0), outer - 1), lambda i: F.transform(F.sequence(F.lit(0), inner - 1), lambda j: F.get(volume, at(i, j).cast("int")))))
    return (
        F.when(plane == "axial", grid(nx, ny, lambda x, y: (x * ny + y) * nz + index))
        .when(plane == "sagittal", grid(ny, nz, lambda y, z: (index * ny + y) * nz + z))
        .when(plane == "coronal", grid(nx, nz, lambda x, z: (x * ny + index) * nz + z))
    )


def letterbox(pixels: Column, rows: Column, columns: Column, side: int) -> Column:
    """A square of ``side`` with the picture in its middle, scaled by nearest pixels, zeros around."""
    scale = F.lit(float(side)) / F.greatest(rows, columns)
    h, w = (F.greatest(F.lit(1), F.bround(x * scale).cast("int")) for x in (rows, columns))
    top, left = F.floor((F.lit(side) - h) / 2).cast("int"), F.floor((F.lit(side) - w) / 2).cast("int")

    def at(k: Column) -> Column:
        r, c = F.floor(k / side).cast("int") - top, (k % side).cast("int") - left
        inside = (r >= 0) & (r < h) & (c >= 0) & (c < w)
        source = F.floor(r * rows / h).cast("int") * columns + F.floor(c * columns / w).cast("int")
        return F.when(inside, F.get(pixels, source.cast("int"))).otherwise(F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), at)


def area_px(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda v: v > 0))


def side_share(mask: Column, x_of, middle: Column) -> tuple[Column, Column]:
    """Mask pixels with x above the middle, and all mask pixels; ``x_of`` gives x from a pixel's index."""
    right = F.aggregate(F.transform(mask, lambda v, i: F.when((v > 0) & (x_of(i) > middle), 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    return right, area_px(mask)


def laterality(right: Column, total: Column) -> Column:
    """right or left from the share of a side, else bilateral; none without a mask, unknown without pixels."""
    share = right.cast("double") / total
    return F.when(total.isNull(), "unknown").when(total == 0, "none").when(share >= C.SIDE_SHARE, "right").when(1 - share >= C.SIDE_SHARE, "left").otherwise("bilateral")


def slice_laterality(plane: Column, index: Column, middle: Column, right: Column, total: Column) -> Column:
    """In a sagittal plane the plane's own place decides."""
    sagittal = F.when(total.isNull(), "unknown").when(total == 0, "none").when(index > middle, "right").otherwise("left")
    return F.when(plane == "sagittal", sagittal).otherwise(laterality(right, total))


def area_threshold(present: Column, area: Column, side: Column, least: int = C.AREA_THRESHOLD_PX) -> tuple[Column, Column]:
    """(present, laterality) where too small an area counts as none; the area itself is kept by callers."""
    small = (present == "yes") & (area < least)
    return F.when(small, "no").otherwise(present), F.when(small, "none").otherwise(side)
