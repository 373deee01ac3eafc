"""Pictures of another size by a windowed sinc: two products with banded matrices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights are multiples of 2 ** -22: products with levels add up exactly, in any order.
PLACES = 1 << 22
#: The kernel reaches so many pixels of the coarser picture to either side.
LOBES = 3
#: Pictures are given back in pieces of so many bytes, one picture at least: a worker's memory follows them.
PIECE = 4 << 20


def kernel(x: np.ndarray) -> np.ndarray:
    """sinc(x) sinc(x / LOBES) within LOBES, else nothing."""
    return np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)


@lru_cache(maxsize=256)
def weights(size: int, new: int) -> np.ndarray:
    """new x size: how much each old pixel counts for each new one. Rows sum to one, but for rounding; when the picture shrinks, the
    kernel widens as much, so that every old pixel counts."""
    step = size / new
    wide = max(1.0, step)
    middle = (np.arange(new) + 0.5) * step
    first = np.maximum((middle - LOBES * wide + 0.5).astype(int), 0)
    end = np.minimum((middle + LOBES * wide + 0.5).astype(int), size)
    at = np.arange(size)
    inside = (at >= first[:, None]) & (at < end[:, None])
    out = np.where(inside, kernel((at + 0.5 - middle[:, None]) / wide), 0.0)
    return np.floor(out / out.sum(axis=1, keepdims=True) * PLACES + 0.5) / PLACES


def _levels(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Grey levels of pictures (the last two axes) of another size: along rows, rounded to levels, then along columns."""
    rows, columns = pixels.shape[-2:]
    wide = pixels.astype(float) if columns == width else _levels(pixels @ weights(columns, width).T)
    return (wide if rows == height else _levels(weights(rows, height) @ wide)).astype(np.uint8)


def letterbox(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture (or each of several of one size) as large as it fits, its shape kept, in the middle of a black one."""
    rows, columns = pixels.shape[-2:]
    scale = min(width / columns, height / rows)
    w, h = max(1, int(columns * scale)), max(1, int(rows * scale))
    out = np.zeros((*pixels.shape[:-2], height, width), np.uint8)
    top, left = (height - h) // 2, (width - w) // 2
    out[..., top : top + h, left : left + w] = resize(pixels, h, w)
    return out


def letterboxed(pixels: Column, rows: Column, columns: Column, side: int) -> Column:
    """A square of ``side`` from an array of 0 to 255, row by row; null where the pixels are not rows x columns."""

    def piece(pixels: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
        out, alike = [None] * len(pixels), {}
        for i, (p, r, c) in enumerate(zip(pixels, rows, columns, strict=True)):
            if p is not None and r == r and c == c and r > 0 and c > 0 and len(p) == r * c:
                alike.setdefault((int(r), int(c)), []).append((i, np.asarray(p)))
        for (r, c), found in alike.items():
            boxes = letterbox(np.stack([p for _, p in found]).reshape(-1, r, c), side, side).reshape(-1, side * side).astype(np.int32)
            for (i, _), box in zip(found, boxes, strict=True):
                out[i] = box
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<int>")
    def make(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        step = max(1, PIECE // (4 * side * side))
        for batch in batches:
            for i in range(0, len(batch[0]), step):
                yield piece(*(x.iloc[i : i + step] for x in batch))

    return make(pixels, rows, columns)
