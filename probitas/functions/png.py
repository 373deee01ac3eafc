"""Grey pictures as PNG with a note inside, and back: the standard library's zlib is all that it takes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type; the last of two or four is alpha.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
LUMA = np.array([0.299, 0.587, 0.114])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, note: str = "") -> bytes:
    """An 8-bit grey picture of ``pixels`` (height x width); a ``note`` goes into a text chunk named provenance."""
    height, width = pixels.shape
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = pixels
    text = _chunk(b"iTXt", b"provenance\0\0\0\0\0" + note.encode()) if note else b""
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + text + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def chunks(content: bytes) -> list[tuple[bytes, bytes]]:
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    out, at = [], len(SIGNATURE)
    while at + 12 <= len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        out.append((kind, content[at + 8 : at + 8 + n]))
        at += 12 + n
    return out


def _unfilter(data: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes, each led by its filter's number, to plain rows."""
    out = np.zeros((len(data), data.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.int64)
    for row, line in zip(out, data, strict=True):
        kind, x = int(line[0]), line[1:].astype(np.int64)
        if kind == 1:
            for c in range(step):
                x[c::step] = np.cumsum(x[c::step])
        elif kind == 2:
            x += above
        elif kind in (3, 4):
            for i in range(len(x)):
                a, b, c = (x[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                x[i] = (x[i] + guess) & 255
        row[:] = above = x & 255
    return out


def decode(content: bytes) -> tuple[np.ndarray, str]:
    """Grey pixels (height x width) and note of a PNG of eight bits a channel without interlacing."""
    parts = chunks(content)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError(f"a PNG of depth {depth}, colour type {colour}, interlacing {interlaced}")
    step = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8).reshape(height, width * step + 1)
    x = _unfilter(raw, step).reshape(height, width, step)
    grey = x[:, :, 0] if step < 3 else np.round(x[:, :, :3] @ LUMA).astype(np.uint8)
    note = next((b.split(b"\0", 5)[-1].decode() for k, b in parts if k == b"iTXt" and b.startswith(b"provenance\0")), "")
    return grey, note


def to_png(pixels: Column, width: Column, note: Column) -> Column:
    """PNG bytes of an array of 0 to 255, row by row; null where the pixels are null or no whole rows."""

    @F.pandas_udf("binary")
    def make(pixels: pd.Series, width: pd.Series, note: pd.Series) -> pd.Series:
        whole = [p is not None and w == w and w > 0 and len(p) > 0 and len(p) % int(w) == 0 for p, w in zip(pixels, width, strict=True)]
        return pd.Series([encode(np.asarray(p, np.uint8).reshape(-1, int(w)), n or "") if ok else None for ok, p, w, n in zip(whole, pixels, width, note, strict=True)])

    return make(pixels, width, note)


def from_png(content: Column) -> Column:
    """struct(width, height, pixels, note) of PNG bytes; its fields are null where they are none that can be read."""

    @F.pandas_udf("width int, height int, pixels array<int>, note string")
    def read(content: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for body in content:
            try:
                grey, note = decode(bytes(body))
                rows.append((grey.shape[1], grey.shape[0], grey.ravel().astype(np.int32), note))
            except (TypeError, ValueError, KeyError, struct.error, zlib.error):  # no picture
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "pixels", "note"]).astype({"width": "Int32", "height": "Int32"})

    return read(content)


def png_note(content: Column) -> Column:
    """struct(width, height, note) of PNG bytes, without their pixels; null fields where they are none."""

    @F.pandas_udf("width int, height int, note string")
    def read(content: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for body in content:
            try:
                parts = dict(chunks(bytes(body)))
                width, height = struct.unpack_from(">II", parts[b"IHDR"])
                text = parts.get(b"iTXt", b"")
                rows.append((width, height, text.split(b"\0", 5)[-1].decode() if text.startswith(b"provenance\0") else ""))
            except (TypeError, ValueError, KeyError, struct.error):  # no picture
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "note"]).astype({"width": "Int32", "height": "Int32"})

    return read(content)
