"""Volumes of the NIfTI format: header, affine, reorientation, voxels. NumPy and the standard library."""

from __future__ import annotations

import gzip
import struct
import zlib
from dataclasses import dataclass

import numpy as np

# --- fixed values of the format ----------------------------------------------------------------------------------
DATA_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER_SIZES = {348: 1, 540: 2}
AXES = ("LR", "PA", "IS")
# -----------------------------------------------------------------------------------------------------------------


class NotAVolume(ValueError):
    """Bytes that are no volume that can be read."""


@dataclass
class Header:
    shape: tuple[int, int, int]
    dtype: np.dtype
    offset: int
    slope: float
    intercept: float
    affine: np.ndarray  # 4 x 4, from voxel numbers to millimetres, right, front and top positive
    zooms: tuple[float, float, float]


def unzipped(content: bytes, most: int | None = None) -> bytes:
    """The bytes of a file that may be gzipped; ``most`` of them, or all."""
    if content[:2] != b"\x1f\x8b":
        return content if most is None else content[:most]
    try:
        if most is None:
            return gzip.decompress(content)
        return zlib.decompressobj(31).decompress(content, most)
    except (OSError, EOFError, zlib.error) as error:
        raise NotAVolume(f"broken gzip: {error}") from error


def _rotation(b: float, c: float, d: float) -> np.ndarray:
    """The rotation of the unit quaternion whose last three parts are given."""
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    q = np.array([a, b, c, d])
    if a == 0:
        q = q / max(np.linalg.norm(q), 1e-300)
    a, b, c, d = q
    return np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])


def _affine(sform: int, rows: np.ndarray, qform: int, quaternion: tuple, offset: tuple, qfac: float, zooms: np.ndarray, shape: tuple) -> np.ndarray:
    """The matrix of the sform if it has a code, else of the qform, else one with its middle at zero and x flipped."""
    out = np.eye(4)
    if sform > 0:
        out[:3] = rows
    elif qform > 0:
        out[:3, :3] = _rotation(*quaternion) * (zooms * [1, 1, -1 if qfac < 0 else 1])
        out[:3, 3] = offset
    else:
        out[:3, :3] = np.diag(zooms * [-1, 1, 1])
        out[:3, 3] = -out[:3, :3] @ ((np.array(shape) - 1) / 2)
    return out


def read_header(raw: bytes) -> Header:
    """The header of unzipped bytes, of version 1 or 2 and either byte order; volumes of three axes, further ones of one."""
    if len(raw) < 348:
        raise NotAVolume("too short for a header")
    order = next((o for o in "<>" if struct.unpack(o + "i", raw[:4])[0] in HEADER_SIZES), None)
    if order is None:
        raise NotAVolume("no header of a known size")
    version = HEADER_SIZES[struct.unpack(order + "i", raw[:4])[0]]
    if len(raw) < (348, 540)[version - 1] or (raw[344:348] != b"n+1\0" if version == 1 else raw[4:8] != b"n+2\0"):
        raise NotAVolume("no volume with its voxels in the same file")
    get = lambda kind, at: struct.unpack_from(order + kind, raw, at)
    if version == 1:
        dim, (code,), pixdim, (offset, slope, intercept) = get("8h", 40), get("h", 70), get("8f", 76), get("3f", 108)
        (qform, sform), quaternion, place, rows = get("2h", 252), get("3f", 256), get("3f", 268), get("12f", 280)
    else:
        (code,), dim, pixdim, (offset,), (slope, intercept) = get("h", 12), get("8q", 16), get("8d", 104), get("q", 168), get("2d", 176)
        (qform, sform), quaternion, place, rows = get("2i", 344), get("3d", 352), get("3d", 376), get("12d", 400)
    n = dim[0]
    if not 1 <= n <= 7 or any(d < 1 for d in dim[1 : n + 1]) or any(d != 1 for d in dim[4 : n + 1]):
        raise NotAVolume(f"axes {dim[1 : max(n, 0) + 1]} are not those of a volume")
    if code not in DATA_TYPES:
        raise NotAVolume(f"voxels of type {code}")
    shape = tuple(int(d) for d in (*dim[1 : min(n, 3) + 1], 1, 1))[:3]
    zooms = np.abs(np.array(pixdim[1:4], float))
    if not np.isfinite(slope) or slope == 0:
        slope, intercept = 1.0, 0.0
    affine = _affine(sform, np.reshape(rows, (3, 4)), qform, quaternion, place, pixdim[0], zooms, shape)
    return Header(shape, np.dtype(order + DATA_TYPES[code]), int(offset), float(slope), float(intercept), affine, tuple(zooms.tolist()))


def orientation(affine: np.ndarray) -> list[tuple[int, int]]:
    """For each voxel axis the world axis that it runs along most, and 1 or -1 for its direction.

    The nearest rotation of the matrix decides, so that shears and unequal voxels do not; axes choose in the order of
    how clearly they lie along one world axis, and each world axis is taken once."""
    m = affine[:3, :3]
    size = np.linalg.norm(m, axis=0)
    m = m / np.where(size > 0, size, 1)
    u, s, v = np.linalg.svd(m)
    keep = s > s.max() * 3 * np.finfo(float).eps
    turn = u[:, keep] @ v[keep]
    out = [(-1, 1)] * 3
    free = np.ones(3, bool)
    for axis in np.argsort(-np.abs(turn).max(axis=0), kind="stable"):
        column = np.where(free, np.abs(turn[:, axis]), -1)
        world = int(np.argmax(column))
        free[world] = False
        out[axis] = (world, -1 if turn[world, axis] < 0 else 1)
    return out


def axis_codes(affine: np.ndarray) -> str:
    """The letters that the voxel axes point to, such as LPS."""
    return "".join(AXES[world][sign > 0] for world, sign in orientation(affine))


def to_canonical(voxels: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Voxels with their axes turned to right, front and top, and the matrix of the turned volume: axes are swapped
    and flipped, nothing is interpolated."""
    axes = orientation(affine)
    turn = np.zeros((4, 4))  # from new voxel numbers to old ones
    turn[3, 3] = 1
    for axis, (world, sign) in enumerate(axes):
        turn[axis, world] = sign
        if sign < 0:
            turn[axis, 3] = voxels.shape[axis] - 1
            voxels = np.flip(voxels, axis)
    return np.transpose(voxels, np.argsort([world for world, _ in axes])), affine @ turn


@dataclass
class Volume:
    voxels: np.ndarray  # x, y, z; single precision
    affine: np.ndarray
    zooms: tuple[float, float, float]
    codes: str  # the axes as stored


def read_volume(content: bytes, canonical: bool = True) -> Volume:
    """A volume of a file's bytes, its axes turned to right, front and top unless ``canonical`` is false.

    Voxels are scaled by the header's slope and intercept. Voxel sizes are the header's where no axis is turned, else
    the lengths of the turned matrix's columns."""
    raw = unzipped(content)
    head = read_header(raw)
    count = int(np.prod(head.shape))
    if len(raw) < head.offset + count * head.dtype.itemsize:
        raise NotAVolume("fewer voxels than the header says")
    voxels = np.frombuffer(raw, head.dtype, count, head.offset).reshape(head.shape, order="F")
    voxels = voxels.astype(np.float32) if (head.slope, head.intercept) == (1, 0) else (voxels * np.float64(head.slope) + head.intercept).astype(np.float32)
    codes, affine, zooms = axis_codes(head.affine), head.affine, head.zooms
    if canonical and codes != "RAS":
        voxels, affine = to_canonical(voxels, head.affine)
        zooms = tuple(float(np.float32(x)) for x in np.linalg.norm(affine[:3, :3], axis=0))
    return Volume(voxels, affine, zooms, codes)


def write_volume(voxels: np.ndarray, affine: np.ndarray, zipped: bool = True) -> bytes:
    """The file of a volume, version 1, little-endian, with the matrix as its sform; equal input gives equal bytes."""
    code = next((k for k, v in DATA_TYPES.items() if np.dtype("<" + v) == voxels.dtype.newbyteorder("<")), None)
    if code is None or voxels.ndim != 3 or max(voxels.shape) > 32767:
        raise ValueError(f"voxels of type {voxels.dtype} and shape {voxels.shape}")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *voxels.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, 8 * voxels.dtype.itemsize)
    struct.pack_into("<8f", head, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0), 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + voxels.astype(voxels.dtype.newbyteorder("<")).tobytes(order="F")
    return gzip.compress(raw, 6, mtime=0) if zipped else raw
