"""Volumes, their source, pictures of planes, and resampling, against plain versions."""

import gzip
import itertools
import json
import math
import struct

import numpy as np
import pytest
from probitas.functions import nifti, png, resample
from probitas.operators import slices
from probitas.sources import volumes
from pyspark.sql import functions as F


def turned(perm, signs, zooms=(1.0, 2.0, 3.0), offset=(-5.0, 7.0, 11.0)):
    affine = np.eye(4)
    affine[:3, :3] = 0
    for axis, (world, sign) in enumerate(zip(perm, signs, strict=True)):
        affine[world, axis] = sign * zooms[axis]
    affine[:3, 3] = offset
    return affine


@pytest.mark.parametrize("perm", list(itertools.permutations(range(3))))
@pytest.mark.parametrize("signs", list(itertools.product((1, -1), repeat=3)))
def test_every_voxel_keeps_its_place_in_the_world(perm, signs):
    voxels, affine = np.arange(24, dtype=np.float32).reshape(2, 3, 4), turned(perm, signs)
    v = nifti.read_volume(nifti.write_volume(voxels, affine))
    assert (np.diag(v.affine)[:3] > 0).all() and np.count_nonzero(v.affine[:3, :3]) == 3
    assert v.codes == "".join("RAS"[w] if s > 0 else "LPI"[w] for w, s in zip(perm, signs, strict=True))
    assert v.zooms == tuple(np.diag(v.affine)[:3])
    back = np.linalg.inv(v.affine)
    for at in np.ndindex(voxels.shape):
        to = tuple(np.rint(back @ affine @ [*at, 1]).astype(int)[:3])
        assert v.voxels[to] == voxels[at]
    same = nifti.read_volume(nifti.write_volume(voxels, affine), canonical=False)
    assert (same.voxels == voxels).all() and (same.affine == affine).all()


def test_oblique_axes_go_to_the_nearest_and_each_once():
    turn = lambda t: np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    affine = np.eye(4)
    affine[:3, :3] = turn(0.6) * [1, 1, 8]
    assert nifti.axis_codes(affine) == "RAS"
    affine[:3, :3] = turn(1.2)
    assert nifti.axis_codes(affine) == "ALS"
    sheared = np.eye(4)
    sheared[:3, :3] = [[1, 0.9, 0.9], [0, 1, 0], [0, 0, 1]]
    assert sorted(w for w, _ in nifti.orientation(sheared)) == [0, 1, 2]


def header(version, order, shape, code, slope=1.0, inter=0.0, qform=0, sform=0, quaternion=(0, 0, 0), offset=(0, 0, 0), rows=None, pixdim=(1, 1, 1, 1), magic=None, ndim=None):
    dims = [ndim or len(shape), *shape, *[1] * (7 - len(shape))]
    rows = np.zeros(12) if rows is None else np.asarray(rows).ravel()
    pix = [*pixdim, *[1] * (8 - len(pixdim))]
    if version == 1:
        h = bytearray(352)
        for kind, at, xs in (("i", 0, [348]), ("8h", 40, dims), ("h", 70, [code]), ("8f", 76, pix), ("3f", 108, [352, slope, inter]), ("2h", 252, [qform, sform]), ("3f", 256, quaternion), ("3f", 268, offset), ("12f", 280, rows)):
            struct.pack_into(order + kind, h, at, *xs)
        h[344:348] = magic or b"n+1\0"
    else:
        h = bytearray(544)
        for kind, at, xs in (("i", 0, [540]), ("h", 12, [code]), ("8q", 16, dims), ("8d", 104, pix), ("q", 168, [544]), ("2d", 176, [slope, inter]), ("2i", 344, [qform, sform]), ("3d", 352, quaternion), ("3d", 376, offset), ("12d", 400, rows)):
            struct.pack_into(order + kind, h, at, *xs)
        h[4:12] = magic or b"n+2\0\r\n\x1a\n"
    return bytes(h)


@pytest.mark.parametrize("version,order", [(1, "<"), (1, ">"), (2, "<"), (2, ">")])
@pytest.mark.parametrize("code", nifti.DATA_TYPES)
def test_headers_and_voxel_types(version, order, code):
    x = np.arange(6).reshape(1, 2, 3)
    raw = header(version, order, (1, 2, 3, 1, 1), code, 0.5, -1, sform=1, rows=np.eye(4)[:3]) + x.astype(order + nifti.DATA_TYPES[code]).tobytes(order="F")
    for content in (raw, gzip.compress(raw)):
        v = nifti.read_volume(content)
        assert v.voxels.dtype == np.float32 and (v.voxels == x * 0.5 - 1).all() and v.codes == "RAS"
    plain = nifti.read_volume(header(version, order, (1, 2, 3), code, math.nan, 5) + x.astype(order + nifti.DATA_TYPES[code]).tobytes(order="F"))
    assert sorted(plain.voxels.ravel()) == list(range(6)) and plain.codes == "LAS"  # no matrix: x is flipped


def test_quaternions():
    half = math.sqrt(0.5)
    data = np.zeros((2, 3, 4), "<f4").tobytes()
    for q, fac, codes in (((0, 0, 0), 1, "RAS"), ((0, 0, 0), -1, "RAI"), ((0, 0, half), 1, "ALS"), ((1, 0, 0), 1, "RPI"), ((0, half, 0), -1, "IAL")):
        v = nifti.read_volume(header(1, "<", (2, 3, 4), 16, qform=1, quaternion=q, offset=(4, 5, 6), pixdim=(fac, 2, 3, 4)) + data, canonical=False)
        assert v.codes == codes and np.allclose(np.linalg.norm(v.affine[:3, :3], axis=0), [2, 3, 4]) and v.affine[:3, 3].tolist() == [4, 5, 6]


@pytest.mark.parametrize("content", [b"", b"x" * 400, gzip.compress(b"x" * 400), gzip.compress(b"y" * 4000)[:30], header(1, "<", (2, 2, 2), 16), header(1, "<", (2, 2, 2, 3), 16) + bytes(96), header(1, "<", (2, 2, 2), 128) + bytes(64), header(1, "<", (2, 2, 2), 16, magic=b"ni1\0") + bytes(32), header(1, "<", (2, 0, 2), 16), header(2, "<", (1, 1, 1), 2)[:400]])
def test_what_is_no_volume(content):
    with pytest.raises(nifti.NotAVolume):
        nifti.read_volume(content)


# --- the source
@pytest.fixture
def folder(spark, tmp_path):
    volumes.register(spark)
    rng = np.random.default_rng(3)
    made = {}
    for i, perm in enumerate(itertools.permutations(range(3))):
        x, affine = rng.normal(size=(3, 4, 5)).astype(np.float32), turned(perm, (1, -1, 1))
        name = f"s{i % 2}/v{i}.nii.gz"
        (tmp_path / f"s{i % 2}").mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(nifti.write_volume(x, affine))
        made[name] = nifti.to_canonical(x, affine)[0]
    (tmp_path / "s1/plain.nii").write_bytes(nifti.write_volume(x, affine, zipped=False))
    made["s1/plain.nii"] = nifti.to_canonical(x, affine)[0]
    (tmp_path / "notes.txt").write_text("none")
    (tmp_path / ".hidden.nii").write_text("none")
    return tmp_path, made


def read(spark, path, **options):
    return spark.read.format("nifti").options(**options).load(str(path))


def test_reading_a_folder(spark, folder):
    path, made = folder
    for df in (read(spark, path), read(spark, path, bytesPerTask=1), volumes.read_volumes(spark, str(path)).filter("error is null")):
        rows = {r["path"].split(path.name + "/")[1]: r for r in df.collect()}
        assert rows.keys() == made.keys()
        for name, x in made.items():
            assert tuple(rows[name]["shape"]) == x.shape and rows[name]["data"] == x.ravel().tolist() and len(rows[name]["sha256_prefix"]) == 16
    assert read(spark, path, bytesPerTask=1).rdd.getNumPartitions() == 7 and read(spark, path).rdd.getNumPartitions() == 1
    heads = {r["path"]: r for r in read(spark, path, voxels="false").collect()}
    for r in read(spark, path).collect():
        head = heads[r["path"]]
        assert head["data"] is None and all(head[c] == r[c] for c in ("shape", "voxel_size_mm", "affine", "axes", "sha256_prefix"))
    assert read(spark, path, pattern="v3*").count() == 1 and read(spark, path / "s1/plain.nii").count() == 1 and read(spark, path / "absent").count() == 0


def test_broken_files(spark, folder):
    path, made = folder
    (path / "broken.nii.gz").write_bytes(b"\x1f\x8bnothing")
    rows = [r for r in read(spark, path).collect() if r["error"]]
    assert len(rows) == 1 and rows[0]["path"].endswith("broken.nii.gz") and rows[0]["data"] is None
    assert read(spark, path, mode="dropmalformed").count() == len(made)
    with pytest.raises(Exception, match="broken"):
        read(spark, path, mode="failfast").count()
    assert volumes.read_volumes(spark, str(path), mode="DROPMALFORMED").filter("path like '%broken.nii%'").isEmpty()


def test_writing_and_overwriting(spark, tmp_path):
    volumes.register(spark)
    path = tmp_path / "out"
    one = lambda names: spark.createDataFrame([(n, [1, 2, 2], np.eye(4).ravel().tolist(), [1.0, 2.0, 3.0, float(i)]) for i, n in enumerate(names)], "name string, shape array<int>, affine array<double>, data array<float>").repartition(3)
    one(["a", "b", "c"]).write.format("nifti").mode("append").save(str(path))
    one(["c", "d"]).write.format("nifti").mode("append").save(str(path))
    names = lambda: sorted(p.name for p in path.iterdir())
    assert names() == ["a.nii.gz", "b.nii.gz", "c.nii.gz", "d.nii.gz"]
    assert {r["path"][-8]: r["data"][3] for r in read(spark, path).collect()} == {"a": 0, "b": 1, "c": 0, "d": 1}
    with pytest.raises(Exception, match="names no file"):
        one(["x", "../y"]).write.format("nifti").mode("overwrite").save(str(path))
    assert names() == ["a.nii.gz", "b.nii.gz", "c.nii.gz", "d.nii.gz"]  # a failed job leaves what was there
    one(["e"]).write.format("nifti").mode("overwrite").save(str(path))
    assert names() == ["e.nii.gz"]


# --- pictures
def test_slices(spark, folder):
    path, made = folder
    v = read(spark, path)
    asked = [("axial", 0.5), ("axial", 0.5), ("sagittal", 0.0), ("coronal", 1.0), ("axial", 9.0), ("diagonal", 0.5), ("axial", None)]
    wanted = v.select("path").crossJoin(spark.createDataFrame([(f"i{i}", *a) for i, a in enumerate(asked)], "image_id string, plane string, slice_frac double"))
    (path / "broken.nii.gz").write_bytes(b"none")
    rows = slices.extract(read(spark, path), wanted, side=16).collect()
    assert len(rows) == 5 * len(made)
    for r in rows:
        x = slices.windowed(made[r["path"].split(path.name + "/")[1]])
        axis, n = {"sagittal": (0, x.shape[0]), "coronal": (1, x.shape[1]), "axial": (2, x.shape[2])}[r["plane"]]
        at = min(max(round(r["slice_frac"] * n), 0), n - 1)
        picture = np.take(x, at, axis)
        assert r["slice_index"] == at and (r["rows"], r["columns"]) == picture.shape and bytes(r["raw"]) == picture.tobytes()
        grey, note = png.decode(bytes(r["content"]))
        note = json.loads(note)
        assert (grey == resample.letterbox(picture, 16, 16)).all() and note["original_shape"] == list(x.shape) and note["image_id"] == r["image_id"] and note["output_size"] == [16, 16]


def test_notes_of_pictures(spark):
    made = png.encode(np.zeros((3, 5), np.uint8), "für \0 alle")
    df = spark.createDataFrame([(1, bytearray(made)), (2, bytearray(b"none")), (3, None), (4, bytearray(png.encode(np.zeros((1, 1), np.uint8))))], "id int, c binary")
    got = {r["id"]: tuple(r["n"]) for r in df.select("id", png.png_note(F.col("c")).alias("n")).collect()}
    assert got == {1: (5, 3, "für \0 alle"), 2: (None, None, None), 3: (None, None, None), 4: (1, 1, "")}


def test_windows():
    x = np.arange(101, dtype=np.float32)
    assert slices.windowed(x).tolist() == [int((min(max(v, 1), 99) - 1) / 98 * 255) for v in range(101)]
    assert not slices.windowed(np.full((2, 2, 2), 7, np.float32)).any()


# --- resampling
def convolved(line, new):
    """One line of another length, pixel by pixel."""
    size, step = len(line), len(line) / new
    wide, out = max(1.0, step), []
    for o in range(new):
        middle, total, weight = (o + 0.5) * step, 0.0, 0.0
        for i in range(max(0, int(middle - 3 * wide + 0.5)), min(size, int(middle + 3 * wide + 0.5))):
            u = (i + 0.5 - middle) / wide
            k = 0.0 if abs(u) >= 3 else 1.0 if u == 0 else math.sin(math.pi * u) / (math.pi * u) * math.sin(math.pi * u / 3) / (math.pi * u / 3)
            total, weight = total + k * line[i], weight + k
        out.append(min(max(math.floor(total / weight + 0.5), 0), 255))
    return out


@pytest.mark.parametrize("shape,new", [((7, 9), (21, 5)), ((30, 40), (9, 12)), ((3, 50), (3, 11)), ((1, 1), (4, 6)), ((12, 12), (12, 12)), ((5, 300), (2, 128))])
def test_resize_is_the_convolution(shape, new):
    x = np.random.default_rng(sum(shape)).integers(0, 256, shape).astype(np.uint8)
    wide = [convolved(row, new[1]) if new[1] != shape[1] else list(row) for row in x.tolist()]
    want = np.array([convolved(column, new[0]) if new[0] != shape[0] else column for column in zip(*wide, strict=True)]).T
    got = resample.resize(x, *new).astype(int)
    assert got.shape == new and np.abs(got - want).max() <= 1 and (got == want).mean() > 0.99


def test_flat_pictures_stay_flat_and_edges_ring():
    assert (resample.resize(np.full((9, 9), 200, np.uint8), 31, 4) == 200).all()
    edge = np.repeat(np.array([[0, 255]], np.uint8), 8, axis=1)
    assert resample.weights(16, 160).min() < -0.05 and resample.resize(edge, 1, 160).max() == 255


def test_letterbox(spark):
    x = np.full((4, 8), 9, np.uint8)
    box = resample.letterbox(x, 16, 16)
    assert box.shape == (16, 16) and (box[4:12] == 9).all() and not box[:4].any() and not box[12:].any()
    assert resample.letterbox(np.ones((1, 100), np.uint8), 10, 10).sum() == 10
    df = spark.createDataFrame([(1, [9] * 32, 4, 8), (2, [9] * 31, 4, 8), (3, None, 4, 8), (4, [], 0, 0), (5, [1], None, 1)], "id int, p array<int>, r int, c int")
    got = {r["id"]: r["b"] for r in df.select("id", resample.letterboxed(F.col("p"), F.col("r"), F.col("c"), 16).alias("b")).collect()}
    assert got == {1: box.ravel().tolist(), 2: None, 3: None, 4: None, 5: None}


def test_letterboxed_in_pieces(spark, monkeypatch):
    """Pictures come back in pieces of bounded size, of several sizes beside each other and with those that are none."""
    monkeypatch.setattr(resample, "PIECE", 4 * 16 * 16 * 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 256, 24).tolist() if i % 5 else None, 4 if i % 2 else 3, 6 if i % 2 else 8) for i in range(20)] + [(20, [1, 2], 4, 6)]
    df = spark.createDataFrame(rows, "id int, p array<int>, r int, c int").coalesce(1)
    made = resample.letterboxed(F.col("p"), F.col("r"), F.col("c"), 16)
    got = {r["id"]: r["b"] for r in df.select("id", made.alias("b")).collect()}
    for i, p, r, c in rows:
        want = resample.letterbox(np.array(p).reshape(r, c), 16, 16).ravel().tolist() if p and len(p) == r * c else None
        assert got[i] == want
