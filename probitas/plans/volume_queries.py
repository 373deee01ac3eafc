"""Registered queries of volumes and pictures: vectors are written as volumes of all orientations and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import png, resample
from ..operators import slices
from ..session import scratch_folder
from ..sources import volumes
from . import fixtures
from .queries import query

#: A volume holds 64 vectors; its axes as stored are vector, and the rows and columns of a vector's 4 x 16 numbers.
VECTORS, ROWS, COLUMNS = 64, 4, 16
ZOOMS = (1.5, 2.0, 3.0)
#: By volume number: the world axis of each stored axis, and which of them run backwards.
TURNS = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


def _write(spark, sf_dir) -> str:
    path, e = scratch_folder(spark, "volumes"), fixtures.table(spark, sf_dir, "embeddings")
    v = e.groupBy(F.floor(F.col("vec_id") / VECTORS).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("vec_id") % VECTORS).cast("int"), "embedding"))).alias("m"))
    blank = F.array_repeat(F.lit(0.0).cast("float"), ROWS * COLUMNS)
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(VECTORS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), blank)))
    turn = F.element_at(F.lit([list(t) for t in TURNS]), (F.col("v") % 6 + 1).cast("int"))
    sign = lambda a: F.when(F.shiftright((F.floor(F.col("v") / 6) % 8).cast("int"), a) % 2 == 1, -1.0).otherwise(1.0)
    cell = lambda world, a: F.when(F.get(turn, F.lit(a)) == world, sign(a) * ZOOMS[a]).otherwise(0.0)
    affine = F.array(*[x for world in range(3) for x in (*(cell(world, a) for a in range(3)), F.lit(-10.0 * (world + 1)))], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    volumes.register(spark)
    rows = v.select(F.concat(F.lit("v"), F.col("v").cast("string")).alias("name"), F.lit([VECTORS, ROWS, COLUMNS]).alias("shape"), affine.alias("affine"), data.alias("data"))
    rows.write.format("nifti").mode("append").save(path)
    return path


def _number():
    return F.regexp_extract("path", r"v([0-9]+)\.nii\.gz$", 1).cast("long")



#: The voxels as stored, with their places after turning: world axis by world axis.
VOXELS = f"""
t(p, a0, a1, a2) as (values {', '.join(f'({i}, {a}, {b}, {c})' for i, (a, b, c) in enumerate(TURNS))}),
n as (select v, a0, a1, a2, v // 6 % 8 as f from (select distinct vec_id // {VECTORS} as v from embeddings) x join t on t.p = v % 6),
s as (select *, case when a0 = 0 then {VECTORS} when a1 = 0 then {ROWS} else {COLUMNS} end as nx, case when a0 = 1 then {VECTORS} when a1 = 1 then {ROWS} else {COLUMNS} end as ny, case when a0 = 2 then {VECTORS} when a1 = 2 then {ROWS} else {COLUMNS} end as nz from n),
raw as (select s.*, i, j, k, coalesce(embedding[j * {COLUMNS} + k + 1], 0)::double as value from s, range({VECTORS}) a(i), range({ROWS}) b(j), range({COLUMNS}) c(k) left join embeddings on vec_id = v * {VECTORS} + i),
placed as (select *, case when f & 1 = 1 then {VECTORS - 1} - i else i end as q0, case when f & 2 = 2 then {ROWS - 1} - j else j end as q1, case when f & 4 = 4 then {COLUMNS - 1} - k else k end as q2 from raw),
vox as (select v, f, a0, a1, a2, nx, ny, nz, value, case when a0 = 0 then q0 when a1 = 0 then q1 else q2 end as x, case when a0 = 1 then q0 when a1 = 1 then q1 else q2 end as y, case when a0 = 2 then q0 when a1 = 2 then q1 else q2 end as z from placed)"""

_LETTER = lambda a: f"case when f & {1 << a} = 0 then substr('RAS', a{a} + 1, 1) else substr('LPI', a{a} + 1, 1) end"
_ZOOM = lambda w: f"case when a0 = {w} then {ZOOMS[0]} when a1 = {w} then {ZOOMS[1]} else {ZOOMS[2]} end::double"


@query(
    f"""with {VOXELS} select v as volume, nx, ny, nz, {_ZOOM(0)} as dx, {_ZOOM(1)} as dy, {_ZOOM(2)} as dz, {_LETTER(0)} || {_LETTER(1)} || {_LETTER(2)} as axes,
    sum(floor(value * 10000)::bigint * (1 + x + 100 * y + 10000 * z))::bigint as placed from vox group by v, f, a0, a1, a2, nx, ny, nz"""
)
def volume_round_trip(spark, sf_dir):
    """Shape, voxel sizes, stored axes, and a sum that depends on each voxel's place, of every volume."""
    v = spark.read.format("nifti").load(_write(spark, sf_dir))
    ny, nz = F.get("shape", F.lit(1)), F.get("shape", F.lit(2))
    at = lambda i: 1 + F.floor(i / (ny * nz)) + 100 * (F.floor(i / nz) % ny) + 10000 * (i % nz)
    placed = F.aggregate(F.transform("data", lambda x, i: F.floor(x.cast("double") * 10000) * at(i)), F.lit(0).cast("long"), lambda a, x: a + x)
    size = lambda i: F.get("voxel_size_mm", F.lit(i))
    return v.select(_number().alias("volume"), F.get("shape", F.lit(0)).cast("long").alias("nx"), ny.cast("long").alias("ny"), nz.cast("long").alias("nz"), size(0).alias("dx"), size(1).alias("dy"), size(2).alias("dz"), "axes", placed.alias("placed"))


CUTS = [("axial", 0.5), ("sagittal", 0.25), ("coronal", 0.6)]


@query(
    f"""with {VOXELS},
    w as (select v, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from vox group by v),
    level as (select v, nx, ny, nz, x, y, z, case when hi > lo then floor((least(greatest(value, lo), hi) - lo) / (hi - lo) * 255)::bigint else 0 end as g from vox join w using (v)),
    cut as (select v, 'axial' as plane, round(0.5 * nz)::int as slice_index, z as place, nx as rows, ny as columns, x as r, y as c, g from level
      union all select v, 'sagittal', round(0.25 * nx)::int, x, ny, nz, y, z, g from level union all select v, 'coronal', round(0.6 * ny)::int, y, nx, nz, x, z, g from level)
    select v as volume, plane, slice_index, rows, columns, sum(g * (r * columns + c + 1))::bigint as placed, columns::varchar || 'x' || rows::varchar as resolution, 512::bigint as width from cut where place = slice_index group by v, plane, slice_index, rows, columns"""
)
def volume_slices(spark, sf_dir):
    """Three planes of every volume: grey levels in place, and what the picture's file says of itself."""
    v = spark.read.format("nifti").load(_write(spark, sf_dir))
    wanted = v.select("path", F.explode(F.array(*[F.struct(F.lit(p).alias("plane"), F.lit(x).alias("slice_frac")) for p, x in CUTS])).alias("c"))
    wanted = wanted.select("path", F.concat(F.lit("v"), _number().cast("string")).alias("image_id"), "c.plane", "c.slice_frac")
    s = slices.extract(v, wanted).withColumn("picture", png.png_note(F.col("content")))
    level = lambda i: F.conv(F.hex(F.substring("raw", i, F.lit(1))), 16, 10).cast("long") * i
    placed = F.aggregate(F.transform(F.sequence(F.lit(1), F.length("raw")), level), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select(_number().alias("volume"), "plane", "slice_index", F.col("rows").cast("long").alias("rows"), F.col("columns").cast("long").alias("columns"), placed.alias("placed"), F.get_json_object("picture.note", "$.original_slice_resolution").alias("resolution"), F.col("picture.width").cast("long").alias("width"))


SIDES = (12, 40)
LEVEL = "floor(abs({0}) * 1000)::bigint % 256"


@query(
    f"""with side(side) as (values {', '.join(f'({s})' for s in SIDES)}),
    axis as (select side, 'r' as axis, {ROWS} as size, greatest(1, floor({ROWS} * (side / {float(COLUMNS)}))::int) as new from side union all select side, 'c', {COLUMNS}, side from side),
    w0 as (select side, axis, o, i, size / new::double as step, (o + 0.5) * (size / new::double) as middle, greatest(1.0, size / new::double) as wide, size from axis, range(200) a(o), range({COLUMNS}) b(i) where o < new and i < size),
    w1 as (select side, axis, o, i, (i + 0.5 - middle) / wide as u from w0 where i >= greatest(floor(middle - 3 * wide + 0.5), 0) and i < least(floor(middle + 3 * wide + 0.5), size)),
    w2 as (select side, axis, o, i, case when abs(u) >= 3 then 0.0 when u = 0 then 1.0 else sin(pi() * u) / (pi() * u) * sin(pi() * u / 3) / (pi() * u / 3) end as w from w1),
    w as (select side, axis, o, i, floor(w / sum(w) over (partition by side, axis, o) * 4194304 + 0.5) / 4194304 as w from w2),
    px as (select vec_id, r, c, {LEVEL.format(f'embedding[r * {COLUMNS} + c + 1]::double')} as g from embeddings, range({ROWS}) a(r), range({COLUMNS}) b(c)),
    h as (select vec_id, side, r, o as c, least(greatest(floor(sum(g * w) + 0.5), 0), 255) as g from px join w on axis = 'c' and i = c group by vec_id, side, r, o),
    v as (select vec_id, h.side, o as r, c, least(greatest(floor(sum(g * w) + 0.5), 0), 255) as g from h join w on w.side = h.side and axis = 'r' and i = r group by vec_id, h.side, o, c)
    select vec_id, side, sum(g * (1 + (r + (side - new) // 2) * side + c))::bigint as placed from v join axis using (side) where axis = 'r' group by vec_id, side"""
)
def letterbox_sinc(spark, sf_dir):
    """Every vector as a picture of 4 x 16 levels, shrunk to 3 x 12 and enlarged to 10 x 40, in a square."""
    e = fixtures.table(spark, sf_dir, "embeddings")
    p = e.select("vec_id", F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 256).cast("int")).alias("p"))
    out = None
    for side in SIDES:
        box = resample.letterboxed(F.col("p"), F.lit(ROWS), F.lit(COLUMNS), side)
        placed = F.aggregate(F.transform("box", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
        part = p.select("vec_id", F.lit(side).alias("side"), box.alias("box")).select("vec_id", "side", placed.alias("placed"))
        out = part if out is None else out.unionByName(part)
    return out
