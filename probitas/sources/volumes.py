"""Volumes as a data source: ``spark.read.format("nifti")`` and ``df.write.format("nifti")``.

    register(spark)
    volumes = spark.read.format("nifti").load("/scans")

A file becomes a row: its voxels turned to right, front and top, x slowest and z fastest, its shape, matrix, voxel
sizes, the axes as stored, and the hash prefix that provenance carries. A volume is one task's work at a time; files are
dealt to tasks by their bytes. Options of reading: ``pattern`` (a file name pattern, ``*.nii*``), ``bytesPerTask``
(128 MiB), ``canonical`` (true), ``voxels`` (true; false reads headers only), ``mode`` (PERMISSIVE: files that are none have an
``error``; DROPMALFORMED: they are left out; FAILFAST: they stop the job).

The source opens paths itself, by PyArrow's file systems. For stores that only Spark can open, `read_volumes` decodes
what the binary file reader brings, to the same rows.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import nifti
from ..session import byte_batches, ship_package

SCHEMA = "path string, shape array<int>, voxel_size_mm array<double>, affine array<double>, axes string, sha256_prefix string, data array<float>, error string"
ARROW = pa.schema([("path", pa.string()), ("shape", pa.list_(pa.int32())), ("voxel_size_mm", pa.list_(pa.float64())), ("affine", pa.list_(pa.float64())), ("axes", pa.string()), ("sha256_prefix", pa.string()), ("data", pa.list_(pa.float32())), ("error", pa.string())])
HEADER_BYTES, PREFIX_BYTES = 1024, 65536


def decode(path: str, content: bytes, canonical: bool = True, voxels: bool = True) -> dict:
    """The row of a file; ``error`` and nulls where it is no volume."""
    row = dict.fromkeys(ARROW.names) | {"path": path, "sha256_prefix": hashlib.sha256(content[:PREFIX_BYTES]).hexdigest()[:16]}
    try:
        if voxels:
            v = nifti.read_volume(content, canonical)
            shape, affine, zooms, codes, data = v.voxels.shape, v.affine, v.zooms, v.codes, np.ascontiguousarray(v.voxels).ravel()
        else:
            head = nifti.read_header(nifti.unzipped(content, HEADER_BYTES))
            codes, shape, affine, zooms, data = nifti.axis_codes(head.affine), head.shape, head.affine, head.zooms, None
            if canonical and codes != "RAS":
                small, affine = nifti.to_canonical(np.broadcast_to(np.float32(0), head.shape), head.affine)
                shape, zooms = small.shape, tuple(float(np.float32(x)) for x in np.linalg.norm(affine[:3, :3], axis=0))
    except nifti.NotAVolume as error:
        return row | {"error": str(error)}
    return row | {"shape": list(shape), "voxel_size_mm": list(zooms), "affine": affine.ravel().tolist(), "axes": codes, "data": data}


def _batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in ARROW], schema=ARROW)


def _accepted(row: dict, mode: str) -> bool:
    if row["error"] and mode == "FAILFAST":
        raise nifti.NotAVolume(f"{row['path']}: {row['error']}")
    return not (row["error"] and mode == "DROPMALFORMED")


def _store(path: str):  # noqa: ANN202
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if re.match("file:", path) or "://" not in path:
        return fs.LocalFileSystem(), "/" + re.sub("^file:/*", "", path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def _listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under ``path`` whose name fits, in order; hidden folders are passed over."""
    from pyarrow import fs

    store, top = _store(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.File:
        return [(top, info.size)]
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True))
    visible = lambda p: not any(x.startswith((".", "_")) for x in posixpath.relpath(p, top).split("/"))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(x.path), pattern) and visible(x.path))


@dataclass
class Files(InputPartition):
    paths: list[str]


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        get = lambda name, default: str(options.get(name, default)).lower()
        self.pattern, self.mode, self.most = options.get("pattern", "*.nii*"), get("mode", "permissive").upper(), int(get("bytesPerTask", 128 << 20))
        self.canonical, self.voxels = get("canonical", "true") == "true", get("voxels", "true") == "true"

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for path, n in _listed(self.path, self.pattern):
            if held and size + n > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)] if held else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)[0]
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as f:
                content = f.read() if self.voxels else f.read(PREFIX_BYTES)
            row = decode(path, content, self.canonical, self.voxels)
            if _accepted(row, self.mode):
                yield _batch(row)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class VolumeWriter(DataSourceArrowWriter):
    """Rows of (name, shape, affine, data) become gzipped files ``<name>.nii.gz``. A task writes to a hidden folder of its
    own; when all have ended, the files are moved, and ``overwrite`` removes the older ones then. A failed job leaves
    what was there."""

    written = "*.nii.gz"

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.path)
        folder, names = f"{top}/.volumes-{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                if not re.fullmatch(r"[^/.][^/]*", row["name"] or ""):
                    raise ValueError(f"{row['name']!r} names no file")
                voxels = np.array(row["data"], np.float32).reshape(row["shape"])
                with store.open_output_stream(f"{folder}/{row['name']}.nii.gz", compression=None) as f:
                    f.write(nifti.write_volume(voxels, np.array(row["affine"], float).reshape(4, 4)))
                names.append(f"{row['name']}.nii.gz")
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for path, _ in _listed(self.path, self.written):
                store.delete_file(path)
        for m in done:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, top = _store(self.path)
        if store.get_file_info(f"{top}/.volumes-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/.volumes-{self.job}")


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:  # noqa: ANN001
        return VolumeReader(self.options)

    def writer(self, schema, overwrite: bool) -> VolumeWriter:  # noqa: ANN001
        return VolumeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(VolumeSource)


def read_volumes(spark: SparkSession, path: str, pattern: str = "*.nii*", canonical: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """The same rows from any store that Spark reads; a file is at most 2 GB."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decode_files(files.select("path", "content"), canonical, mode)


def decode_files(files: DataFrame, canonical: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of SCHEMA from (path, content)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                row = decode(path.as_py(), content.as_py() or b"", canonical)
                if _accepted(row, mode):
                    yield _batch(row)

    byte_batches(files.sparkSession)
    return files.select("path", F.col("content").cast("binary")).mapInArrow(rows, SCHEMA)
