"""Readers of responses, exams, demographics and volumes; every schema is fixed, none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..schemas import MANIFEST, RESPONSES

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = RESPONSES, strict: bool = False) -> DataFrame:
    """JSON lines: blank lines are none; malformed ones are dropped, or with ``strict`` stop the job. A missing
    path gives an empty table."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", mode).json(path)


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType = RESPONSES) -> DataFrame:
    """The lines that are not JSON of the schema, with their file."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed[CORRUPT].alias(CORRUPT), "file").filter(F.col(CORRUPT).isNotNull())


def read_all_responses(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """All *.jsonl of a folder, as UNION ALL. With ``ordered``: a column ord by file name, then line."""
    df = read_jsonl(spark, f"{folder.rstrip('/')}/*.jsonl")
    if not ordered:
        return df
    return df.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line")).alias("ord"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The exam as CSV with a header, or Parquet; NaN becomes null."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(MANIFEST).option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, t in df.dtypes if t == "double"})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().upper() for c in df.columns])


def ixi_demographics(table: DataFrame) -> DataFrame:
    """(subject_id, demo_sex, demo_age) from columns IXI_ID, SEX_ID (1 M, 2 F), AGE in any case; none without ids."""
    t = normalise_headers(table)
    if "IXI_ID" not in t.columns:
        return table.sparkSession.createDataFrame([], "subject_id string, demo_sex string, demo_age double")
    sex = next((c for c in t.columns if c.startswith("SEX")), None)
    code = F.col(f"`{sex}`").try_cast("int") if sex else F.lit(None).cast("int")
    age = F.col("AGE").try_cast("double") if "AGE" in t.columns else F.lit(None).cast("double")
    number = F.col("IXI_ID").try_cast("int")
    return t.filter(number.isNotNull()).select(F.format_string("IXI%03d", number).alias("subject_id"), F.when(code == 1, "M").when(code == 2, "F").alias("demo_sex"), age.alias("demo_age"))


def oasis_demographics(table: DataFrame) -> DataFrame:
    """(subject_id, demo_sex, demo_age): the id column is ID, else the first; sex is M/F, else SEX."""
    t = normalise_headers(table)
    key = "ID" if "ID" in t.columns else t.columns[0]
    sex = next((c for c in ("M/F", "SEX") if c in t.columns), None)
    age = F.col("AGE").try_cast("double") if "AGE" in t.columns else F.lit(None).cast("double")
    return t.select(F.col(f"`{key}`").cast("string").alias("subject_id"), (F.col(f"`{sex}`") if sex else F.lit(None)).cast("string").alias("demo_sex"), age.alias("demo_age"))


def list_volumes(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all *.nii.gz under ``root``; contents are not read. A missing root gives none."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.nii.gz").option("recursiveFileLookup", "true").load(root).select("path")


def read_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _base(path):
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.nii(\.gz)?$", "")


def discover(paths: DataFrame, dataset: str, strict_subjects: bool = False) -> DataFrame:
    """(subject_id, path, modality) of the volumes in ``paths``, in order of subject and modality.

    ``strict_subjects``: the folder names the subject. Else the last part of the path that looks like a subject
    does, and that is the file itself where its name does.
    """
    path, name = F.col("path"), _base(F.col("path"))
    if dataset == "brats":
        low = F.lower(name)
        modality = F
        for suffix, label in C.VOLUME_SUFFIXES.items():
            modality = modality.when(low.endswith(suffix) | low.contains("-" + suffix) | low.contains("_" + suffix), label)
        parts = F.split(path, "/")
        if strict_subjects:
            parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
        like = F.filter(F.reverse(parts), lambda p: p.rlike(r"(?i)^BraTS.*\d{5}"))
        subject = F.coalesce(F.try_element_at(like, F.lit(1)), F.try_element_at(F.split(path, "/"), F.lit(-2)))
        df = paths.filter(~low.contains("seg")).select(subject.alias("subject_id"), "path", modality.alias("modality"))
    elif dataset == "ixi":
        modality = F
        for key in ("T1", "T2", "PD", "MRA"):
            modality = modality.when(name.contains("-" + key), key)
        modality = modality.when(name.contains("-DTI"), "DWI")
        df = paths.select(F.substring_index(name, "-", 1).alias("subject_id"), "path", modality.alias("modality"))
    elif dataset == "oasis":
        df = paths.select(F.substring_index(name, "_", 1).alias("subject_id"), "path", F.lit("T1").alias("modality"))
    else:
        df = paths.select(F.lit(None).cast("string").alias("subject_id"), "path", F.lit(None).cast("string").alias("modality"))
    return df.filter(F.col("modality").isNotNull()).orderBy("subject_id", "modality", "path")


def segmentation_files(paths: DataFrame) -> DataFrame:
    """(folder, mask_path): of each folder the first *seg*.nii.gz, else the first *seg*.nii."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rank = F.when(name.rlike(r"seg.*\.nii\.gz$"), 0).when(name.rlike(r"seg.*\.nii$"), 1)
    return paths.select(folder.alias("folder"), "path", rank.alias("r")).filter("r is not null").groupBy("folder").agg(F.min_by("path", F.struct("r", "path")).alias("mask_path"))


def noise_controls(spark: SparkSession, kinds: dict[str, int], side: int = 64, seed: int = 45) -> DataFrame:
    """(image_id, negative_control_type, pixels) of synthetic controls: gaussian, salt_pepper, else a flat
    blurred field, else zeros. Pixels follow from hashes of (seed, picture, place), so any partition makes the
    same ones."""
    rows = None
    for kind, n in kinds.items():
        part = spark.range(n).select(F.format_string(f"nc_{kind}_%04d", "id").alias("image_id"), F.lit(kind).alias("negative_control_type"))
        rows = part if rows is None else rows.unionByName(part)
    u = lambda salt, i: (F.pmod(F.xxhash64("image_id", F.lit(seed), F.lit(salt), i), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
    normal = lambda i: F.sqrt(-2 * F.log(u(1, i))) * F.cos(2 * 3.141592653589793 * u(2, i))
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x))).cast("int")
    places = F.sequence(F.lit(0), F.lit(side * side - 1))
    kind = F.col("negative_control_type")
    pixels = (
        F.when(kind == "gaussian", F.transform(places, lambda i: byte(128 + 50 * normal(i))))
        .when(kind == "salt_pepper", F.transform(places, lambda i: F.when(u(1, i) < 0.5, 0).otherwise(255)))
        .when(kind == "blurred_uniform", F.transform(places, lambda i: byte(255 * (u(1, i) + u(2, i) + u(3, i) + u(4, i)) / 4)))
        .otherwise(F.transform(places, lambda i: F.lit(0)))
    )
    return rows.withColumn("pixels", pixels)


def first_files(paths: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` files by path, for controls that are copied from a folder."""
    return paths.orderBy("path").limit(n)


def _exists(spark: SparkSession, path: str | list[str]) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in [path] if isinstance(path, str) else path:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).globStatus(at):
            return True
    return False
