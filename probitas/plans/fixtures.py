"""Deterministic views over the sample tables: responses and an exam made from ``events`` by integer arithmetic.

The same SQL text, but for one function name, runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

MANIFEST_SQL = """
select concat('img_', lpad(cast(user_id as varchar(20)), 6, '0')) as image_id,
  case when user_id % 10 = 0 then 'negative_controls' when user_id % 10 <= 6 then 'brats' else 'ixi' end as dataset,
  concat('sub_', cast(user_id % 40 as varchar(20))) as subject_id,
  case when user_id % 10 = 0 then 'unknown' when user_id % 4 = 0 then 'T1' when user_id % 4 = 1 then 'T2' when user_id % 4 = 2 then 'FLAIR' else 'PD' end as label_modality,
  case when user_id % 10 = 0 then 'unknown' when user_id % 3 = 0 then 'axial' when user_id % 3 = 1 then 'sagittal' else 'coronal' end as label_plane,
  case when user_id % 10 between 1 and 6 then 'yes' else 'no' end as label_tumor_present,
  case when user_id % 10 not between 1 and 6 then 'none' when user_id % 3 = 0 then 'left' when user_id % 3 = 1 then 'right' else 'bilateral' end as label_laterality,
  case when user_id % 10 between 1 and 6 then (case when user_id % 13 = 0 then 'unknown' when user_id % 5 = 0 then 'no' else 'yes' end) else 'no' end as slice_tumor_present,
  case when user_id % 10 not between 1 and 6 then 'none' when user_id % 13 = 0 then 'unknown' when user_id % 5 = 0 then 'none' when user_id % 3 = 0 then 'left' when user_id % 3 = 1 then 'right' else 'bilateral' end as slice_laterality,
  case when user_id % 10 = 0 then 1 else 0 end as is_negative_control,
  cast(case when user_id % 3 = 0 then 0.4 when user_id % 3 = 1 then 0.5 else 0.6 end as double) as slice_frac
from (select distinct user_id from {events}) u where user_id % 37 <> 36
"""

RESPONSES_SQL = """
with b as (select event_id, user_id, value, cast({json}(props, '$.k') as int) as k, (event_id * 7919 + user_id * 10007) % 1000003 as h,
  case when user_id % 10 = 0 then (case when event_type in ('click', 'view') then 'T3-ISBRAIN' else 'T7-ABSTAIN' end)
    when event_type = 'click' then 'T1-MOD' when event_type = 'view' then 'T2-PLANE' when event_type = 'purchase' then 'T3-ISBRAIN'
    when event_type = 'signup' then 'T4-TUMOR' when user_id % 10 <= 6 then 'T5-LAT' else 'T6-VQA' end as task from {events})
select concat('vendor/model-', cast(event_id % 6 as varchar(20)), case when event_id % 2 = 0 then 'B-Instruct' else 'b-it' end) as model,
  concat('img_', lpad(cast(user_id as varchar(20)), 6, '0')) as image_id,
  concat('img_', lpad(cast(user_id as varchar(20)), 6, '0'), '__', task, '__', cast(event_id as varchar(20))) as prompt_id,
  task, case when h % 5 < 3 then 'neutral' when h % 5 = 3 then 'terse' else 'clinician' end as phrasing,
  case when task = 'T6-VQA' or h % 3 = 0 then 'OE' else 'MC' end as format,
  case h % 14 when 0 then concat('A. option', chr(10), 'Confidence: ', cast(k as varchar(20)))
    when 1 then concat('Answer: B', chr(10), 'Confidence: ', cast(k as varchar(20)), '%')
    when 2 then concat('C', chr(10), 'My confidence is ', cast(k as varchar(20)))
    when 3 then concat('The scan looks axial, T2 weighted, normal. Certainty: ', cast(k as varchar(20)))
    when 4 then concat('There is no tumor or mass in the left hemisphere. Confidence: ', cast(k as varchar(20)), '/100')
    when 5 then concat('A large tumor with vasogenic edema and midline shift on the right side. Confidence: ', cast(k as varchar(20)))
    when 6 then 'UNSURE'
    when 7 then 'I cannot determine this from the image.'
    when 8 then concat('asdf qwerty ', cast(k as varchar(20)))
    when 9 then concat('B) yes. Confidence: ', cast(k + 100 as varchar(20)))
    when 10 then ''
    when 11 then concat('Ring-enhancing lesion, mass effect, bilateral. ', cast(k as varchar(20)), '% confidence')
    when 12 then concat('yes, flair, coronal, left. Confidence: ', cast(k as varchar(20)))
    else concat('D', chr(10), 'Confidence: ', cast(k as varchar(20))) end as response,
  round(value, 3) as gen_seconds, event_id as ord from b
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rotated_options(task: Column, ord_: Column) -> Column:
    """The task's answer space rotated left by ord; empty where it has none."""
    out = F
    for name, space in C.ANSWER_SPACES.items():
        if space:
            options, n = F.array(*[F.lit(s) for s in space]), len(space)
            k = (ord_ % n).cast("int")
            out = out.when(task == name, F.concat(F.slice(options, k + 1, F.lit(n)), F.slice(options, F.lit(1), k)))
    return out.otherwise(F.array().cast("array<string>"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST_SQL, events=table(spark, sf_dir, "events"))


def responses(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    df = spark.sql(RESPONSES_SQL.replace("{json}", "get_json_object"), events=table(spark, sf_dir, "events") if events is None else events)
    options = F.when(F.col("format") == "MC", rotated_options(F.col("task"), F.col("ord"))).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"mc_options": options, "image_path": F.concat(F.lit("/img/"), "image_id", F.lit(".png"))})


def events_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the scale of ``lineitem``, for benchmarks."""
    df = table(spark, sf_dir, "lineitem")
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "error")]), (F.pmod(i, F.lit(5)) + 1).cast("int"))
    return df.select(
        i.cast("long").alias("event_id"), (F.col("l_partkey") % 1500).cast("long").alias("user_id"), kind.alias("event_type"), F.col("l_quantity").cast("double").alias("value"),
        F.concat(F.lit('{"k": '), (F.col("l_suppkey") % 100).cast("string"), F.lit("}")).alias("props"),
    )


REGISTRY_ROWS = [(f"vendor/model-{i}{'B-Instruct' if i % 2 == 0 else 'b-it'}", f"model-{i}", "AB"[i % 2], "echo", f"family-{i % 2}", None if i == 5 else float(2 ** (i + 1)), i == 4, False) for i in range(6)]


def registry(spark: SparkSession) -> DataFrame:
    from ..schemas import REGISTRY

    return spark.createDataFrame(REGISTRY_ROWS, REGISTRY)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as graded rows: truth is toxicity, the prediction a rule, the confidence from the id."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    df = d.join(lab, "doc_id").select("doc_id", F.col("lang").alias("model"), yes(F.col("toxic") == 1).alias("gt_label"), yes(F.col("n_chars") % 7 < 2).alias("pred_answer"), ((F.col("doc_id") % 101).cast("double") / F.lit(100.0)).alias("conf_frac"))
    return df.withColumns({"gradeable": F.lit(True), "answered": F.lit(True), "correct": F.col("gt_label") == F.col("pred_answer")})
