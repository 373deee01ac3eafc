"""The prompt matrix: exam x tasks x phrasings x formats, what is still to run, and shards of it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.ids import hashed_shuffle, item_seed, option_line, shard_of
from ..functions.permute import seeded_shuffle
from ..schemas import PROMPTS


def task_table(spark: SparkSession, tasks: list[C.Task]) -> DataFrame:
    rows = [(i, t.task, t.answer_space, t.applies_to, {k: v for k, v in t.aliases.items()}, t.mc_template, t.oe_template) for i, t in enumerate(tasks)]
    return spark.createDataFrame(rows, "task_order int, task string, answer_space array<string>, applies_to array<string>, aliases map<string, array<string>>, mc_template string, oe_template string")


def template_table(spark: SparkSession, prompts: dict[tuple[str, str, str], str]) -> DataFrame:
    return spark.createDataFrame([(*k, v) for k, v in prompts.items()], "phrasing string, task string, fmt string, template string")


#: The key of tasks that name no dataset: they apply to every image.
ANY = "*"


def audience(dataset: Column, control: Column) -> Column:
    """The keys by which an image meets tasks: its dataset, or the controls' name, and the key of all."""
    return F.array(F.when(control, C.NEGATIVE_CONTROLS).otherwise(dataset), F.lit(ANY))


def prompt_label(task: Column) -> Column:
    """The subject-level label that a prompt's correct letter is made from."""
    return (
        F.when(task == "T1-MOD", F.col("label_modality"))
        .when(task == "T2-PLANE", F.col("label_plane"))
        .when(task == "T3-ISBRAIN", F.when(F.col("_control"), "no").otherwise("yes"))
        .when(task == "T4-TUMOR", F.col("label_tumor_present"))
        .when(task == "T5-LAT", F.col("label_laterality"))
        .when(task == "T7-ABSTAIN", C.UNSURE)
        .otherwise("")
    )


def correct_letter(options: Column, label: Column, aliases: Column) -> Column:
    """The letter of the first option that is the label, or stands for the same answer; ? where none is."""
    low = F.lower(F.trim(label))
    group = lambda o: F.coalesce(F.try_element_at(aliases, o), F.array().cast("array<string>"))
    same = F.transform(options, lambda o: (F.lower(F.trim(o)) == low) | F.exists(group(o), lambda a: F.lower(F.trim(a)) == low))
    at = F.array_position(same, True)
    return F.when(F.coalesce(label, F.lit("")) == "", "?").when(at > 0, F.char(at + 64)).otherwise("?")


def render(manifest: DataFrame, tasks: DataFrame, templates: DataFrame, system_prompt: str = "", phrasings: list[str] | None = None, formats: list[str] | None = None, exact_order: bool = False) -> DataFrame:
    """One row per image, applicable task, phrasing and format, for the phrasings and formats asked for.

    The task and template tables come from configuration files and have some dozens of rows: they are joined to
    each other first, listed by dataset and broadcast; images meet them by an equal key.
    Multiple choice needs an answer space; its options come in an order hashed from the item, or with
    ``exact_order`` in that of NumPy's shuffle seeded by it (in Python, by batch).
    """
    phrasings, formats = phrasings or C.PHRASINGS, [f.lower() for f in formats or ["mc", "oe"]]
    grid = templates.filter(F.col("phrasing").isin(phrasings) & F.col("fmt").isin(formats)).join(tasks, "task")
    grid = grid.filter((F.col("fmt") == "oe") | (F.size("answer_space") > 0))
    images = manifest.withColumn("_control", F.coalesce(F.col("is_negative_control").cast("int") != 0, F.lit(False)))
    listed = F.when(F.size("applies_to") > 0, F.array_distinct("applies_to")).otherwise(F.array(F.lit(ANY)))
    grid = grid.withColumn("_key", F.explode(listed))
    rows = images.withColumn("_key", F.explode(audience(F.col("dataset"), F.col("_control")))).join(F.broadcast(grid), "_key")
    mc, none = F.col("fmt") == "mc", F.array()
    shuffled, order = (seeded_shuffle if exact_order else hashed_shuffle)(F.col("answer_space"), item_seed(F.col("image_id"), F.col("task"), F.col("phrasing")))
    rows = rows.withColumns({"mc_options": F.when(mc, shuffled).otherwise(none.cast("array<string>")), "mc_option_order": F.when(mc, order).otherwise(none.cast("array<int>"))})
    text = F.replace(F.col("template"), F.lit("{options}"), F.when(mc, option_line(F.col("mc_options"))).otherwise(""))
    text = F.replace(text, F.lit("{question}"), F.when(mc, F.col("mc_template")).otherwise(F.col("oe_template")))
    out = rows.withColumns(
        {
            "prompt_id": F.concat_ws("__", "image_id", "task", "phrasing", "fmt"),
            "format": F.upper("fmt"),
            "prompt_text": F.regexp_replace(text, r"(?U)^\s+|\s+$", ""),
            "system_prompt": F.lit(system_prompt.strip()),
            "mc_correct_letter": F.when(mc, correct_letter(F.col("mc_options"), prompt_label(F.col("task")), F.col("aliases"))).otherwise(""),
            "image_path": F.col("path") if "path" in manifest.columns else F.lit(None).cast("string"),
        }
    )
    return out.select(*PROMPTS.names)


def with_images(prompts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Prompts with their image's path; those without one are dropped."""
    paths = manifest.select("image_id", F.col("path").alias("image_path")).filter(F.coalesce("image_path", F.lit("")) != "")
    return prompts.drop("image_path").join(paths, "image_id")


def pending(prompts: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Prompts without a response of ``model`` yet."""
    seen = done.filter(F.col("model") == model).select("image_id", "prompt_id")
    return prompts.join(seen, ["image_id", "prompt_id"], "left_anti")


def shard(prompts: DataFrame, index: int, shards: int, limit: int | None = None) -> DataFrame:
    """The prompts of one of ``shards`` processes that share no state; ``limit`` after that, by prompt_id."""
    out = prompts.filter(shard_of(F.col("image_id"), F.col("prompt_id"), shards) == index)
    return out.orderBy("prompt_id").limit(limit) if limit is not None else out


#: Wording around worked cases: before them, one of them, after them.
FEW_SHOT = ("Some solved cases first.\n\n", "Example {number}. {question}\nSolved as: {label} (Confidence: {confidence})", "\n\nYour case:\n")


def few_shot_prefix(examples: Column, shots: int = 2, wording: tuple[str, str, str] = FEW_SHOT) -> Column:
    """Worked cases to put before a prompt, from an array of (prompt_text, label, confidence); questions are cut at 200
    characters, an unknown confidence is 90."""
    before, one, after = wording

    def block(e: Column, i: Column) -> Column:
        values = {"number": (i + 1).cast("string"), "question": F.left(e["prompt_text"], F.lit(200)), "label": e["label"], "confidence": F.coalesce(e["confidence"], F.lit(90)).cast("string")}
        return F.concat(*[values[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", one) if x])

    return F.concat(F.lit(before), F.array_join(F.transform(F.slice(examples, 1, shots), block), "\n"), F.lit(after))
