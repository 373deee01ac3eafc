"""Result tables over one graded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import parse_responses, short_name
from ..operators import bootstrap, metrics
from ..operators.grading import grade
from ..operators.manifest import composition
from ..operators.sampling import audit_sheet, random_sample, stratified_sample

AUDIT_COLUMNS = ["model", "image_id", "prompt_id", "task", "format", "phrasing", "response", "pred_answer", "gt_label", "confidence", "abstained", "unparseable", "correct", "hallucination", "asserted_findings"]


def graded_table(responses: DataFrame, manifest: DataFrame) -> DataFrame:
    """Parse and grade; persist the result when several reports follow."""
    return grade(parse_responses(responses), manifest)


def main_accuracy(graded: DataFrame, intervals: bool = False) -> DataFrame:
    """The metric suite of each model, task and format; with ``intervals`` those of accuracy (ci_lo, ci_hi), balanced
    accuracy, macro-F1, calibration error, Brier score, hallucination and abstention (NAME_ci_lo, NAME_ci_hi)."""
    keys = ["model", "task", "format"]
    out = metrics.suite(metrics.cells(graded, keys), keys).drop("acc_all_prompt", "coverage", "n_gradeable")
    if intervals:
        ci = bootstrap.suite_intervals(graded, keys).withColumnsRenamed({"accuracy_ci_lo": "ci_lo", "accuracy_ci_hi": "ci_hi"})
        out = out.join(ci, keys, "left")
    return out


def calibration(graded: DataFrame, intervals: bool = False) -> DataFrame:
    keys = ["model"]
    out = metrics.suite(metrics.cells(graded, keys), keys).select("model", "ece", "n_conf", "brier", "overconfidence_index", "confidently_wrong_rate", "n_answered")
    return out.join(bootstrap.suite_intervals(graded, keys, pops=["confidence"]), keys, "left") if intervals else out


def hallucination(graded: DataFrame, intervals: bool = False) -> DataFrame:
    """hall_* over open answers, abs_* over items to abstain on, and wrong sure answers among all answered."""
    open_, abstain = F.col("format") == "OE", metrics.should_abstain()
    out = (
        metrics.keyed(graded, ["model"])
        .groupBy("model")
        .agg(
            metrics.rate(F.col("hallucination"), open_).alias("hall_rate"), metrics.count_where(open_).alias("hall_n"),
            metrics.rate(F.col("abstained"), abstain).alias("abs_rate"), metrics.count_where(abstain).alias("abs_n"),
            metrics.rate(F.col("confidently_wrong"), F.col("answered")).alias("confidently_wrong_rate"), F.count("*").alias("n_total"),
        )
    )
    if intervals:
        ci = bootstrap.suite_intervals(graded, ["model"], pops=["open", "abstain"])
        out = out.join(ci.withColumnsRenamed({f"{a}_ci_{e}": f"{b}_ci_{e}" for a, b in (("hallucination", "hall"), ("abstention", "abs")) for e in ("lo", "hi")}), ["model"], "left")
    return out


def ablations(graded: DataFrame) -> DataFrame:
    """Accuracy by model and task with phrasing, format, slice position or model size, in one pass of grouping
    sets; ``ablation`` names the set, columns outside it are null. Null keys are dropped, as are models
    without a size."""
    sets = {"phrasing": ["phrasing"], "format": ["format"], "slice_pos": ["slice_frac"], "scale": ["params_b"]}
    sets = {k: v for k, v in sets.items() if set(v) <= set(graded.columns)}
    columns = [c for v in sets.values() for c in v]
    use = metrics.scored()
    out = graded.groupingSets([["model", "task", *v] for v in sets.values()], "model", "task", *columns).agg(
        metrics.rate(F.col("correct"), use).alias("accuracy"), metrics.count_where(use).alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns]
    )
    name = F
    for k, (c,) in sets.items():
        name = name.when((F.col(f"_{c}") == 0) & F.col(c).isNotNull(), k)
    out = out.withColumn("ablation", name).filter("ablation is not null and model is not null and task is not null")
    return out.drop(*[f"_{c}" for c in columns])


def headline_rows(graded: DataFrame) -> DataFrame:
    return graded.filter((F.col("phrasing") == "neutral") & (F.col("format") == "MC") & F.col("task").isin(C.HEADLINE_TASKS))


def coverage_by_model(graded: DataFrame) -> DataFrame:
    return metrics.coverage(headline_rows(graded), ["model"])


def usable_rows(graded: DataFrame, least: float = C.MIN_COVERAGE) -> DataFrame:
    """Headline rows of models that answer enough."""
    rows = headline_rows(graded)
    poor = coverage_by_model(graded).filter(F.col("coverage") < least).select("model")
    return rows.join(poor, "model", "left_anti")


def _usable_cells(cells: DataFrame, least: float) -> DataFrame:
    """Cells of models whose coverage over all of them is enough; both sides come from one exchange."""
    share = F.round(F.sum("n_scored") / F.greatest(F.lit(1), F.sum("n_gradeable")), 4)
    poor = cells.groupBy("model").agg(share.alias("coverage")).filter(F.col("coverage") < least).select("model")
    return cells.join(poor, "model", "left_anti")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c, t in df.dtypes if t == "double"}).withColumn("model", short_name(F.col("model")))


def headline(graded: DataFrame, least: float = C.MIN_COVERAGE, intervals: bool = False) -> DataFrame:
    """Per usable model and headline task: coverage, accuracy of answers and of all prompts, agreement, ece."""
    keys = ["model", "task"]
    out = metrics.suite(_usable_cells(metrics.cells(headline_rows(graded), keys), least), keys)
    out = out.select(*keys, "coverage", "n_gradeable", F.col("accuracy").alias("acc_answered"), "acc_all_prompt", "balanced_acc", "macro_f1", "ece")
    if intervals:
        ci = bootstrap.mean_interval(usable_rows(graded, least).filter(metrics.scored()), keys, F.col("correct"), cluster=F.col("subject_id")).drop("mean", "n")
        out = out.join(ci.withColumnsRenamed({"ci_lo": "acc_ans_ci_lo", "ci_hi": "acc_ans_ci_hi"}), keys, "left")
    return _rounded(out)


def safety(graded: DataFrame, least: float = C.MIN_COVERAGE, intervals: bool = False) -> DataFrame:
    """Per usable model: calibration over headline rows, hallucination and abstention over all neutral rows, both
    from one pass over the neutral rows."""
    neutral = graded.filter(F.col("phrasing") == "neutral").withColumn("head", (F.col("format") == "MC") & F.col("task").isin(C.HEADLINE_TASKS))
    cells = metrics.cells(neutral, ["model", "head"])
    head = metrics.suite(_usable_cells(cells.filter("head"), least), ["model"])
    head = head.select("model", "coverage", F.col("accuracy").alias("acc_answered"), "acc_all_prompt", "ece", "brier", F.col("overconfidence_index").alias("mean_conf_on_wrong"), F.coalesce("confidently_wrong_rate", F.lit(0.0)).alias("confidently_wrong_rate"))
    whole = metrics.suite(cells, ["model"]).select("model", F.col("hallucination_rate").alias("oe_hallucination_rate"), F.col("abstention_appropriateness").alias("abstention_approp"))
    out = head.join(whole, "model", "left")
    if intervals:
        ci = bootstrap.mean_interval(neutral.filter(metrics.should_abstain()), ["model"], F.col("abstained")).drop("mean", "n")
        out = out.join(ci.withColumnsRenamed({"ci_lo": "abstention_ci_lo", "ci_hi": "abstention_ci_hi"}), ["model"], "left")
    return _rounded(out)


def mean_accuracy(table: DataFrame) -> DataFrame:
    """The mean of a table's accuracies, by model and over all (model null)."""
    return table.rollup("model").agg(F.avg("accuracy").alias("accuracy"), F.count("accuracy").alias("n"))


def with_sizes(graded: DataFrame, registry: DataFrame) -> DataFrame:
    return graded.join(registry.select(F.col("id").alias("model"), "params_b"), "model", "left")


def accuracy_figure(table: DataFrame, least: int = 100) -> DataFrame:
    """Bars of tasks with a chance level, for models with more than ``least`` scored rows of some task."""
    chance = F.create_map(*[F.lit(x) for t, s in C.ANSWER_SPACES.items() if s for x in (t, 1.0 / len(s))])
    order = F.array_position(F.array(*[F.lit(t) for t in C.ANSWER_SPACES]), F.col("task"))
    bars = table.filter(F.col("format") == "MC").withColumn("chance", F.try_element_at(chance, F.col("task"))).filter("chance is not null")
    bars = bars.join(metrics.usable_by_count(bars, least), "model", "left_semi")
    if "ci_lo" in bars.columns:
        bars = bars.withColumns({"err_lo": F.coalesce(F.col("accuracy") - F.col("ci_lo"), F.lit(0.0)), "err_hi": F.coalesce(F.col("ci_hi") - F.col("accuracy"), F.lit(0.0))})
    return bars.withColumn("task_order", F.when(order > 0, order).otherwise(len(C.ANSWER_SPACES) + 1).cast("int")).withColumn("model", short_name(F.col("model"), 22))


def reliability_figure(graded: DataFrame, k: int = 3) -> DataFrame:
    """Bins of the ``k`` best calibrated models."""
    return metrics.best_calibrated_bins(graded, "model", k)


def confidence_figure(graded: DataFrame) -> DataFrame:
    return metrics.confidence_gap(headline_rows(graded), ["model"])


def audit_sample(graded: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    return random_sample(graded, n, ["model", "prompt_id"], seed).select(*[c for c in AUDIT_COLUMNS if c in graded.columns])


def audit_by_stratum(graded: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    return audit_sheet(stratified_sample(graded, n, ["task", "format"], ["model", "prompt_id"], seed), AUDIT_COLUMNS)


def diagnostic_tables(graded: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """All tables of the diagnostic run, by name; persist ``graded`` first."""
    return {
        "exam_set_table": composition(manifest).orderBy("dataset"),
        "main_accuracy": main_accuracy(graded, intervals=True).orderBy("model", "task", "format"),
        "calibration": calibration(graded, intervals=True).orderBy("model"),
        "hallucination": hallucination(graded, intervals=True).orderBy("model"),
        "parser_audit_sample": audit_sample(graded),
        "ablations": ablations(graded).orderBy("ablation", "model", "task"),
        "graded_all": graded,
    }


def headline_tables(graded: DataFrame, least: float = C.MIN_COVERAGE) -> dict[str, DataFrame]:
    return {
        "coverage_by_model": coverage_by_model(graded).orderBy(F.desc("coverage")),
        "headline_by_task": headline(graded, least, intervals="subject_id" in graded.columns).orderBy("model", "task"),
        "safety_summary": safety(graded, least, intervals=True).orderBy("model"),
    }
