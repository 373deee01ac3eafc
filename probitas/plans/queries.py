"""The registered queries over the sample tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import ids, permute, pixels, text
from ..operators import bootstrap, grading, manifest, metrics, prompts, sampling, statistics
from ..session import ship_package
from . import fixtures, oracle, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["model", "prompt_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.graded_table(fixtures.responses(spark, sf_dir), fixtures.manifest(spark, sf_dir))


def with_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded rows with the subject and slice of their image."""
    exam = fixtures.manifest(spark, sf_dir).select("image_id", "subject_id", "slice_frac")
    return graded(spark, sf_dir).join(exam, "image_id", "left")


# --- sources and parsing -----------------------------------------------------------------------------------------
@query(f"with manifest as ({oracle.MANIFEST}) select * from manifest")
def adapter_manifest(spark, sf_dir):
    return fixtures.manifest(spark, sf_dir)


@query(f"with responses as ({oracle.RESPONSES}) select ord, model, image_id, prompt_id, task, phrasing, format, response, gen_seconds, array_to_string(mc_options, '|') as options from responses")
def adapter_responses(spark, sf_dir):
    return fixtures.responses(spark, sf_dir).select("ord", "model", "image_id", "prompt_id", "task", "phrasing", "format", "response", "gen_seconds", F.array_join("mc_options", "|").alias("options"))


@query(f"{oracle.BASE} select ord, confidence from parsed")
def parse_confidence(spark, sf_dir):
    return fixtures.responses(spark, sf_dir).select("ord", text.confidence(F.col("response")).alias("confidence"))


@query(f"{oracle.BASE} select ord, abstained from parsed")
def parse_abstention(spark, sf_dir):
    return fixtures.responses(spark, sf_dir).select("ord", text.abstains(F.col("response")).alias("abstained"))


@query(f"{oracle.BASE} select ord, array_to_string(asserted_findings, '|') as findings from findings")
def parse_findings(spark, sf_dir):
    out = text.parse_responses(fixtures.responses(spark, sf_dir))
    return out.filter(F.size("asserted_findings") > 0).select("ord", F.array_join("asserted_findings", "|").alias("findings"))


@query(f"{oracle.BASE} select ord, known as answer from parsed")
def parse_normalize(spark, sf_dir):
    r = fixtures.responses(spark, sf_dir)
    space = F.create_map(*[x for t, s in C.ANSWER_SPACES.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in s]).cast("array<string>"))])
    return r.select("ord", text.to_answer(F.col("response"), F.element_at(space, F.col("task"))).alias("answer"))


@query(f"{oracle.BASE} select ord, case when response <> '' then coalesce({oracle.letter('stripped', C.ANSWER_LETTER, '(?i)')}, {oracle.letter('stripped', C.LEADING_LETTER)}, known) end as answer from parsed where format = 'MC'")
def parse_mc_answer(spark, sf_dir):
    r = fixtures.responses(spark, sf_dir).filter("format = 'MC'")
    return r.select("ord", text.option_answer(F.col("response"), F.col("mc_options")).alias("answer"))


@query(f"{oracle.BASE} select ord, pred_answer, confidence, abstained, unparseable from parsed")
def parse_responses(spark, sf_dir):
    return text.parse_responses(fixtures.responses(spark, sf_dir)).select("ord", "pred_answer", "confidence", "abstained", "unparseable")


@query(
    f"{oracle.BASE} select ord, gt_label, gradeable, correct, answered, hallucination, appropriate_abstention, confidently_wrong, conf_frac, is_negative_control from graded"
)
def grade_records(spark, sf_dir):
    return graded(spark, sf_dir).select("ord", "gt_label", "gradeable", "correct", "answered", "hallucination", "appropriate_abstention", "confidently_wrong", "conf_frac", "is_negative_control")


@query(f"with responses as ({oracle.RESPONSES}) select distinct model, string_split(replace(replace(string_split(model, '/')[-1], '-Instruct', ''), '-it', ''), chr(0))[1] as short, left(replace(replace(string_split(model, '/')[-1], '-Instruct', ''), '-it', ''), 22) as short22, regexp_replace(regexp_replace(lower(string_split(model, '/')[-1]), '-instruct$', ''), '-it$', '') as tag, replace(model, '/', '__') as file from responses")
def model_names(spark, sf_dir):
    m = F.col("model")
    r = fixtures.responses(spark, sf_dir).select("model").distinct()
    return r.select("model", text.short_name(m).alias("short"), text.short_name(m, 22).alias("short22"), text.model_tag(m).alias("tag"), ids.file_label(m).alias("file"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from documents")
def squeeze_text(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", text.squeeze(F.col("text")).alias("flat"))


# --- metrics -----------------------------------------------------------------------------------------------------
MTF = "model, task, format"


@query(f"{oracle.BASE} select {MTF}, {oracle.share('correct', oracle.SCORED)} as accuracy, {oracle.count(oracle.SCORED)} as n from graded group by all")
def accuracy_by_model_task_format(spark, sf_dir):
    return metrics.accuracy(graded(spark, sf_dir), ["model", "task", "format"])


@query(f"{oracle.BASE} {oracle.agreement('graded', MTF)}")
def balanced_accuracy_and_macro_f1(spark, sf_dir):
    return metrics.agreement(graded(spark, sf_dir), ["model", "task", "format"])


@query(f"{oracle.BASE} {oracle.classes('graded', 'task')}")
def class_counts(spark, sf_dir):
    return metrics.class_counts(graded(spark, sf_dir), ["task"])


@query(f"{oracle.BASE} {oracle.ece('graded', 'model')}")
def ece_by_model(spark, sf_dir):
    return metrics.calibration_error(graded(spark, sf_dir), ["model"])


def _bins_sql(where: str) -> str:
    return f"{oracle.BASE} select model, bin, acc, conf, n, {oracle.EDGES}[bin + 1] as bin_lo, {oracle.EDGES}[bin + 2] as bin_hi from ({oracle.bins('graded', 'model', where)})"


@query(_bins_sql("true"))
def reliability_bins(spark, sf_dir):
    return metrics.reliability_bins(graded(spark, sf_dir), ["model"])


@query(_bins_sql("answered"))
def reliability_bins_answered(spark, sf_dir):
    return metrics.reliability_bins(graded(spark, sf_dir), ["model"], "answered")


@query(f"{oracle.BASE} select model, avg(case when {oracle.SCORED} then pow(conf_frac - correct::int::double, 2) end) as brier, count(case when {oracle.SCORED} then conf_frac end) as n from graded group by model")
def brier_by_model(spark, sf_dir):
    return metrics.brier(graded(spark, sf_dir), ["model"])


OVER = f"avg(case when {oracle.SCORED} and not correct then conf_frac end) as overconfidence_index, {oracle.count(oracle.SCORED + ' and not correct and conf_frac >= 0.8')}::double / nullif({oracle.count(oracle.SCORED)}, 0) as confidently_wrong_rate, {oracle.count(oracle.SCORED)} as n_answered"


@query(f"{oracle.BASE} select model, {OVER} from graded group by model")
def overconfidence(spark, sf_dir):
    return metrics.overconfidence(graded(spark, sf_dir), ["model"])


HALL = "format = 'OE'"


@query(f"{oracle.BASE} select model, {oracle.share('hallucination', HALL)} as hallucination_rate, {oracle.count(HALL)} as n_oe from graded group by model")
def hallucination_rate(spark, sf_dir):
    return metrics.hallucination(graded(spark, sf_dir), ["model"])


@query(f"{oracle.BASE} select model, {oracle.share('abstained', oracle.ABST)} as abstention_appropriateness, {oracle.count(oracle.ABST)} as n_should_abstain from graded group by model")
def abstention_appropriateness(spark, sf_dir):
    return metrics.abstention(graded(spark, sf_dir), ["model"])


@query(
    f"""{oracle.BASE} select a.*, balanced_acc, macro_f1, ece, n_conf from
    (select {MTF}, {oracle.share('correct', oracle.SCORED)} as accuracy, {oracle.count(oracle.SCORED)} as n, round(avg(case when {oracle.SCORED} then pow(conf_frac - correct::int::double, 2) end), 10) as brier, {OVER},
      {oracle.share('hallucination', HALL)} as hallucination_rate, {oracle.count(HALL)} as n_oe, {oracle.share('abstained', oracle.ABST)} as abstention_appropriateness, {oracle.count(oracle.ABST)} as n_should_abstain from graded group by {MTF}) a
    left join (select * exclude (n) from ({oracle.agreement('graded', MTF)})) using ({MTF}) left join ({oracle.ece('graded', MTF)}) using ({MTF})"""
)
def main_accuracy(spark, sf_dir):
    return reports.main_accuracy(graded(spark, sf_dir)).withColumn("brier", F.round("brier", 10))


@query(f"{oracle.BASE} select e.*, brier, overconfidence_index, confidently_wrong_rate, n_answered from ({oracle.ece('graded', 'model')}) e join (select model, avg(case when {oracle.SCORED} then pow(conf_frac - correct::int::double, 2) end) as brier, {OVER} from graded group by model) using (model)")
def calibration_table(spark, sf_dir):
    return reports.calibration(graded(spark, sf_dir))


@query(
    f"""{oracle.BASE} select model, {oracle.share('hallucination', HALL)} as hall_rate, {oracle.count(HALL)} as hall_n, {oracle.share('abstained', oracle.ABST)} as abs_rate, {oracle.count(oracle.ABST)} as abs_n,
    {oracle.share('confidently_wrong', 'answered')} as confidently_wrong_rate, count(*) as n_total from graded group by model"""
)
def hallucination_abstention(spark, sf_dir):
    return reports.hallucination(graded(spark, sf_dir))


COV = f"round({oracle.count(oracle.SCORED)} / greatest(1, {oracle.count('gradeable')}), 4) as coverage, {oracle.count('gradeable')} as n_gradeable, {oracle.count(oracle.SCORED)} as n_answered"


@query(f"{oracle.BASE}, {oracle.HEAD} select model, {COV} from headline group by model")
def coverage_by_model(spark, sf_dir):
    return reports.coverage_by_model(graded(spark, sf_dir))


def rounded(cols: str) -> str:
    return ", ".join(f"round({c.strip()}, 3) as {c.strip()}" for c in cols.split(","))


@query(
    f"""{oracle.BASE}, {oracle.USABLE} select {oracle.SHORT} as model, task, n_gradeable, {rounded('coverage, acc_answered, acc_all_prompt, balanced_acc, macro_f1, ece')}
    from (select model, task, {oracle.count(oracle.SCORED)} / greatest(1, {oracle.count('gradeable')}) as coverage, {oracle.count('gradeable')} as n_gradeable, {oracle.share('correct', oracle.SCORED)} as acc_answered, {oracle.share('correct', 'gradeable')} as acc_all_prompt from usable group by model, task) a
    left join (select * exclude (n) from ({oracle.agreement('usable', 'model, task')})) using (model, task) left join ({oracle.ece('usable', 'model, task')}) using (model, task)"""
)
def headline_by_task(spark, sf_dir):
    return reports.headline(graded(spark, sf_dir))


@query(
    f"""{oracle.BASE}, {oracle.USABLE} select {oracle.SHORT} as model, {rounded('coverage, acc_answered, acc_all_prompt, mean_conf_on_wrong, confidently_wrong_rate, ece, brier, oe_hallucination_rate, abstention_approp')}
    from (select model, {oracle.count(oracle.SCORED)} / greatest(1, {oracle.count('gradeable')}) as coverage, {oracle.share('correct', oracle.SCORED)} as acc_answered, {oracle.share('correct', 'gradeable')} as acc_all_prompt,
      avg(case when {oracle.SCORED} and not correct then conf_frac end) as mean_conf_on_wrong, {oracle.count(oracle.SCORED + ' and not correct and conf_frac >= 0.8')} / greatest(1, {oracle.count(oracle.SCORED)}) as confidently_wrong_rate,
      avg(case when {oracle.SCORED} then pow(conf_frac - correct::int::double, 2) end) as brier from usable group by model) a left join ({oracle.ece('usable', 'model')}) using (model)
    left join (select model, {oracle.share('hallucination', HALL)} as oe_hallucination_rate, {oracle.share('abstained', oracle.ABST)} as abstention_approp from graded where phrasing = 'neutral' group by model) using (model)"""
)
def safety_summary(spark, sf_dir):
    return reports.safety(graded(spark, sf_dir))


@query(f"{oracle.BASE}, {oracle.HEAD} select model, avg(conf_frac) as mean_conf, avg(correct::int::double) as accuracy, 100 * (avg(conf_frac) - avg(correct::int::double)) as gap_pct from headline where answered group by model")
def confidence_gap(spark, sf_dir):
    return reports.confidence_figure(graded(spark, sf_dir))


@query(f"{oracle.BASE} select model, avg(answered::int::double) as answered_share from graded group by model having avg(answered::int::double) > 0.5")
def usable_by_answers(spark, sf_dir):
    g = graded(spark, sf_dir)
    return metrics.answered_share(g).join(metrics.usable_by_answers(g), "model", "left_semi")


ABL = f"{oracle.share('correct', oracle.SCORED)} as accuracy, {oracle.count(oracle.SCORED)} as n"


@query(
    f"""{oracle.BASE}, g as (select graded.*, params_b from graded left join {oracle.REGISTRY} using (model))
    select 'phrasing' as ablation, model, task, phrasing, null as format, null::double as slice_frac, null::double as params_b, {ABL} from g group by model, task, phrasing
    union all select 'format', model, task, null, format, null, null, {ABL} from g group by model, task, format
    union all select 'slice_pos', model, task, null, null, slice_frac, null, {ABL} from g where slice_frac is not null group by model, task, slice_frac
    union all select 'scale', model, task, null, null, null, params_b, {ABL} from g where params_b is not null group by model, task, params_b"""
)
def ablations_grouping_sets(spark, sf_dir):
    return reports.ablations(reports.with_sizes(with_exam(spark, sf_dir), fixtures.registry(spark)))


@query(f"{oracle.BASE}, t as (select {MTF}, {ABL} from graded group by {MTF}) select model, avg(accuracy) as accuracy, count(accuracy) as n from t group by rollup (model)")
def rollup_mean_accuracy(spark, sf_dir):
    return reports.mean_accuracy(metrics.accuracy(graded(spark, sf_dir), ["model", "task", "format"]))


@query(f"{oracle.BASE}, e as ({oracle.ece('graded', 'model')} order by ece, model limit 3) select model, bin, acc, conf, n from ({oracle.bins('graded', 'model', 'true')}) where model in (select model from e)")
def topk_calibrated(spark, sf_dir):
    return reports.reliability_figure(graded(spark, sf_dir)).select("model", "bin", "acc", "conf", "n")


CHANCE = "case task " + " ".join(f"when '{t}' then 1.0::double / {len(s)}" for t, s in C.ANSWER_SPACES.items() if s) + " end"
ORDER = f"list_position({oracle.array(C.ANSWER_SPACES)}, task)"


@query(
    f"""{oracle.BASE}, t as (select {MTF}, {ABL} from graded where format = 'MC' group by {MTF})
    select left({oracle.SHORT}, 22) as model, task, accuracy, n, {CHANCE} as chance, {ORDER} as task_order from t where {CHANCE} is not null and model in (select model from t where {CHANCE} is not null group by model having max(n) > 20)"""
)
def accuracy_figure(spark, sf_dir):
    return reports.accuracy_figure(metrics.accuracy(graded(spark, sf_dir), ["model", "task", "format"]), 20).select("model", "task", "accuracy", "n", "chance", "task_order")


@query(
    """with d as (select lang as model, case when toxic = 1 then 'yes' else 'no' end as t, case when n_chars % 7 < 2 then 'yes' else 'no' end as p, (doc_id % 101)::double / 100.0::double as conf_frac from documents join labels using (doc_id))
    select model, avg((t = p)::int::double) as accuracy, avg(pow(conf_frac - (t = p)::int::double, 2)) as brier, count(*) as n from d group by model"""
)
def classifier_scores(spark, sf_dir):
    d = fixtures.scored_documents(spark, sf_dir)
    return metrics.accuracy(d, ["model"]).drop("n").join(metrics.brier(d, ["model"]), "model")


# --- resampling --------------------------------------------------------------------------------------------------
CELLS = f"select model, task, correct::int::double as s, 1 as c, count(*) as m from graded where {oracle.SCORED} group by all"
CLUSTERS = f"select model, task, s, c, count(*) as m from (select model, task, subject_id, sum(correct::int::double) as s, count(*) as c from graded where {oracle.SCORED} and subject_id is not null group by all) group by all"
DRAWN = oracle.BASE.replace("with ", "with recursive ", 1)
#: Means of scores may be decimals of a few digits, so that sums in another order fall on either side of a rounding's
#: edge: to 13 digits both sides are the same number.
DIGITS = 13


def _near(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c, t in df.dtypes if t == "double"})


def _near_sql(sql: str, *columns: str) -> str:
    return f"select * replace ({', '.join(f'round({c}, {DIGITS}) as {c}' for c in columns)}) from ({sql})"


@query(_near_sql(f"{DRAWN}, {oracle.mean_interval(CELLS, 'model, task')}", "mean", "ci_lo", "ci_hi"))
def bootstrap_accuracy_ci(spark, sf_dir):
    return _near(bootstrap.mean_interval(graded(spark, sf_dir).filter(metrics.scored()), ["model", "task"], F.col("correct")))


@query(_near_sql(f"{DRAWN}, {oracle.mean_interval(CLUSTERS, 'model, task')}", "mean", "ci_lo", "ci_hi"))
def clustered_bootstrap_ci(spark, sf_dir):
    return _near(bootstrap.mean_interval(with_exam(spark, sf_dir).filter(metrics.scored()), ["model", "task"], F.col("correct"), cluster=F.col("subject_id")))


POPULATIONS = oracle.populations("model")


@query(_near_sql(f"{DRAWN}, {oracle.suite_intervals('model', POPULATIONS)} select model, ece_ci_lo as ci_lo, ece_ci_hi as ci_hi from suite_ci", "ci_lo", "ci_hi"))
def bootstrap_ece_ci(spark, sf_dir):
    return _near(bootstrap.suite_intervals(graded(spark, sf_dir), ["model"], pops=["confidence"]).select("model", F.col("ece_ci_lo").alias("ci_lo"), F.col("ece_ci_hi").alias("ci_hi")))


@query(_near_sql(f"{DRAWN}, {oracle.suite_intervals('model', POPULATIONS)} select model, balanced_acc_ci_lo as balanced_lo, balanced_acc_ci_hi as balanced_hi, macro_f1_ci_lo as f1_lo, macro_f1_ci_hi as f1_hi from suite_ci", "balanced_lo", "balanced_hi", "f1_lo", "f1_hi"))
def bootstrap_agreement_ci(spark, sf_dir):
    ci = bootstrap.suite_intervals(graded(spark, sf_dir), ["model"], pops=["scored"])
    return _near(ci.select("model", *[F.col(f"{a}_ci_{e}").alias(f"{b}_{e}") for a, b in (("balanced_acc", "balanced"), ("macro_f1", "f1")) for e in ("lo", "hi")]))


NAMES = ("accuracy", "balanced_acc", "macro_f1", "ece", "brier", "hallucination", "abstention")


ENDS = [f"{n}_ci_{e}" for n in NAMES for e in ("lo", "hi")]


@query(_near_sql(f"{DRAWN}, {oracle.suite_intervals('model, task', oracle.populations('model, task'))} select model, task, {', '.join(ENDS)} from suite_ci", *ENDS))
def suite_intervals(spark, sf_dir):
    """All intervals of each model and task, at the published number of replicates."""
    return _near(bootstrap.suite_intervals(graded(spark, sf_dir), ["model", "task"]))


RIGHT = f"from graded where {oracle.SCORED} and task = 'T4-TUMOR' group by model"
HITS = "count(case when lower(trim(gt_label)) = 'yes' and lower(trim(pred_answer)) = 'yes' then 1 end)"
EITHER = "(4 * count(case when lower(trim(gt_label)) = 'yes' then 1 end) + count(case when lower(trim(pred_answer)) = 'yes' then 1 end))"


@query(f"{oracle.BASE} select model, 'f2' as statistic, 5.0::double * {HITS} / nullif({EITHER}, 0) as value {RIGHT} union all select model, 'median', quantile_disc(conf_frac, 0.5) from graded group by model")
def user_statistics(spark, sf_dir):
    """An F-score and a median as mergeable aggregates that a user might bring."""
    g = graded(spark, sf_dir)
    right = g.filter(metrics.scored() & (F.col("task") == "T4-TUMOR")).select("model", text.fold(F.col("gt_label")).alias("t"), text.fold(F.col("pred_answer")).alias("p"))
    f2 = statistics.aggregate(right, ["model"], ["t", "p"], statistics.FScore("t", "p", "yes", 2.0))
    median = statistics.aggregate(g, ["model"], ["conf_frac"], statistics.Quantile("conf_frac"))
    return f2.select("model", F.lit("f2").alias("statistic"), "value").unionByName(median.select("model", F.lit("median").alias("statistic"), "value"))


CONFIDENT = "select model, conf_frac as c, count(*) as m from graded where conf_frac is not null group by all"
MEDIANS = "select model, rep, min(case when 2 * upto >= total then c end) as stat from (select *, sum(w) over (partition by model, rep order by c) as upto, sum(w) over (partition by model, rep) as total from drawn) group by model, rep"


@query(f"{DRAWN}, {oracle.draws(CONFIDENT, 'model', 'c')} select model, value, ci_lo, ci_hi from (select model, quantile_disc(conf_frac, 0.5) as value from graded where conf_frac is not null group by model) join ({oracle.ends('model', 'stat', MEDIANS)}) using (model)")
def user_statistic_interval(spark, sf_dir):
    """The interval of a statistic that a user brings: the median confidence of each model."""
    # exploded, not filtered: a filter would repeat the parsing below it
    g = graded(spark, sf_dir).select("model", F.explode(F.array_compact(F.array(F.when(metrics.has_confidence(), F.col("conf_frac"))))).alias("c"))
    return statistics.aggregate_interval(g, ["model"], ["c"], statistics.Quantile("c"))


@query()
def bootstrap_exact_numpy(spark, sf_dir):
    ship_package(spark)
    rows = graded(spark, sf_dir).filter(metrics.scored()).withColumn("x", F.col("correct").cast("double"))
    return bootstrap.exact_interval(rows, ["model"], "x", ["ord"], replicates=200)


# --- prompts -----------------------------------------------------------------------------------------------------
def _matrix(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    exam = fixtures.manifest(spark, sf_dir).withColumn("path", F.concat(F.lit("/img/"), "image_id", F.lit(".png")))
    return prompts.render(exam, prompts.task_table(spark, C.default_tasks()), prompts.template_table(spark, C.default_prompts()), C.SYSTEM_PROMPT, **options)


TASKS = "(values " + ", ".join(f"({oracle.lit(t)}, {oracle.array(s)}, {oracle.array(C.APPLIES_TO[t])})" for t, s in C.ANSWER_SPACES.items()) + ") as t(task, space, datasets)"
MATRIX = f"""with manifest as ({oracle.MANIFEST}), p as (select m.*, task, space, phrasing, fmt from manifest m, {TASKS}, (values ('neutral'), ('terse'), ('clinician')) as ph(phrasing), (values ('mc'), ('oe')) as f(fmt)
  where (fmt = 'oe' or len(space) > 0) and list_contains(datasets, case when is_negative_control = 1 then 'negative_controls' else dataset end)),
  s as (select *, ('0x' || left(sha256(concat_ws('|', image_id, task, phrasing)), 8))::ubigint as seed from p),
  o as (select *, [x[2] for x in list_sort([[md5(seed::varchar || '|' || v), v] for v in space])] as options from s),
  l as (select *, case task when 'T1-MOD' then label_modality when 'T2-PLANE' then label_plane when 'T3-ISBRAIN' then case when is_negative_control = 1 then 'no' else 'yes' end when 'T4-TUMOR' then label_tumor_present when 'T5-LAT' then label_laterality when 'T7-ABSTAIN' then 'UNSURE' else '' end as label from o)
"""


SEEDED = permute.sql("select image_id, task, phrasing, space, seed::bigint as seed, len(space) as n from s where fmt = 'mc'")


@query(f"{MATRIX}, {SEEDED} select concat_ws('__', image_id, task, phrasing, 'mc') as prompt_id, array_to_string(list_transform(ord, lambda k: space[k + 1]), '|') as options, array_to_string(ord, ',') as option_order from permuted")
def seeded_options(spark, sf_dir):
    """Multiple-choice options in the order of NumPy's shuffle, seeded by the item."""
    ship_package(spark)
    m = _matrix(spark, sf_dir, exact_order=True).filter("format = 'MC'")
    return m.select("prompt_id", F.array_join("mc_options", "|").alias("options"), F.array_join(F.transform("mc_option_order", lambda i: i.cast("string")), ",").alias("option_order"))


@query(
    f"""{MATRIX} select concat_ws('__', image_id, task, phrasing, fmt) as prompt_id, image_id, task, phrasing, upper(fmt) as format, case when fmt = 'mc' then array_to_string(options, '|') else '' end as options,
    case when fmt = 'mc' then coalesce(chr(cast(64 + list_position([lower(v) for v in options], lower(label)) as int)), '?') else '' end as mc_correct_letter from l"""
)
def prompt_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("prompt_id", "image_id", "task", "phrasing", "format", F.array_join("mc_options", "|").alias("options"), "mc_correct_letter")


@query()
def prompt_texts(spark, sf_dir):
    return _matrix(spark, sf_dir).select("prompt_id", "prompt_text", "system_prompt", "mc_option_order", "image_path")


@query(f"{MATRIX} select concat_ws('__', image_id, task, phrasing, fmt) as prompt_id from l where not (fmt = 'mc' and image_id in (select image_id from responses r where r.model = 'vendor/model-0B-Instruct' and r.task = l.task))".replace("with manifest as", f"with responses as ({oracle.RESPONSES}), manifest as"))
def pending_prompts(spark, sf_dir):
    """Multiple-choice prompts of (image, task) that one model has answered count as done."""
    matrix = _matrix(spark, sf_dir)
    done = fixtures.responses(spark, sf_dir).select("model", "image_id", "task").distinct()
    done = done.join(matrix.filter("format = 'MC'").select("image_id", "task", "prompt_id"), ["image_id", "task"])
    return prompts.pending(matrix, done, "vendor/model-0B-Instruct").select("prompt_id")


@query(f"with responses as ({oracle.RESPONSES}) select ord, (('0x' || md5(image_id || '|' || prompt_id)[1:15])::ubigint % 4 * 0 + (list_reduce([0::bigint] || [cast(('0x' || c)::ubigint as bigint) for c in regexp_extract_all(md5(image_id || '|' || prompt_id), '.')], lambda a, c: (a * 16 + c) % 4)))::bigint as shard from responses")
def shard_assignment(spark, sf_dir):
    return fixtures.responses(spark, sf_dir).select("ord", ids.shard_of(F.col("image_id"), F.col("prompt_id"), 4).alias("shard"))


@query(f"with responses as ({oracle.RESPONSES}) select ord, left(sha256(concat_ws('|', model, image_id, response)), 24) as cache_key, ('0x' || left(sha256(concat_ws('|', image_id, task, phrasing)), 8))::ubigint::bigint as seed from responses")
def hashed_ids(spark, sf_dir):
    r = fixtures.responses(spark, sf_dir)
    return r.select("ord", ids.cache_key(F.col("model"), F.col("image_id"), F.col("response")).alias("cache_key"), ids.item_seed(F.col("image_id"), F.col("task"), F.col("phrasing")).alias("seed"))


@query(f"with responses as ({oracle.RESPONSES}), manifest as ({oracle.MANIFEST}) select dataset, task, count(*) as n from responses join manifest using (image_id) group by all")
def responses_by_dataset(spark, sf_dir):
    return fixtures.responses(spark, sf_dir).join(fixtures.manifest(spark, sf_dir), "image_id").groupBy("dataset", "task").agg(F.count("*").alias("n"))


# --- exam, slices ------------------------------------------------------------------------------------------------
@query(
    f"""with m as ({oracle.MANIFEST}) select dataset, count(*) as n_images, count(distinct subject_id) as n_subjects, string_agg(distinct label_modality, ',' order by label_modality) as modalities,
    count(case when label_tumor_present = 'yes' then 1 end) as tumor_yes, count(case when label_tumor_present = 'no' then 1 end) as tumor_no, string_agg(distinct label_plane, ',' order by label_plane) as planes from m group by dataset"""
)
def exam_set_table(spark, sf_dir):
    return manifest.composition(fixtures.manifest(spark, sf_dir))


@query(f"with m as ({oracle.MANIFEST}) select 'dataset' as column, dataset as value, count(*) as n from m group by dataset union all select 'label_plane', label_plane, count(*) from m group by label_plane")
def value_counts(spark, sf_dir):
    return manifest.value_counts(fixtures.manifest(spark, sf_dir), ["dataset", "label_plane"])


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of slices made from the vectors: label decides the dataset, a few controls, repeats of ids."""
    e = fixtures.table(spark, sf_dir, "embeddings")
    i, label = F.col("vec_id"), F.col("label")
    return e.select(
        F.concat(F.lit("v"), (i % 400).cast("string")).alias("image_id"), F.concat(F.lit("s"), (i % 50).cast("string")).alias("subject_id"),
        F.when(i % 400 % 10 < 5, "brats").when(i % 400 % 10 < 8, "ixi").when(i % 400 % 10 == 8, "oasis").otherwise("vqa").alias("dataset"),
        F.lit("T1").alias("modality"), F.lit("axial").alias("plane"), F.concat(F.lit("/p/"), F.lpad(i.cast("string"), 9, "0")).alias("path"), (i % 400 % 17 == 0).alias("is_negative_control"),
        F.when(label > 5, "yes").alias("label_tumor_present"),
    )


@query(
    """with e as (select 'v' || (vec_id % 400) as image_id, 's' || (vec_id % 50) as subject_id, vec_id % 400 as j, '/p/' || lpad(vec_id::varchar, 9, '0') as path, case when label > 5 then 'yes' end as own, row_number() over (partition by vec_id % 400 order by vec_id) as r from embeddings),
    k as (select *, case when j % 17 = 0 then 'control' when j % 10 < 5 then 'tumor' when j % 10 < 9 then 'healthy' else 'other' end as kind from e where r = 1)
    select image_id, path, case when kind in ('tumor', 'healthy') then 'T1' else 'unknown' end as label_modality, case when kind = 'tumor' then 'yes' when kind in ('healthy', 'control') then 'no' else coalesce(own, 'unknown') end as label_tumor_present,
      case when kind = 'tumor' then (case when cast(substr(subject_id, 2) as int) % 3 = 0 then 'left' else 'unknown' end) when kind in ('healthy', 'control') then 'none' else 'unknown' end as label_laterality,
      case when kind = 'healthy' then 30.0 + cast(substr(subject_id, 2) as int) end as demo_age, case when kind = 'control' then 1 else 0 end as is_negative_control from k"""
)
def manifest_build(spark, sf_dir):
    subjects = spark.range(50).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject_id"), F.lit("F").alias("demo_sex"), (F.lit(30.0) + F.col("id")).alias("demo_age"))
    sides = spark.range(0, 50, 3).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject_id"), F.lit("left").alias("laterality"))
    out = manifest.build(_provenance(spark, sf_dir), subjects, sides)
    return out.select("image_id", "path", "label_modality", "label_tumor_present", "label_laterality", "demo_age", "is_negative_control")


MASK = "select vec_id, len(embedding) as n, len(list_filter(embedding, lambda v: v > 0)) as area, len(list_filter(embedding[33:], lambda v: v > 0)) as right_area from embeddings"


@query(
    f"""with m as ({MASK}) select vec_id, case when area > 0 then 'yes' else 'no' end as present, area as area_px, round(area::double / n, 6) as area_frac,
    case when area = 0 then 'none' when right_area::double / area >= 0.6 then 'right' when 1 - right_area::double / area >= 0.6 then 'left' else 'bilateral' end as laterality,
    case when area > 0 and area < 30 then 'no' when area > 0 then 'yes' else 'no' end as present_30 from m"""
)
def slice_labels(spark, sf_dir):
    e, mask = fixtures.table(spark, sf_dir, "embeddings"), F.col("embedding")
    present, area, fraction = manifest.slice_labels(mask)
    right, total = pixels.side_share(mask, lambda i: i, F.lit(31))
    out = e.select("vec_id", present.alias("present"), area.cast("long").alias("area_px"), fraction.alias("area_frac"), pixels.laterality(right, total).alias("laterality"))
    return out.withColumn("present_30", pixels.area_threshold(F.col("present"), F.col("area_px"), F.col("laterality"), 30)[0])


@query(
    """with p as (select vec_id, list_transform(embedding, lambda v: v::double) as e, quantile_cont(v, 0.01) as a, quantile_cont(v, 0.99) as b from (select vec_id, embedding, unnest(list_transform(embedding, lambda v: v::double)) as v from embeddings) group by vec_id, embedding)
    select vec_id, cast(list_sum([floor((greatest(a, least(b, v)) - a) / (b - a) * 255)::bigint for v in e]) as bigint) as total, len(e)::bigint as n from p"""
)
def intensity_normalize(spark, sf_dir):
    e = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", pixels.window_to_bytes(F.col("embedding")).alias("b"))
    return e.select("vec_id", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("b").cast("long").alias("n"))


@query("select vec_id, list_sum([embedding[cast(i * 4 + 3 as int)]::double for i in range(16)]) as axial, list_sum([v::double for v in embedding[33:48]]) as sagittal from embeddings")
def plane_slices(spark, sf_dir):
    e, shape = fixtures.table(spark, sf_dir, "embeddings"), F.array(F.lit(4), F.lit(4), F.lit(4))
    at = pixels.slice_index(F.lit(0.5), F.lit(4))
    total = lambda plane: F.aggregate(pixels.plane_slice(F.col("embedding"), shape, F.lit(plane), at), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", total("axial").alias("axial"), total("sagittal").alias("sagittal"))


@query("select vec_id, concat_ws('__', 'brats', 'S' || vec_id, 'T2', p, replace(printf('%.2f', f), '.', 'p')) as image_id from embeddings, (values ('axial'), ('sagittal'), ('coronal')) as t(p), (values (0.4::double), (0.5::double), (0.6::double)) as u(f)")
def slice_expansion(spark, sf_dir):
    v = manifest.expand_slices(fixtures.table(spark, sf_dir, "embeddings").select("vec_id"), ["axial", "sagittal", "coronal"], [0.4, 0.5, 0.6])
    return v.select("vec_id", ids.image_id(F.lit("brats"), F.concat(F.lit("S"), F.col("vec_id").cast("string")), F.lit("T2"), F.col("plane"), F.col("slice_frac")).alias("image_id"))


# --- samples, windows --------------------------------------------------------------------------------------------
HASH = "md5(concat_ws('|', '42', model, prompt_id))"


@query(f"{oracle.BASE} select model, prompt_id, pred_answer from graded order by {HASH}, model, prompt_id limit 50")
def random_audit_sample(spark, sf_dir):
    return reports.audit_sample(graded(spark, sf_dir)).select("model", "prompt_id", "pred_answer")


@query(
    f"""{oracle.BASE}, r as (select model, prompt_id, task, format, {HASH} as o, row_number() over (partition by task, format order by {HASH}, model, prompt_id) as n from graded), s as (select count(*) as c from (select distinct task, format from graded))
    select model, prompt_id, task, format from r, s where n <= greatest(1, 100 // c) order by n, o limit 100"""
)
def stratified_audit_sample(spark, sf_dir):
    return reports.audit_by_stratum(graded(spark, sf_dir)).select("model", "prompt_id", "task", "format")


@query(
    f"""{oracle.BASE}, p as (select * from graded where format = 'OE' and response is not null and (case when (select count(*) > 0 from graded where format = 'OE' and confidently_wrong) then confidently_wrong else not correct end)),
    r as (select model, prompt_id, task, {HASH} as o, row_number() over (partition by task order by {HASH}, model, prompt_id) as n from p), s as (select count(distinct task) as c from p)
    select model, prompt_id, task from r, s where n <= greatest(1, 6 // c) order by n, o limit 6"""
)
def failure_gallery(spark, sf_dir):
    return sampling.failure_gallery(graded(spark, sf_dir)).select("model", "prompt_id", "task")


WRAPPED = """select {columns}, coalesce(nullif(array_to_string(string_split(list_reduce(ws, lambda a, w: case when length(string_split(a, chr(10))[-1]) + 1 + length(w) <= 58 then a || ' ' || w else a || chr(10) || w end), chr(10))[1:5], chr(10)), ''), '(no statement)') as caption
  from (select *, list_filter(string_split_regex({text}, '[ \t\n\r]+'), lambda w: w <> '') as ws from {table}) x"""


@query(
    f"""{oracle.BASE}, p as (select * from graded where format = 'OE' and response is not null and (case when (select count(*) > 0 from graded where format = 'OE' and confidently_wrong) then confidently_wrong else not correct end)),
    r as (select model, prompt_id, task, response, {HASH} as o, row_number() over (partition by task order by {HASH}, model, prompt_id) as n from p), s as (select count(distinct task) as c from p),
    g as (select model, prompt_id, response from r, s where n <= greatest(1, 6 // c) order by n, o limit 6) {WRAPPED.format(columns="model, prompt_id", text="response", table="g")}"""
)
def gallery_captions(spark, sf_dir):
    return sampling.failure_gallery(graded(spark, sf_dir)).select("model", "prompt_id", sampling.caption(F.col("response")).alias("caption"))


@query(WRAPPED.format(columns="doc_id", text="replace(coalesce(text, ''), '-', ' ')", table="documents"))
def wrapped_captions(spark, sf_dir):
    """Captions of texts whose words are all shorter than a line, hyphens as blanks."""
    t = fixtures.table(spark, sf_dir, "documents")
    return t.select("doc_id", sampling.caption(F.translate("text", "-", " ")).alias("caption"))


@query(f"{oracle.BASE} select model, prompt_id, confidence from graded where is_negative_control and task = 'T3-ISBRAIN' and pred_answer = 'yes' and confidence is not null order by confidence desc, model, prompt_id limit 1")
def noise_hallucination(spark, sf_dir):
    return sampling.noise_example(graded(spark, sf_dir)).select("model", "prompt_id", "confidence")


@query(f"with responses as ({oracle.RESPONSES}) select model, image_id, task, ord from (select *, row_number() over (partition by model, image_id, task order by ord desc) as n from responses) where n = 1")
def dedup_latest_response(spark, sf_dir):
    return sampling.first_per_key(fixtures.responses(spark, sf_dir), ["model", "image_id", "task"], ["ord"], last=True).select("model", "image_id", "task", "ord")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where n = 1")
def first_turns(spark, sf_dir):
    return sampling.first_per_key(fixtures.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


@query(f"with m as ({oracle.MANIFEST}), s as (select subject_id from (select distinct subject_id from m) order by md5(concat_ws('|', '42', subject_id)), subject_id limit 10) select image_id, subject_id from m where subject_id in (select subject_id from s)")
def subject_subsample(spark, sf_dir):
    return sampling.subsample_subjects(fixtures.manifest(spark, sf_dir), "subject_id", 10).select("image_id", "subject_id")


@query(f"with m as ({oracle.MANIFEST}), r as ({oracle.RESPONSES}) select distinct image_id from r where image_id not in (select image_id from m)")
def responses_without_image(spark, sf_dir):
    return fixtures.responses(spark, sf_dir).select("image_id").distinct().join(fixtures.manifest(spark, sf_dir), "image_id", "left_anti")


@query(f"with m as ({oracle.MANIFEST}) select image_id, count(*) as n from m group by image_id having count(*) > 1")
def duplicated_images(spark, sf_dir):
    return grading.duplicated_images(fixtures.manifest(spark, sf_dir))


@query(f"with r as ({oracle.RESPONSES}) select task, count(*) as n from (select * from r where model like '%-0B%' union all select * from r where model like '%-1b%') group by task")
def union_of_shards(spark, sf_dir):
    r = fixtures.responses(spark, sf_dir)
    both = r.filter(F.col("model").contains("-0B")).unionByName(r.filter(F.col("model").contains("-1b")), allowMissingColumns=True)
    return both.groupBy("task").agg(F.count("*").alias("n"))


# --- incremental -------------------------------------------------------------------------------------------------
@query(
    f"""{oracle.BASE} select model, {oracle.share('correct', oracle.SCORED)} as accuracy, {oracle.count(oracle.SCORED)} as n, {oracle.count(oracle.SCORED)}::double / nullif({oracle.count('gradeable')}, 0) as coverage,
    avg(case when {oracle.SCORED} then pow(conf_frac - correct::int::double, 2) end) as brier, {oracle.share('hallucination', HALL)} as hallucination_rate, {oracle.share('abstained', oracle.ABST)} as abstention_appropriateness, any_value(e.ece) as ece
    from graded left join ({oracle.ece('graded', 'model')}) e using (model) group by model"""
)
def stream_metrics(spark, sf_dir):
    """The cells that the stream keeps, of two batches, merged."""
    from ..streaming.ingest import cells, metrics_of

    g = graded(spark, sf_dir)
    return metrics_of(cells(g.filter("ord % 2 = 0")).unionByName(cells(g.filter("ord % 2 = 1"))), ["model"])


LIVE = f"""{oracle.BASE} select a.*, balanced_acc, macro_f1, ece, late.n_late from
    (select model, {oracle.share('correct', oracle.SCORED)} as accuracy, {oracle.count(oracle.SCORED)} as n, round(avg(case when {oracle.SCORED} then pow(conf_frac - correct::int::double, 2) end), 10) as brier, {OVER},
      {oracle.share('hallucination', HALL)} as hallucination_rate, {oracle.share('abstained', oracle.ABST)} as abstention_appropriateness from graded group by model) a
    left join (select * exclude (n) from ({oracle.agreement('graded', 'model')})) using (model) left join (select model, ece from ({oracle.ece('graded', 'model')})) using (model)
    left join (select model, count(*) as n_late from responses where ord % 5 = 0 group by model) late using (model)"""


@query(LIVE)
def live_metrics(spark, sf_dir):
    """The suite from the state of a stream: three arrivals of answers, each with answers of the one before again, an arrival
    of new answers of long ago, and a batch that runs twice."""
    from ..session import scratch_folder
    from ..sources.readers import RESPONSES
    from ..streaming import ingest, live

    source, path, checkpoint = (scratch_folder(spark, x) for x in ("arrivals", "live", "live-checkpoint"))
    r, exam = fixtures.responses(spark, sf_dir), fixtures.manifest(spark, sf_dir)
    timed = r.withColumn("timestamp_utc", F.concat(F.lit("2026-01-0"), (F.col("ord") % 3 + 1).cast("string"), F.lit("T12:00:00+00:00")))
    old = timed.filter("ord % 5 = 0").withColumns({"timestamp_utc": F.lit("2025-01-01T00:00:00+00:00"), "prompt_id": F.concat(F.lit("old "), "prompt_id")})
    arrivals = [timed.filter((F.col("ord") % 3).isin(k, max(k - 1, 0))) for k in range(3)] + [old]
    for k, rows in enumerate(arrivals):
        rows.select(*[c for c in RESPONSES.names if c in rows.columns]).write.json(f"{source}/{k}")
        if k == 3:
            live.forget_commit(spark, checkpoint)
        live.start(ingest.read_stream(spark, f"{source}/*"), exam, path, checkpoint, delay_ms=48 * live.HOUR, salts=1).awaitTermination()
    suite = metrics.suite(live.latest_cells(spark, path), ["model"]).join(live.late_answers(spark, path).groupBy("model").agg(F.count("*").alias("n_late")), "model", "left")
    return suite.withColumn("brier", F.round("brier", 10)).select("model", "accuracy", "n", "brier", "overconfidence_index", "confidently_wrong_rate", "n_answered", "hallucination_rate", "abstention_appropriateness", "balanced_acc", "macro_f1", "ece", "n_late")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_accuracy(spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import source_queries, volume_queries  # noqa: F401  (they register their own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
