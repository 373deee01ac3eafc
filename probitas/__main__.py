"""Command line: ``python -m probitas {aggregate,headline,audit,run} ...``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .operators import prompts
from .plans import reports
from .session import get_session
from .sources import readers, runlog, runners, writers


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="probitas", description=__doc__)
    top.add_argument("--master", help="Spark master; by default the one that spark-submit names")
    sub = top.add_subparsers(dest="command", required=True)
    for name, note in (("aggregate", "diagnostic tables"), ("headline", "tables of the models with enough usable answers"), ("audit", "a stratified sample to read by hand")):
        p = sub.add_parser(name, help=note)
        p.add_argument("--responses", required=True, help="folder of *.jsonl")
        p.add_argument("--manifest", required=True, help="exam as CSV or Parquet")
        p.add_argument("--out", required=True)
        if name == "headline":
            p.add_argument("--min-coverage", type=float, default=C.MIN_COVERAGE)
        if name == "audit":
            p.add_argument("--n", type=int, default=100)
            p.add_argument("--seed", type=int, default=42)
    p = sub.add_parser("run", help="ask models")
    for option in ("--manifest", "--models", "--out"):
        p.add_argument(option, required=True)
    for option in ("--tasks", "--prompts", "--model", "--metrics"):
        p.add_argument(option)
    for option, default in (("--index", None), ("--limit", None), ("--shard", 0), ("--shards", 1), ("--batch", 8)):
        p.add_argument(option, type=int, default=default)
    for option in ("--optional", "--ablation", "--dry-run"):
        p.add_argument(option, action="store_true")
    return top


def _graded(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    exam = readers.read_manifest(spark, args.manifest)
    return reports.graded_table(readers.read_all_responses(spark, args.responses), exam), exam


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    system, templates = C.load_prompts(args.prompts) if args.prompts else (C.SYSTEM_PROMPT, C.default_prompts())
    tasks = C.load_tasks(args.tasks) if args.tasks else C.default_tasks()
    exam = readers.read_manifest(spark, args.manifest)
    matrix = prompts.render(exam, prompts.task_table(spark, tasks), prompts.template_table(spark, templates), system)
    matrix = prompts.shard(prompts.with_images(matrix, exam), args.shard, args.shards, args.limit)
    full = {m["id"]: m for m in C.load_mapping(args.models).get("models", [])}
    from .schemas import REGISTRY

    registry = spark.createDataFrame([[float(m[c]) if c == "params_b" and m[c] is not None else m[c] for c in REGISTRY.names] for m in C.load_models(args.models)], REGISTRY)
    chosen = [full[r["id"]] for r in runners.select_models(registry, args.model, args.index, args.optional, args.ablation).collect()]
    log = runlog.RunLog(runlog.table_sink(spark, args.metrics)) if args.metrics else None
    for model, status, n in runners.run_models(matrix, chosen, args.out, args.batch, args.dry_run, log=log):
        print(f"{model}\t{status}\t{n}")


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = get_session(master=args.master)
    if args.command == "run":
        _run(spark, args)
        return
    graded, exam = _graded(spark, args)
    if args.command == "aggregate":
        tables = reports.diagnostic_tables(graded.persist(), exam)
    elif args.command == "headline":
        subjects = exam.select("image_id", "subject_id").dropDuplicates(["image_id"])
        tables = reports.headline_tables((graded if "subject_id" in graded.columns else graded.join(subjects, "image_id", "left")).persist(), args.min_coverage)
    else:
        tables = {"parser_audit_manual": reports.audit_by_stratum(graded, args.n, args.seed)}
    writers.write_tables(tables, args.out)
    for name, df in tables.items():
        if name != "graded_all":
            print(name)
            df.show(20, truncate=24)


if __name__ == "__main__":
    main()
