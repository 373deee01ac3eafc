"""Model runners: a protocol, a deterministic stand-in, retries with a cache, and the distributed loop."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cache_key, utc_now_iso
from ..session import ship_package
from .runlog import RunLog

#: Seconds before each try of a call to a service.
RETRY_DELAYS = (0, 1, 2, 5, 10, 30)


class Runner(Protocol):
    """Loads once per worker, then answers batches of (prompt, image path) with text, raw and gen_seconds."""

    def load(self) -> None: ...

    def generate(self, prompts: list[str], images: list[str]) -> list[dict]: ...


class EchoRunner:
    """Answers from a hash of its input: for tests and dry runs."""

    ANSWERS = ("A. first\nConfidence: {c}", "Answer: B\nConfidence: {c}%", "UNSURE", "There is no mass. Confidence: {c}", "A tumor with edema on the right. Confidence: {c}")

    def __init__(self, model: str = "echo") -> None:
        self.model = model

    def load(self) -> None:
        pass

    def generate(self, prompts: list[str], images: list[str]) -> list[dict]:
        out = []
        for prompt, image in zip(prompts, images, strict=True):
            h = int.from_bytes(hashlib.sha256(f"{self.model}|{image}|{prompt}".encode()).digest()[:4], "big")
            text = self.ANSWERS[h % len(self.ANSWERS)].format(c=h // 7 % 101)
            out.append({"text": text, "raw": text, "gen_seconds": 0.0})
        return out


class RetryingRunner:
    """Wraps a single-call function of a service: tries again after growing pauses, then gives an empty text."""

    def __init__(self, call: Callable[[str, str], str], delays: tuple[float, ...] = RETRY_DELAYS) -> None:
        self.call, self.delays = call, delays

    def load(self) -> None:
        pass

    def generate(self, prompts: list[str], images: list[str]) -> list[dict]:
        return [self._one(p, i) for p, i in zip(prompts, images, strict=True)]

    def _one(self, prompt: str, image: str) -> dict:
        error, began = "", time.monotonic()
        for delay in self.delays:
            time.sleep(delay)
            try:
                text = self.call(prompt, image)
                return {"text": text, "raw": text, "gen_seconds": time.monotonic() - began}
            except Exception as e:  # a service fails in many ways; each is tried again
                error = str(e)
        return {"text": "", "raw": error, "gen_seconds": 0.0}


BACKENDS: dict[str, Callable[..., Runner]] = {"echo": EchoRunner}


def register_backend(name: str, factory: Callable[..., Runner]) -> None:
    BACKENDS[name] = factory


def make_runner(backend: str, *args, **options) -> Runner:
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[backend](*args, **options)


def key_present(variable: str) -> bool:
    """Whether a service's key is set; models without theirs are skipped."""
    return bool(os.environ.get(variable, ""))


def select_models(registry: DataFrame, model: str | None = None, index: int | None = None, optional: bool = False, ablation: bool = False) -> DataFrame:
    """Registry rows to run: one by its id; else those not optional and not for ablations only, unless asked;
    or the ``index``-th of these."""
    if model is not None:
        return registry.filter(F.col("id") == model)
    df = registry
    if not optional:
        df = df.filter(~F.col("optional"))
    if not ablation:
        df = df.filter(~F.col("ablation_only"))
    if index is not None:
        rows = df.select("id").collect()  # a registry has a few dozen rows
        if not 0 <= index < len(rows):
            raise IndexError(f"model {index} of {len(rows)}")
        return df.filter(F.col("id") == rows[index]["id"])
    return df


def run_model(prompts: DataFrame, model: str, factory: Callable[[], Runner], batch: int = 8, cache: DataFrame | None = None) -> DataFrame:
    """Responses of ``model`` to ``prompts``, with status ok, error or cached.

    Each worker loads the runner once and feeds it batches; the prompts of a failing batch are tried one by one, and
    those that fail by themselves give empty texts with status error, so one bad prompt costs no other its answer. ``cache`` (cache_key, response) answers what it knows without a call.
    """
    ship_package(prompts.sparkSession)
    prompts = prompts.withColumns({"model": F.lit(model), "cache_key": cache_key(F.lit(model), F.col("image_path"), F.col("prompt_text"))})
    known = None
    if cache is not None:
        known = prompts.join(cache.select("cache_key", "response"), "cache_key").withColumns({"gen_seconds": F.lit(0.0), "status": F.lit("cached")})
        prompts = prompts.join(cache, "cache_key", "left_anti")
    new = {"response": "string", "gen_seconds": "double", "status": "string"}
    prompts = prompts.drop(*new)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields), *(f"{k} {v}" for k, v in new.items())])

    def alone(runner: Runner, prompt: str, image: str) -> tuple[dict, str]:
        try:
            return runner.generate([prompt], [image])[0], "ok"
        except Exception as e:
            return {"text": "", "raw": str(e), "gen_seconds": 0.0}, "error"

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = factory()
        runner.load()
        for frame in batches:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                texts, images = list(part["prompt_text"]), list(part["image_path"])
                try:
                    got = runner.generate(texts, images)
                    status = ["ok"] * len(part)
                except Exception:  # one bad prompt must not end the run
                    got, status = zip(*[alone(runner, t, p) for t, p in zip(texts, images, strict=True)], strict=True)
                yield part.assign(response=[g["text"] for g in got], gen_seconds=[round(g["gen_seconds"], 3) for g in got], status=status)

    out = prompts.mapInPandas(answer, schema)
    if known is not None:
        out = out.unionByName(known.select(*out.columns))
    return out.withColumn("timestamp_utc", utc_now_iso())


def cacheable(responses: DataFrame) -> DataFrame:
    """(cache_key, response) of what may be kept: errors are not."""
    return responses.filter(F.col("status") != "error").select("cache_key", "response").dropDuplicates(["cache_key"])


def run_models(prompts: DataFrame, models: list[dict], out: str, batch: int = 8, dry_run: bool = False, check: Callable[[dict], Runner] | None = None, log: RunLog | None = None) -> list[tuple[str, str, int]]:
    """Append each model's responses to its own folder of JSON lines under ``out``; (model, status, prompts) of each.

    A prompt that has a response there already is not asked again, so a run that was stopped goes on where it was. A
    hosted model without its key is skipped, and so is one whose runner can not be made or, where ``check`` loads it
    first, not loaded; the others go on. A run that fails has status failed and what its tasks committed is kept.
    ``log`` is told each model's answers, errors and seconds.
    """
    from ..operators.prompts import pending
    from . import services
    from .readers import read_jsonl
    from .writers import append_json

    spark, report = prompts.sparkSession, []
    for spec in models:  # a registry has a few dozen rows
        model, backend = spec["id"], spec["backend"]
        folder = f"{out.rstrip('/')}/{model.replace('/', '__')}.jsonl"
        todo = pending(prompts, read_jsonl(spark, folder), model)
        n = todo.count()
        provider = services.PROVIDERS.get(spec.get("provider") or "")
        if n == 0 or dry_run:
            report.append((model, "done" if n == 0 else "to run", n))
            continue
        if backend == "api" and provider and not key_present(provider[1]):
            report.append((model, "no key", n))
            continue
        options = {k: v for k, v in spec.get("options", {}).items()}
        if backend == "api":
            options["provider"] = spec.get("provider")
        try:
            (check or (lambda s: make_runner(s["backend"], s["id"], **options)))(spec)
        except Exception as e:
            report.append((model, f"not loaded: {e}", n))
            continue
        try:
            answers = run_model(todo, model, lambda: make_runner(backend, model, **options), batch)  # noqa: B023
            write = lambda df: append_json(df, folder)  # noqa: B023, E731
            if log is None:
                write(answers)
            else:
                log.run(model, answers, write, total=n, errors=F.count_if(F.col("status") == "error"), gen_seconds=F.sum("gen_seconds"))
            report.append((model, "ok", n))
        except Exception as e:  # the next model may still run
            report.append((model, f"failed: {e}", n))
    return report
