"""Pictures, hosted and local runners, the run loop, untimed answers of a stream, the command line."""

import sys
import types
import zlib

import numpy as np
import pytest
from probitas import __main__ as cli
from probitas.functions import png
from probitas.plans import fixtures
from probitas.sources import readers, runners, services, writers
from probitas.streaming import ingest


def filtered(pixels: np.ndarray, kind: int) -> bytes:
    """Rows with one filter of the PNG specification, byte by byte."""
    step, (height, width) = 1, pixels.shape
    at = lambda y, x: int(pixels[y, x]) if y >= 0 and x >= 0 else 0
    out = bytearray()
    for y in range(height):
        out.append(kind)
        for x in range(width):
            a, b, c = at(y, x - step), at(y - 1, x), at(y - 1, x - step)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((at(y, x) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return bytes(out)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 9)).astype(np.uint8)
    plain = png.encode(pixels, "né")
    assert png.decode(plain)[1] == "né" and (png.decode(plain)[0] == pixels).all()
    body = dict(png.chunks(plain))[b"IDAT"]
    other = plain.replace(png._chunk(b"IDAT", body), png._chunk(b"IDAT", zlib.compress(filtered(pixels, kind))))
    assert (png.decode(other)[0] == pixels).all()


def test_png_odd(spark):
    rows = spark.createDataFrame([(1, None, 2), (2, [1, 2, 3], 2), (3, [], 2), (4, [0, 255], 2)], "id int, pixels array<int>, width int")
    from pyspark.sql import functions as F

    got = rows.select("id", png.from_png(png.to_png(F.col("pixels"), F.col("width"), F.lit(None).cast("string"))).alias("p")).collect()
    assert {r["id"]: r["p"]["pixels"] for r in got} == {1: None, 2: None, 3: None, 4: [0, 255]}


@pytest.fixture
def picture(tmp_path):
    path = tmp_path / "a.png"
    path.write_bytes(png.encode(np.zeros((2, 2), np.uint8)))
    return str(path)


def test_services(monkeypatch, picture):
    asked = []

    class Client:
        chat = types.SimpleNamespace(completions=types.SimpleNamespace(create=lambda **k: asked.append(k) or types.SimpleNamespace(choices=[types.SimpleNamespace(message=types.SimpleNamespace(content="one"))])))
        messages = types.SimpleNamespace(create=lambda **k: asked.append(k) or types.SimpleNamespace(content=[types.SimpleNamespace(text="t"), types.SimpleNamespace(text="wo")]))

    monkeypatch.setitem(sys.modules, "openai", types.SimpleNamespace(OpenAI=Client))
    monkeypatch.setitem(sys.modules, "anthropic", types.SimpleNamespace(Anthropic=Client))
    for provider, want in (("openai", "one"), ("anthropic", "two")):
        runner = runners.make_runner("api", "m", provider=provider, system="be brief")
        monkeypatch.delenv(services.PROVIDERS[provider][1], raising=False)
        with pytest.raises(OSError):
            runner.load()
        monkeypatch.setenv(services.PROVIDERS[provider][1], "k")
        runner.load()
        assert runner.generate(["q"], [picture])[0]["text"] == want and asked[-1]["model"] == "m"
    with pytest.raises(ValueError):
        runners.make_runner("api", "m", provider="nobody")


def test_local_models(monkeypatch, picture):
    answer = lambda conversations: [f"{len(c)}:{c[-1]['content'][1]['text']}" for c in conversations]
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(pipeline=lambda *a, **k: lambda text, **o: [[{"generated_text": t}] for t in answer(text)]))
    chat = lambda self, conversations, sampling: [types.SimpleNamespace(outputs=[types.SimpleNamespace(text=t)]) for t in answer(conversations)]
    monkeypatch.setitem(sys.modules, "vllm", types.SimpleNamespace(LLM=type("L", (), {"__init__": lambda self, **k: None, "chat": chat}), SamplingParams=lambda **k: k))
    for backend in ("hf", "vllm"):
        runner = runners.make_runner(backend, "m", system="s")
        runner.load()
        assert [g["text"] for g in runner.generate(["a", "b"], [picture] * 2)] == ["2:a", "2:b"]


def test_run_models(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    rows = [(f"p{i}", f"i{i}", f"q{i}", "/x.png") for i in range(6)]
    prompts = spark.createDataFrame(rows, "prompt_id string, image_id string, prompt_text string, image_path string")
    models = [{"id": "v/a", "backend": "echo"}, {"id": "v/b", "backend": "api", "provider": "openai"}, {"id": "v/c", "backend": "no such"}]
    out = str(tmp_path / "out")
    assert [s for _, s, _ in runners.run_models(prompts, models, out, dry_run=True)] == ["to run"] * 3
    first = runners.run_models(prompts.limit(4), models, out)
    assert [(m, n) for m, _, n in first] == [("v/a", 4), ("v/b", 4), ("v/c", 4)] and [s for _, s, _ in first][:2] == ["ok", "no key"] and first[2][1].startswith("not loaded")
    assert runners.run_models(prompts, models[:1], out) == [("v/a", "ok", 2)]
    assert runners.run_models(prompts, models[:1], out) == [("v/a", "done", 0)]
    assert readers.read_all_responses(spark, out).select("prompt_id").distinct().count() == 6


def test_stream_keeps_untimed(spark, tmp_path):
    source, cells = str(tmp_path / "in"), str(tmp_path / "cells")
    exam = spark.createDataFrame([("i", "brats", 0)], "image_id string, dataset string, is_negative_control int")
    exam = exam.selectExpr("*", *[f"cast(null as string) as {c}" for c in ("label_modality", "label_plane", "label_tumor_present", "label_laterality", "slice_tumor_present", "slice_laterality")])
    times = [["2030-01-01T00:00:00+00:00", None], ["2030-01-02T00:00:00+00:00", "no time"], [None, "2001-01-01T00:00:00+00:00"], [None]]
    for i, batch in enumerate(times):
        rows = [("m", "i", f"p{i}-{j}", "T1-MOD", "neutral", "OE", "T1", t) for j, t in enumerate(batch)]
        rows += rows[:1] if i == 0 else []
        spark.createDataFrame(rows, "model string, image_id string, prompt_id string, task string, phrasing string, format string, response string, timestamp_utc string").coalesce(1).write.mode("append").json(source)
        ingest.start(ingest.read_stream(spark, source), exam, cells, str(tmp_path / "ck")).awaitTermination(120)
    n = spark.read.parquet(cells).groupBy().sum("n").first()[0]
    assert n == 6  # seven different ones; only the one of 2001 is late


def test_command_line(spark, sf, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda **_: spark)
    r, m = fixtures.responses(spark, sf), fixtures.manifest(spark, sf)
    writers.append_json(r.drop("ord"), str(tmp_path / "raw" / "a.jsonl"))
    kinds = {f.name: f.dataType for f in readers.MANIFEST.fields}
    from pyspark.sql import functions as F

    m = m.withColumn("path", F.concat(F.lit("/img/"), "image_id"))
    writers.write_csv(m.select(*[(F.col(c) if c in m.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]), str(tmp_path / "exam.csv"))
    common = ["--responses", str(tmp_path / "raw"), "--manifest", str(tmp_path / "exam.csv"), "--out", str(tmp_path / "out")]
    cli.main(["audit", *common, "--n", "10"])
    cli.main(["headline", *common])
    assert {"parser_audit_manual.csv", "safety_summary.csv", "headline_by_task.csv", "coverage_by_model.csv"} <= {p.name for p in (tmp_path / "out").iterdir()}
    (tmp_path / "models.json").write_text('{"models": [{"id": "v/x", "backend": "echo", "params_b": 7}, {"id": "v/y", "backend": "echo", "optional": true}]}')
    run = ["run", "--manifest", str(tmp_path / "exam.csv"), "--models", str(tmp_path / "models.json"), "--out", str(tmp_path / "new"), "--limit", "5"]
    cli.main([*run, "--dry-run"])
    cli.main(run)
    printed = capsys.readouterr().out
    assert "v/x\tto run\t5" in printed and "v/x\tok\t5" in printed and "v/y" not in printed
