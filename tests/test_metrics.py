"""Grading, metrics, resampling, sampling, streaming and sinks on hand-made fixtures."""

import numpy as np
import pandas as pd
import pytest
from probitas import config as C
from probitas.functions import ids, pixels
from probitas.operators import bootstrap, grading, manifest, metrics, prompts, sampling
from probitas.plans import fixtures, reports
from probitas.sources import readers, runners, writers
from probitas.streaming import ingest
from pyspark.sql import functions as F

GRADED = "model string, gt_label string, pred_answer string, conf_frac double, correct boolean, answered boolean, gradeable boolean"


def graded(spark, rows):
    return spark.createDataFrame([("m", *r, True, True) for r in rows], GRADED)


def test_calibration(spark):
    df = graded(spark, [("a", "a", 0.30, False), ("a", "a", 0.25, True), ("a", "a", 0.95, True), ("a", "a", 1.0, False)])
    assert metrics.calibration_error(df, ["model"]).first()["ece"] == pytest.approx(0.35)
    bins = {r["bin"]: (r["n"], r["acc"], r["conf"]) for r in metrics.reliability_bins(df, ["model"]).collect()}
    assert bins == {2: (2, 0.5, pytest.approx(0.275)), 9: (2, 0.5, pytest.approx(0.975))}


def test_brier_and_overconfidence(spark):
    df = graded(spark, [("a", "a", 0.9, True), ("a", "b", 0.8, False), ("a", "a", None, True)])
    assert tuple(metrics.brier(df, ["model"]).first()) == ("m", pytest.approx(0.325), 2)
    df = graded(spark, [("a", "b", 0.9, False), ("a", "b", 0.7, False), ("a", "a", 0.95, True), ("a", "b", None, False)])
    assert tuple(metrics.overconfidence(df, ["model"]).first()) == ("m", pytest.approx(0.8), 0.25, 4)


def test_agreement(spark):
    rows = [("a", "a", None, True), ("a", "a", None, True), ("a", "b", None, False), ("b", "b", None, True)]
    assert metrics.agreement(graded(spark, rows), ["model"]).first()["balanced_acc"] == pytest.approx((2 / 3 + 1) / 2)
    got = metrics.agreement(graded(spark, [*rows, ("a", "C ", None, False)]), ["model"]).first()
    assert got["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)


def test_every_edge_of_the_bins(spark):
    edges = np.linspace(0, 1, 11)
    got = spark.range(101).select((F.col("id").cast("double") / 100.0).alias("c")).select("c", metrics.bin_index(F.col("c")).alias("b")).collect()
    for r in got:
        want = 9 if r["c"] == 1 else next(i for i in range(10) if edges[i] <= r["c"] < edges[i + 1])
        assert r["b"] == want


def test_nan_and_null(spark):
    df = graded(spark, [("a", "a", float("nan"), True), ("a", "a", 0.5, True)])
    assert metrics.calibration_error(df, ["model"]).first()["n_conf"] == 1
    assert metrics.accuracy(df.withColumn("model", F.lit(None).cast("string")), ["model"]).count() == 0
    assert metrics.brier(df.limit(0), ["model"]).count() == 0


def test_grading(spark):
    exam = spark.createDataFrame([("i1", "T1", "axial", "yes", "left", "no", "none", 0), ("i2", "unknown", "unknown", "no", "none", "nan", "", 1)], "image_id string, label_modality string, label_plane string, label_tumor_present string, label_laterality string, slice_tumor_present string, slice_laterality string, is_negative_control int")
    rows = [
        ("i1", "T4-TUMOR", "OE", "yes", 90, ["tumor"], False, ("no", True, False, True, False, True)),
        ("i2", "T4-TUMOR", "OE", "yes", 90, ["tumor"], False, ("no", True, False, True, True, True)),
        ("i1", "T5-LAT", "OE", "right", 10, [], False, ("none", True, False, True, True, False)),
        ("i9", "T3-ISBRAIN", "MC", "yes", None, [], False, ("yes", True, True, True, False, False)),
        ("i2", "T3-ISBRAIN", "MC", "UNSURE", None, [], True, ("no", True, False, False, False, False)),
        ("i2", "T7-ABSTAIN", "MC", "UNSURE", None, [], False, ("UNSURE", True, True, True, False, False)),
        ("i2", "T1-MOD", "MC", "T1", 80, [], False, ("unknown", False, False, True, False, True)),
        ("i1", "T1-MOD", "MC", "t1 ", 80, [], False, ("t1", True, True, True, False, False)),
        ("i1", "T6-VQA", "OE", "UNPARSEABLE", 99, ["mass effect"], False, ("", False, False, False, False, False)),
    ]
    df = spark.createDataFrame([(i, *r[:7]) for i, r in enumerate(rows)], "k int, image_id string, task string, format string, pred_answer string, confidence int, asserted_findings array<string>, abstained boolean")
    got = grading.grade(df, exam).orderBy("k").select("gt_label", "gradeable", "correct", "answered", "hallucination", "confidently_wrong").collect()
    assert [tuple(r) for r in got] == [r[7] for r in rows]
    assert grading.duplicated_images(exam.union(exam)).count() == 2


def test_exact_bootstrap_is_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random(60)
    df = spark.createDataFrame([("g", i, float(v), f"s{i % 7}") for i, v in enumerate(x)], "g string, ord int, x double, s string").repartition(5)
    got = bootstrap.exact_interval(df, ["g"], "x", ["ord"], replicates=100).first()
    r = np.random.default_rng(42)
    stats = [np.mean(r.choice(x, size=60, replace=True)) for _ in range(100)]
    assert (got["ci_lo"], got["ci_hi"]) == (pytest.approx(np.percentile(stats, 2.5)), pytest.approx(np.percentile(stats, 97.5)))
    got = bootstrap.exact_interval(df, ["g"], "x", ["ord"], replicates=50, cluster="s").first()
    assert got["ci_lo"] < got["stat"] < got["ci_hi"]


def test_samples(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4).cast("string").alias("task"))
    a, b = (sorted(r["id"] for r in sampling.random_sample(d, 20, ["id"]).collect()) for d in (df, df.repartition(9)))
    assert a == b and len(set(a)) == 20
    got = sampling.stratified_sample(df, 10, ["task"], ["id"]).groupBy("task").count().collect()
    assert [r["count"] for r in got] == [2, 2, 2, 2]
    first = sampling.first_per_key(df, ["task"], ["id"]).collect()
    assert sorted(r["id"] for r in first) == [0, 1, 2, 3]
    assert sampling.subsample_subjects(df, "task", 2).count() == 500 and sampling.subsample_subjects(df, "task", 9).count() == 1000
    assert sampling.audit_sheet(df, ["id", "gone"]).columns == ["id", *sampling.AUDIT_BLANKS]


def test_pixels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    at = lambda f, n: one(pixels.slice_index(F.lit(f), F.lit(n)))
    assert (at(0.5, 5), at(0.5, 7), at(1.0, 10)) == (2, 4, 9)
    values = [float(v) for v in np.random.default_rng(1).normal(size=200)]
    lo, hi = np.percentile(values, [1, 99])
    want = ((np.clip(values, lo, hi) - lo) / (hi - lo) * 255).astype(int).tolist()
    got = one(pixels.window_to_bytes(F.array(*[F.lit(v) for v in values])))
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) <= 1
    assert one(pixels.window_to_bytes(F.array(F.lit(2.0), F.lit(2.0)))) == [0, 0]
    cube = np.arange(24).reshape(2, 3, 4)
    for plane, want in {"axial": cube[:, :, 1], "sagittal": cube[1], "coronal": cube[:, 1, :]}.items():
        got = one(pixels.plane_slice(F.array(*[F.lit(int(v)) for v in cube.ravel()]), F.array(F.lit(2), F.lit(3), F.lit(4)), F.lit(plane), F.lit(1)))
        assert got == want.ravel().tolist()
    assert one(ids.image_id(F.lit("brats"), F.lit("S1"), F.lit("T2"), F.lit("axial"), F.lit(0.4))) == "brats__S1__T2__axial__0p40"
    assert [one(pixels.laterality(F.lit(r), F.lit(n))) for r, n in ((6, 10), (4, 10), (5, 10), (0, 0))] == ["right", "left", "bilateral", "none"]
    assert [one(pixels.slice_laterality(F.lit("sagittal"), F.lit(i), F.lit(5), F.lit(1), F.lit(9))) for i in (7, 5)] == ["right", "left"]
    boxed = one(pixels.letterbox(F.array(*[F.lit(9)] * 8), F.lit(2), F.lit(4), 8))
    assert len(boxed) == 64 and boxed.count(9) == 32
    small = [one(c) for c in pixels.area_threshold(F.lit("yes"), F.lit(24), F.lit("left"))]
    assert small == ["no", "none"] and [one(c) for c in pixels.area_threshold(F.lit("yes"), F.lit(25), F.lit("left"))] == ["yes", "left"]


def test_prompts(spark):
    exam = spark.createDataFrame([("i1", "brats", "s1", "T2", "axial", "yes", "left", 0, "/a.png"), ("i2", "negative_controls", "s2", "unknown", "unknown", "no", "none", 1, "/b.png")], "image_id string, dataset string, subject_id string, label_modality string, label_plane string, label_tumor_present string, label_laterality string, is_negative_control int, path string")
    matrix = prompts.render(exam, prompts.task_table(spark, C.default_tasks()), prompts.template_table(spark, C.default_prompts()), "sys")
    n = matrix.groupBy("image_id").count().collect()
    assert {r["image_id"]: r["count"] for r in n} == {"i1": 3 * (5 * 2 + 1), "i2": 3 * 4}
    row = matrix.filter("prompt_id = 'i1__T1-MOD__neutral__mc'").first()
    assert sorted(row["mc_options"]) == sorted(C.ANSWER_SPACES["T1-MOD"]) and row["mc_options"][ord(row["mc_correct_letter"]) - 65] == "T2"
    assert [C.ANSWER_SPACES["T1-MOD"][i] for i in row["mc_option_order"]] == row["mc_options"]
    assert "A. " + row["mc_options"][0] + "  B. " in row["prompt_text"] and row["format"] == "MC"
    done = spark.createDataFrame([("m", "i1", "i1__T1-MOD__neutral__mc")], "model string, image_id string, prompt_id string")
    assert prompts.pending(matrix, done, "m").count() == matrix.count() - 1 and prompts.pending(matrix, done, "other").count() == matrix.count()
    assert sum(prompts.shard(matrix, k, 3).count() for k in range(3)) == matrix.count() and prompts.shard(matrix, 0, 1, 5).count() == 5
    examples = F.array(*[F.struct(F.lit("Q" * 300).alias("prompt_text"), F.lit("yes").alias("label"), F.lit(None).cast("int").alias("confidence"))] * 3)
    text = spark.range(1).select(prompts.few_shot_prefix(examples)).first()[0]
    assert text.count("Example ") == 2 and "Q" * 200 in text and "Q" * 201 not in text and "(Confidence: 90)" in text
    out = runners.run_model(matrix, "m", lambda: runners.EchoRunner("m"), cache=None).select("response", "status").collect()
    assert len(out) == matrix.count() and all(r["status"] == "ok" and r["response"] for r in out)


def test_failing_runner(spark):
    class Bad(runners.EchoRunner):
        def generate(self, prompts, images):
            if "boom" in prompts:
                raise RuntimeError("no")
            return super().generate(prompts, images)

    df = spark.createDataFrame([("p1", "boom", "/x"), ("p2", "fine", "/x")], "prompt_id string, prompt_text string, image_path string").coalesce(1)
    got = {r["prompt_id"]: r["status"] for r in runners.run_model(df, "m", Bad, batch=1).collect()}
    assert got == {"p1": "error", "p2": "ok"}
    tries = []
    flaky = runners.RetryingRunner(lambda p, i: tries.append(1) or (_ for _ in ()).throw(OSError("x")) if len(tries) < 2 else "ok", delays=(0, 0, 0))
    assert flaky.generate(["p"], ["i"])[0]["text"] == "ok"
    with pytest.raises(ValueError):
        runners.make_runner("none")
    registry = fixtures.registry(spark)
    assert runners.select_models(registry).count() == 5 and runners.select_models(registry, optional=True).count() == 6 and runners.select_models(registry, index=0).count() == 1
    with pytest.raises(IndexError):
        runners.select_models(registry, index=9)


def test_manifest(spark):
    rows = [("a", "s1", "brats", "T1", "axial", "/1", False), ("a", "s1", "brats", "T1", "axial", "/0", False), ("b", "s2", "ixi", "T2", "coronal", "/2", False), ("c", "s3", "x", "PD", "axial", "/3", True), ("d", "s4", "vqa", "PD", "axial", "/4", False), (None, "s5", "x", "", "", "/5", False)]
    prov = spark.createDataFrame(rows, "image_id string, subject_id string, dataset string, modality string, plane string, path string, is_negative_control boolean")
    people = spark.createDataFrame([("s2", "F", 40.0)], "subject_id string, demo_sex string, demo_age double")
    slices = spark.createDataFrame([("a", "yes", 10, 0.1, "left")], "image_id string, slice_tumor_present string, slice_tumor_area_px int, slice_tumor_area_frac double, slice_laterality string")
    got = {r["image_id"]: r for r in manifest.build(prov, people, None, slices).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"]["path"] == "/0"
    assert (got["a"]["label_tumor_present"], got["a"]["label_laterality"], got["a"]["slice_tumor_present"], got["a"]["slice_tumor_area_px"]) == ("yes", "unknown", "no", 10)
    assert (got["b"]["label_tumor_present"], got["b"]["demo_age"], got["b"]["slice_tumor_present"], got["b"]["slice_tumor_area_px"]) == ("no", 40.0, "unknown", -1)
    assert (got["c"]["label_modality"], got["c"]["is_negative_control"]) == ("unknown", 1) and got["d"]["label_tumor_present"] == "unknown"


def test_discovery(spark):
    paths = spark.createDataFrame([(p,) for p in ["/r/BraTS-GLI-00001-000/BraTS-GLI-00001-000-t1c.nii.gz", "/r/BraTS-GLI-00001-000/BraTS-GLI-00001-000-seg.nii.gz", "/r/x/plain_t2.nii.gz"]], "path string")
    got = [tuple(r) for r in readers.discover(paths, "brats").select("subject_id", "modality").collect()]
    assert got == [("BraTS-GLI-00001-000-t1c.nii.gz", "T1ce"), ("x", "T2")]
    assert readers.discover(paths, "brats", True).filter("modality = 'T1ce'").first()["subject_id"] == "BraTS-GLI-00001-000"
    assert readers.segmentation_files(paths).first()["mask_path"].endswith("seg.nii.gz")
    other = spark.createDataFrame([("/i/IXI002-Guys-0828-T1.nii.gz",), ("/i/IXI002-Guys-0828-DTI-03.nii.gz",), ("/o/OAS1_0001.nii.gz",)], "path string")
    assert [tuple(r) for r in readers.discover(other.filter("path like '/i%'"), "ixi").select("subject_id", "modality").collect()] == [("IXI002", "DWI"), ("IXI002", "T1")]
    assert readers.discover(other.filter("path like '/o%'"), "oasis").first()["subject_id"] == "OAS1"
    ixi = spark.createDataFrame([("2", "2", "35.8"), ("x", "1", "1")], ["IXI_ID ", "SEX_ID (1=m, 2=f)", "AGE"])
    assert [tuple(r) for r in readers.ixi_demographics(ixi).collect()] == [("IXI002", "F", 35.8)]
    assert tuple(readers.oasis_demographics(spark.createDataFrame([("OAS1", "M", 70)], ["ID", "M/F", "Age"])).first()) == ("OAS1", "M", 70.0)
    noise = readers.noise_controls(spark, {"gaussian": 2, "salt_pepper": 1, "blurred_uniform": 1, "other": 1}, 8).collect()
    assert all(len(r["pixels"]) == 64 and 0 <= min(r["pixels"]) <= max(r["pixels"]) <= 255 for r in noise) and len(noise) == 5


def test_files(spark, tmp_path, sf):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "b.jsonl").write_text('{"model": "m", "image_id": "i", "prompt_id": "p", "response": "x"}\n\nnot json\n')
    (folder / "a.jsonl").write_text('{"model": "m2", "image_id": "i", "prompt_id": "p"}\n')
    got = readers.read_all_responses(spark, str(folder))
    assert got.filter("model is not null").count() == 2 and readers.malformed_lines(spark, str(folder / "b.jsonl")).count() == 1
    assert [r["model"] for r in readers.read_all_responses(spark, str(folder), ordered=True).filter("model is not null").orderBy("ord").collect()] == ["m2", "m"]
    assert readers.read_jsonl(spark, str(tmp_path / "gone.jsonl")).count() == 0
    df = spark.createDataFrame([("a", [1, 2], 0.5)], "k string, v array<int>, x double")
    writers.write_csv(df, str(tmp_path / "t.csv"))
    assert pd.read_csv(tmp_path / "t.csv").to_dict("records") == [{"k": "a", "v": "[1,2]", "x": 0.5}]
    writers.write_csv(df.limit(0), str(tmp_path / "t.csv"))
    assert list(pd.read_csv(tmp_path / "t.csv").columns) == ["k", "v", "x"]
    path = str(tmp_path / "table")
    df.write.parquet(path)
    for n in (2, 3):
        writers.replace_table(spark.read.parquet(path).withColumn("n", F.lit(n)), path)
    assert spark.read.parquet(path).first()["n"] == 3 and "n" not in spark.read.parquet(path + ".bak").columns
    writers.append_json(df, str(tmp_path / "j"))
    writers.append_table(df, str(tmp_path / "p"), ["k"])
    writers.write_tables({"one": df}, str(tmp_path))
    assert (tmp_path / "one.csv").exists() and writers.pgm([1, 2], 1, 2, "note").startswith(b"P5\n# note\n2 1\n255\n")


def test_stream_equals_batch(spark, tmp_path, sf):
    responses = fixtures.responses(spark, sf).select("model", "image_id", "prompt_id", "task", "phrasing", "format", "mc_options", "response", "gen_seconds")
    exam = fixtures.manifest(spark, sf)
    source = str(tmp_path / "in")
    responses.filter("crc32(prompt_id) % 2 = 0").coalesce(1).write.mode("append").json(source)
    for extra in ("crc32(prompt_id) % 2 = 1", "crc32(prompt_id) % 10 = 0"):  # the last are repeats
        ingest.start(ingest.read_stream(spark, source), exam, str(tmp_path / "cells"), str(tmp_path / "ck"), delay=None).awaitTermination(120)
        responses.filter(extra).coalesce(1).write.mode("append").json(source)
    ingest.start(ingest.read_stream(spark, source), exam, str(tmp_path / "cells"), str(tmp_path / "ck"), delay=None).awaitTermination(120)
    got = {r["model"]: r for r in ingest.metrics_of(spark.read.parquet(str(tmp_path / "cells")), ["model"]).collect()}
    g = reports.graded_table(responses, exam)
    want = metrics.accuracy(g, ["model"]).join(metrics.calibration_error(g, ["model"]), "model").join(metrics.brier(g, ["model"]).drop("n"), "model").collect()
    for r in want:
        m = got[r["model"]]
        assert (m["n"], m["accuracy"], m["ece"], m["brier"]) == (r["n"], pytest.approx(r["accuracy"]), pytest.approx(r["ece"]), pytest.approx(r["brier"]))


def test_reports(spark, sf, tmp_path):
    g = reports.graded_table(fixtures.responses(spark, sf), fixtures.manifest(spark, sf)).persist()
    for name, df in (reports.diagnostic_tables(g, fixtures.manifest(spark, sf)) | reports.headline_tables(g)).items():
        assert df.count() > 0, name
    assert {"ci_lo", "ci_hi"} <= set(reports.main_accuracy(g, intervals=True).columns)
    assert metrics.parser_agreement(spark.createDataFrame([("1", ""), ("no", "yes")], ["parser_agrees_answer", "parser_agrees_conf"])).first().asDict() == {"parser_agrees_answer": 0.5, "parser_agrees_conf": 1.0}
    g.unpersist()


def test_tables_carry_all_intervals(spark, sf):
    g = reports.graded_table(fixtures.responses(spark, sf), fixtures.manifest(spark, sf)).limit(400).persist()
    tables = reports.diagnostic_tables(g, fixtures.manifest(spark, sf))
    want = {
        "main_accuracy": {"accuracy": "", "balanced_acc": "balanced_acc_", "macro_f1": "macro_f1_", "ece": "ece_", "brier": "brier_", "hallucination_rate": "hallucination_", "abstention_appropriateness": "abstention_"},
        "calibration": {"ece": "ece_", "brier": "brier_"},
        "hallucination": {"hall_rate": "hall_", "abs_rate": "abs_"},
    }
    for name, metric in want.items():
        rows = tables[name].collect()
        for value, prefix in metric.items():
            assert any(r[value] is not None for r in rows), (name, value)
            for r in rows:
                low, high = r[f"{prefix}ci_lo"], r[f"{prefix}ci_hi"]
                assert (r[value] is None) == (low is None) == (high is None), (name, value, r)
                assert low is None or 0 <= low <= high <= 1, (name, value, r)
    g.unpersist()


def test_configuration(tmp_path):
    (tmp_path / "t.yaml").write_text('tasks:\n  Q1:\n    answer_space: ["yes", "no"]\n    applies_to_datasets: [d]\n    answer_space_aliases: {"yes": [sure]}\n')
    task = C.load_tasks(str(tmp_path / "t.yaml"))[0]
    assert (task.task, task.answer_space, task.aliases) == ("Q1", ["yes", "no"], {"yes": ["sure"]})
    (tmp_path / "p.yaml").write_text("system_prompt: s\nphrasings:\n  neutral:\n    description: d\n    Q1: {mc: 'x {options}', oe: y}\n")
    assert C.load_prompts(str(tmp_path / "p.yaml")) == ("s", {("neutral", "Q1", "mc"): "x {options}", ("neutral", "Q1", "oe"): "y"})
    (tmp_path / "m.json").write_text('{"models": [{"id": "a", "params_b": 7}]}')
    assert C.load_models(str(tmp_path / "m.json"))[0]["optional"] is False
    table = C.alias_table()
    assert len(table) == 92 and dict(table)["none"] == "none"


def test_suite_makes_its_cells_once(spark, tmp_path):
    """The suite is one chain: the responses are scanned once."""
    from probitas.operators import metrics

    rows = [("m", "t", "MC", "a", "a" if i % 3 else "b", bool(i % 3), True, True, 0.1 * (i % 11), False, False) for i in range(60)]
    frame = spark.createDataFrame(rows, "model string, task string, format string, gt_label string, pred_answer string, correct boolean, answered boolean, gradeable boolean, conf_frac double, hallucination boolean, abstained boolean")
    frame.selectExpr("*", "false as is_negative_control").write.parquet(f"{tmp_path}/graded")
    plan = metrics.suite(metrics.cells(spark.read.parquet(f"{tmp_path}/graded"), ["model"]), ["model"])
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1, final
