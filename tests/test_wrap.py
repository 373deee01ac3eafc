"""Wrapping against the standard library's on words of all kinds."""

import random
import textwrap

from probitas.functions.text import wrap
from probitas.operators import sampling
from pyspark.sql import functions as F

PARTS = ["a", "of", "well-known", "T1-weighted", "no--yes", "x" * 9, "1-2-3-4-5-6-7-8", "-----------", "é𝄞-ßü", "e-mail", "(left-sided)", "...", "ab-cd-ef-gh-ij", "--flag", "a--", "y" * 23 + "-" + "z" * 30, "'it's--\"so\""]


def test_wrap(spark):
    draw = random.Random(7)
    texts = ["", "   ", "one", "-" * 30, "x" * 100, None] + [" ".join(draw.choice(PARTS) for _ in range(draw.randrange(1, 25))) for _ in range(150)] + ["".join(draw.choice(PARTS) for _ in range(draw.randrange(1, 9))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = df.select("id", wrap(F.col("text"), 11).alias("all"), wrap(F.col("text"), 11, 3).alias("few")).collect()
    assert len(got) == len(texts)
    for r in got:
        # before a long word the library leaves the blank of a full line
        want = [x.rstrip() for x in textwrap.wrap(" ".join((texts[r["id"]] or "").split()), 11)]
        assert r["all"] == want, texts[r["id"]]
        assert r["few"] == want[:3], texts[r["id"]]


def test_caption(spark):
    df = spark.createDataFrame([(1, "word " * 400), (2, " \n\t "), (3, None)], "id int, text string")
    got = {r["id"]: r["c"] for r in df.select("id", sampling.caption(F.col("text")).alias("c")).collect()}
    assert got[1] == "\n".join(textwrap.wrap("word " * 400, 58)[:5]) and got[2] == got[3] == "(no statement)"
