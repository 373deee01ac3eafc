import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def texts(sf):
    """Rows of the smallest documents table, and odd ones: nulls, empties, repeats, ties, long texts."""
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet' order by doc_id").fetchall()
    base = 1_000_000
    words = [f"w{i % 97}x{i * i % 89}" for i in range(4000)]
    one, two = rows[3][1], rows[5][1]
    odd = [
        (base, None, "en", "src1"), (base + 1, "", None, None), (base + 2, " \n\t ", "en", "src1"), (base + 3, " ".join(words), "en", "src1"),
        (base + 4, " ".join(words[:2000]) + " eins zwei " + " ".join(words[2000:]), "en", "src1"), (base + 5, one, "en", "src2"),
        (base + 5, one, "en", "src2"), (base + 6, one + " more words at the end", "en", "src2"), (base + 7, "Head. " + two, "fr", "src0"),
        (base + 8, two[40:] + "\nTail", "fr", "src0"), (base + 9, "a b c", "en", "src3"), (base + 10, "a b c", "en", "src3"),
        (base + 11, "one two three four five six", "en", "src3"), (base + 12, "ONE two three four five six", "en", "src3"),
        (base + 13, "same " * 300, "en", "src3"), (base + 14, "same " * 300, "en", "src3"), (base + 15, "x" * 49, "en", "src4"), (base + 16, "y" * 500, "en", "src4"),
        (base + 17, "y" * 60 + "é" * 30, "en", "src4"), (base + 18, "<|endoftext|> mid<|endoftext|>word\x1c\x85　end", "en", "src4"), (None, one, "en", "src5"), (None, None, None, None),
        (base + 19, "123 456 789 !!!", "en", "src4"),
    ]
    return rows + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
