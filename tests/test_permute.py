"""The seeded shuffle against NumPy's own, in Python, in Spark and in SQL."""

import duckdb
import numpy as np
import pytest
from probitas.functions import permute
from pyspark.sql import functions as F


def numpy_order(seed, n):
    x = list(range(n))
    np.random.default_rng(seed).shuffle(x)
    return x


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 20])
def test_many_seeds(n):
    rng = np.random.default_rng(n)
    count = 100_000 if n == 7 else 2_000
    seeds = np.concatenate([[0, 1, 2**32 - 1, 2**32, 2**63], rng.integers(0, 2**32, count), rng.integers(0, 2**63, 500)]).astype(np.uint64)
    assert permute.permutations(seeds, n).tolist() == [numpy_order(s, n) for s in seeds.tolist()]


def test_words_and_states():
    seeds = np.array([0, 7, 2**32 - 1, 2**40 + 3], np.uint64)
    words, g = permute.seed_words(seeds), permute.Generators(seeds)
    low, high = g.next32(np.ones(4, bool)), g.next32(np.ones(4, bool))
    for i, s in enumerate(seeds.tolist()):
        assert [int(w[i]) for w in words] == np.random.SeedSequence(s).generate_state(4, np.uint64).tolist()
        assert int(high[i]) << 32 | int(low[i]) == int(np.random.PCG64(s).random_raw())


def test_columns(spark):
    rows = [(i, ["a", "b", "c", "d", "e", "f", "g"][: i % 8], i * 7919 % 2**32) for i in range(300)] + [(900, None, 5), (901, ["x", "y"], None)]
    df = spark.createDataFrame(rows, "k int, o array<string>, seed long").repartition(5)
    shuffled, order = permute.seeded_shuffle(F.col("o"), F.col("seed"))
    got = {r["k"]: (r["s"], r["i"]) for r in df.select("k", shuffled.alias("s"), order.alias("i")).collect()}
    for k, o, seed in rows:
        p = None if o is None or seed is None else numpy_order(seed, len(o))
        assert got[k] == ((None, None) if p is None else ([o[i] for i in p], p))


def test_sql():
    rows = duckdb.sql(f"with {permute.sql('select s::bigint * 4294967 as seed, 1 + s % 16 as n from range(1000) t(s)')} select seed, n, ord from permuted").fetchall()
    assert len(rows) == 1000 and all(o == numpy_order(s, n) for s, n, o in rows)
