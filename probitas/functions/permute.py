"""NumPy's seeded shuffle of short lists, for whole columns of seeds at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the public generators: seed hashing and the 128-bit congruential step --------------------------
INIT_A, MULT_A, INIT_B, MULT_B = 0x43B0D7E5, 0x931E8875, 0x8B51F9DD, 0x58F38DED
MIX_L, MIX_R, POOL = 0xCA01F9DD, 0x4973F715, 4
STEP_HIGH, STEP_LOW = 2549297995355413924, 4865540595714422341
# -----------------------------------------------------------------------------------------------------------------
U32, U64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def _constants(start: int, factor: int):  # noqa: ANN202
    """Pairs of successive powers: what the hash xors with, and what it multiplies by."""
    while True:
        after = start * factor & U32
        yield start, after
        start = after


def _hashed(value: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    value = (value ^ np.uint64(pair[0])) * np.uint64(pair[1]) & np.uint64(U32)
    return value ^ value >> np.uint64(16)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x * np.uint64(MIX_L) - y * np.uint64(MIX_R) & np.uint64(U32)
    return out ^ out >> np.uint64(16)


def seed_words(seeds: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit words a seed (unsigned, 64 bits), as a seed sequence of it gives them."""
    s, constant = seeds.astype(np.uint64), _constants(INIT_A, MULT_A)
    zero = np.zeros_like(s)
    pool = [_hashed(x, next(constant)) for x in (s & np.uint64(U32), s >> np.uint64(32), zero, zero)]
    for i in range(POOL):
        for j in range(POOL):
            if i != j:
                pool[j] = _mixed(pool[j], _hashed(pool[i], next(constant)))
    constant = _constants(INIT_B, MULT_B)
    words = [_hashed(pool[i % POOL], next(constant)) for i in range(8)]
    return [words[2 * i] | words[2 * i + 1] << np.uint64(32) for i in range(4)]


def _times(a: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The high and the low 64 bits of products."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & np.uint64(U32), np.uint64(b >> 32), np.uint64(b & U32)
    low, left, right = a0 * b0, a1 * b0, a0 * b1
    middle = (low >> np.uint64(32)) + (left & np.uint64(U32)) + (right & np.uint64(U32))
    return a1 * b1 + (left >> np.uint64(32)) + (right >> np.uint64(32)) + (middle >> np.uint64(32)), a * np.uint64(b)


class Generators:
    """A generator of 128 bits for each seed; `next32` draws where it is told to, low halves first."""

    def __init__(self, seeds: np.ndarray) -> None:
        high, low, seq_high, seq_low = seed_words(seeds)
        one = np.uint64(1)
        self.inc = (seq_high << one | seq_low >> np.uint64(63), seq_low << one | one)
        self.state = self.inc  # a step from zero
        total = self.state[1] + low
        self.state = (self.state[0] + high + (total < low), total)
        self.step(np.ones(len(low), bool))
        self.rest, self.has = np.zeros_like(low), np.zeros(len(low), bool)

    def step(self, where: np.ndarray) -> None:
        high, low = self.state
        carry, product = _times(low, STEP_LOW)
        new_low = product + self.inc[1]
        new_high = carry + high * np.uint64(STEP_LOW) + low * np.uint64(STEP_HIGH) + self.inc[0] + (new_low < product)
        self.state = (np.where(where, new_high, high), np.where(where, new_low, low))

    def next32(self, where: np.ndarray) -> np.ndarray:
        fresh = where & ~self.has
        self.step(fresh)
        high, low = self.state
        x, turn = high ^ low, high >> np.uint64(58)
        word = x >> turn | x << ((np.uint64(64) - turn) & np.uint64(63))
        out = np.where(self.has, self.rest, word & np.uint64(U32))
        self.rest = np.where(fresh, word >> np.uint64(32), self.rest)
        self.has = np.where(where, fresh, self.has)
        return out

    def upto(self, most: int) -> np.ndarray:
        """A number of 0..most each, without bias: as many low bits as it takes, drawn again where they are too many."""
        mask, again = np.uint64((1 << most.bit_length()) - 1), np.ones(len(self.has), bool)
        out = np.zeros(len(self.has), np.uint64)
        while again.any():
            out = np.where(again, self.next32(again) & mask, out)
            again &= out > np.uint64(most)
        return out.astype(np.int64)


def permutations(seeds: np.ndarray, n: int) -> np.ndarray:
    """len(seeds) x n: what ``default_rng(seed).shuffle`` makes of the list 0..n-1."""
    out = np.tile(np.arange(n), (len(seeds), 1))
    draws, rows = Generators(seeds), np.arange(len(seeds))
    for i in range(n - 1, 0, -1):
        j = draws.upto(i)
        out[rows, i], out[rows, j] = out[rows, j].copy(), out[:, i].copy()
    return out


def seeded_shuffle(options: Column, seed: Column) -> tuple[Column, Column]:
    """Options in the order of NumPy's seeded shuffle, and their original indices; null where there are none."""

    @F.pandas_udf("array<int>")
    def order(size: pd.Series, seed: pd.Series) -> pd.Series:
        out: list[list[int] | None] = [None] * len(size)
        for n in size.dropna().unique():
            at = np.flatnonzero((size == n) & seed.notna())
            for i, p in zip(at, permutations(seed.iloc[at].to_numpy().astype(np.uint64), int(n)).tolist(), strict=True):
                out[i] = p
        return pd.Series(out, dtype=object)

    made = order(F.when(options.isNotNull(), F.size(options)), seed)
    return F.transform(made, lambda i: F.get(options, i)), made


def sql(seeds: str) -> str:
    """DuckDB's tables from ``seeds`` (seed of 32 bits, n, other columns) to ``permuted``, with ``ord``: the same by layers
    of integer arithmetic, for up to 16 options and 40 draws."""
    layers, count = [f"l0 as (select *, {{}} from ({seeds}))"], 0

    def layer(**columns: str) -> None:
        nonlocal count
        if count == 0 and "{}" in layers[0]:
            layers[0] = layers[0].format(", ".join(f"{e} as {c}" for c, e in columns.items()))
            return
        count += 1
        old = [f"{e} as {c}" for c, e in columns.items() if c in known]
        new = [f"{e} as {c}" for c, e in columns.items() if c not in known]
        layers.append(f"l{count} as (select *{f' replace ({", ".join(old)})' if old else ''}{''.join(', ' + x for x in new)} from l{count - 1})")

    known: set[str] = set()

    def add(**columns: str) -> None:
        layer(**columns)
        known.update(columns)

    spread = lambda x: f"xor({x}, ({x}) >> 16)"
    hashed = lambda x, pair: spread(f"((xor({x}, {pair[0]}::ubigint) * {pair[1]}::ubigint) & {U32}::ubigint)")
    constant = _constants(INIT_A, MULT_A)
    add(**{f"m{i}": hashed("seed::ubigint" if i == 0 else "0::ubigint", next(constant)) for i in range(POOL)})
    for i in range(POOL):
        for j in range(POOL):
            if i != j:
                add(h=hashed(f"m{i}", next(constant)))
                add(**{f"m{j}": spread(f"((((m{j} * {MIX_L}::ubigint) & {U32}::ubigint) + {1 << 32}::ubigint - ((h * {MIX_R}::ubigint) & {U32}::ubigint)) & {U32}::ubigint)")})
    constant = _constants(INIT_B, MULT_B)
    add(**{f"w{i}": hashed(f"m{i % POOL}", next(constant)) for i in range(8)})
    word = lambda i: f"(w{2 * i}::uhugeint + w{2 * i + 1}::uhugeint * {1 << 32}::uhugeint)"
    m64, two64 = f"{U64}::uhugeint", f"{1 << 64}::uhugeint"
    add(ih=f"(({word(2)} * 2) % {two64}) + {word(3)} // {1 << 63}::uhugeint", il=f"(({word(3)} * 2) % {two64}) + 1")
    add(sl=f"il + {word(1)}", sh=f"ih + {word(0)}")
    add(sh=f"(sh + sl // {two64}) % {two64}", sl=f"sl % {two64}")

    def step() -> None:
        add(a=f"sl * {STEP_LOW}::uhugeint", b=f"(sh * {STEP_LOW}::uhugeint) & {m64}", c=f"(sl * {STEP_HIGH}::uhugeint) & {m64}")
        add(sl=f"(a & {m64}) + il", sh=f"(a // {two64}) + b + c + ih")
        add(sh=f"(sh + sl // {two64}) % {two64}", sl=f"sl % {two64}")

    step()
    draws = []
    for _ in range(20):
        step()
        add(x="xor(sh, sl)", r="(sh // 288230376151711744::uhugeint)::int")
        add(x=f"((x // power2[r + 1]) + ((x * power2[65 - r]) % {two64})) % {two64}")
        draws.append(f"(x % {1 << 32}::uhugeint)::bigint, (x // {1 << 32}::uhugeint)::bigint")
        add(draws=f"[{draws[-1]}]" if len(draws) == 1 else f"list_concat(draws, [{draws[-1]}])")
    mask = "list_filter([1, 3, 7, 15], lambda v: v >= z.i)[1]"
    swapped = "list_transform(z.o, lambda v, q: case when q - 1 = z.i then z.o[(d.d & " + mask + ") + 1] when q - 1 = (d.d & " + mask + ") then z.o[z.i + 1] else v end)"
    add(ord=f"list_reduce(list_concat([{{'d': 0::bigint, 'i': n::bigint - 1, 'o': range(n::bigint)}}], list_transform(draws, lambda v: {{'d': v, 'i': 0::bigint, 'o': []::bigint[]}})), lambda z, d: {{'d': 0::bigint, 'i': case when z.i < 1 or (d.d & {mask}) > z.i then z.i else z.i - 1 end, 'o': case when z.i < 1 or (d.d & {mask}) > z.i then z.o else {swapped} end}}).o")
    powers = ", ".join(f"{1 << i}::uhugeint" for i in range(65))
    layers[0] = layers[0].replace("select *, ", f"select *, [{powers}] as power2, ", 1)
    return ",\n".join(layers) + f",\npermuted as (select * from l{count})"
