"""Operators 11 to 13 against plain versions of their contracts, over odd rows, ties, repeats, long and empty input."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from probitas.llm import licenses, merkle, running, trie
from pyspark.sql import functions as F


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def many(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# --- running totals
@pytest.mark.parametrize("groups", [1, 3, 40])
def test_running_totals(spark, groups):
    rng = random.Random(groups)
    rows = [(f"g{rng.randrange(groups)}", None if i % 50 == 0 else i, rng.randrange(1 << 59)) for i in range(600)]
    for order, key in ((["o"], lambda r: (r[1] is not None, r[1] or 0)), (["-o"], lambda r: (r[1] is None, -(r[1] or 0)))):
        got = running.running(many(spark, rows, "g string, o long, v long"), "g", order, ["v"]).filter("o is not null").collect()
        want, total = {}, defaultdict(int)
        for g, o, v in sorted(rows, key=key):
            want[g, o] = total[g] & running.MASK
            total[g] += v
        assert {(r["g"], r["o"]): r["before_v"] for r in got} == {k: v for k, v in want.items() if k[1] is not None}


# --- 11
def plain_licenses(text, templates=licenses.TEMPLATES):
    ws = licenses.words_of(text)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    found, best = set(), 0.0
    for label, t in templates:
        tw = licenses.words_of(t)
        s, own = licenses.block_size(len(tw)), set(tw)
        for k in range(0, len(ws), s):
            shared = len(own & set(ws[k : k + 2 * s]))
            if 5 * shared >= 4 * len(own):
                found.add(label)
                best = max(best, shared / len(own))
    base = sorted({x for _, x in places})
    at = [i for i, _ in places]
    return (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(found | set(base))), 1.0 if at else best)


def test_licenses(spark, texts, docs, monkeypatch):
    mit, apache, gpl = (next(t for label, t in licenses.TEMPLATES if label == x and len(t) > 120) for x in ("mit", "apache", "gpl"))
    rng = random.Random(5)
    shuffled = mit.split()
    rng.shuffle(shuffled)
    filler = " ".join(f"word{i % 700}" for i in range(30_000))
    extra = [
        ("x " * 17 + mit + " tail", 1), (" ".join(shuffled), 2), (mit[: len(mit) // 2], 3), (apache.upper() + "\n\n" + gpl, 4), (filler + " " + gpl + " " + filler, 5),
        ("MIT LICENSE mit-license mit\x00license, general public\tlicense apache License", 6), ("éMIT license mit licenseé", 7), ("Creative Commons Attribution 4.0", 8), ("license " * 5000, 9), ("mit license " * 3000, 10),
    ]
    rows = [(i + 5_000_000, t) for t, i in extra] + [(None, "mit license"), (5_000_001, "x " * 17 + mit + " tail")]
    monkeypatch.setattr(licenses, "PIECE", 1000)
    table = docs.select("doc_id", "text").unionByName(many(spark, rows, "doc_id long, text string")).withColumns({"rid": F.lit("clash"), "blocks": F.lit(1), "labels": F.lit(None)})
    got = sorted((tuple(r) for r in licenses.scan(table).collect()), key=repr)
    every = [(r[0], r[1]) for r in texts] + rows
    assert got == sorted(((i, *plain_licenses(t)) for i, t in every), key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[5_000_001][6] == "mit" and by_id[5_000_001][7] == 1.0 and "gpl" in by_id[5_000_005][6] and by_id[5_000_003][6] == ""


def test_license_filters_lose_nothing(spark):
    """Blocks with every number of shared words around the threshold; words of equal and unequal frequency."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(60)]
    templates = [(f"t{n}", " ".join(rng.sample(words, n))) for n in (1, 2, 5, 7, 9, 16, 17, 31)]
    rows = []
    for i in range(300):
        own = rng.choice(templates)[1].split()
        rows.append((i, " ".join(rng.sample(own, rng.randrange(len(own) + 1)) + rng.choices([*words, "other"], k=rng.randrange(20)))))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(many(spark, rows, "doc_id long, text string"), templates).collect()}
    assert got == {i: plain_licenses(t, templates)[5:] for i, t in rows}
    assert 20 < sum(x[0] != "" for x in got.values()) < 300


def test_known_words_are_compared_by_bytes():
    v = licenses.Vocabulary(["license", "mit", "müller"])
    v.hashes = np.sort(v.hashes)
    n, at, ids = v.find("Licence MIT license MÜLLER müller mitx mit".encode())
    assert n == 7 and [(a, v.words[i]) for a, i in zip(at, ids, strict=True)] == [(1, "mit"), (2, "license"), (4, "müller"), (6, "mit")]
    h = licenses._word_hashes(b"other")[0]
    v.hashes, v.order = h, np.array([1])
    assert len(v.find(b"other")[1]) == 0  # a hash that is "mit"'s by accident


def test_licenses_of_nothing(spark, none):
    assert licenses.scan(none).count() == 0


# --- 12
def plain_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted results of the query."""

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        return [(level[i >> h ^ 1] if i >> h ^ 1 < len(level) else None, i >> h & 1) for h, level in enumerate(tree[:-1])]

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for j, k in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            steps = path(trees[k], i) + path(top, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = sha("".join(map(field, (*r[:3], r[3] + 1, r[4])))) if tampered else leaf
            for s, odd in steps:
                at = sha(at if s is None else s + at if odd else at + s)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], sha("".join(s for s, _ in steps if s)), at, at == top[-1][0]))
    return sorted(out, key=repr)


def merkle_query(docs, height):
    more = merkle.leaf_digest(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    out = merkle.verify(merkle.prove(docs, claim=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, more), height=height)).collect()
    return sorted(((r["doc_id"], r["digest"].hex(), r["subroot"].hex(), r["root"].hex(), r["proof_sha256"], r["folded_root"], r["folded_root"] == r["root"].hex()) for r in out), key=repr)


@pytest.mark.parametrize("height", [1, 3, 8])
def test_merkle_paths(spark, texts, height):
    rng = random.Random(height)
    rows = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in texts]
    rows += [(9_000_000 + i, "s", rng.choice(["aa", "ab", "é", "", "Z"]), rng.choice([None, i, (1 << 63) - 1]), "") for i in range(40)] + [(9_100_000, None, "lone", 1, "x")] * 1 + [(7, "s", "aa", 1, "t")] * 5
    table = many(spark, rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"digest": F.lit(1), "grp": F.lit("x"), "claim": F.lit(2)})
    assert merkle_query(table, height) == plain_merkle(rows)


@pytest.mark.parametrize("n", [1, 2])
def test_merkle_of_few(spark, n):
    rows = [(i, None, None, None, None) for i in range(n)]
    assert merkle_query(many(spark, rows, "doc_id long, source string, lang string, n_chars long, text string"), 8) == plain_merkle(rows)


def test_merkle_of_nothing(spark):
    assert merkle.verify(merkle.prove(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"))).count() == 0


@pytest.mark.parametrize("height,n", [(0, 1), (1, 2), (4, 16), (5, 32), (6, 41), (7, 1)])
def test_traversal_schedule(height, n):
    """Every sibling is ready when it is due, and few nodes are held."""
    leaves = [sha(str(i)).encode() for i in range(n)]
    levels = [[*leaves, *[None] * ((1 << height) - n)]]
    while len(levels[-1]) > 1:
        levels.append([merkle.combine(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    held, step = [0], merkle.Treehash.step
    seen = {}

    def watched(self):
        step(self)
        seen[self.height] = len(self.stack)
        held.append(sum(seen.values()))

    merkle.Treehash.step = watched
    try:
        got = list(merkle.traverse(leaves, height))
    finally:
        merkle.Treehash.step = step
    assert got == [[levels[h][i >> h ^ 1] for h in range(height)] for i in range(n)]
    assert max(held) <= 2 * height + 1
    assert merkle.build(leaves, height)[0] == levels[-1][0]


def test_tampering_shows(spark):
    leaves = [sha(str(i)).encode() for i in range(5)]
    root = merkle.build(leaves, 3)[0]
    for i, path in enumerate(merkle.traverse(leaves, 3)):
        raw = b"".join(bytes.fromhex(s.decode()) for s in path if s)
        assert merkle.fold_up(leaves[i], merkle.sides_of(i, path), raw) == root
        assert merkle.fold_up(leaves[i - 1], merkle.sides_of(i, path), raw) != root


# --- 13
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}")[:32], role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    members, ends, sums = defaultdict(list), defaultdict(list), {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        saved, leaves = sums.get(p, (0, 0))
        saved += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves += not children[p]
        sums[p] = (saved, leaves)
        if p:
            a, b = sums.get(p[:-1], (0, 0))
            sums[p[:-1]] = (a + saved, b + leaves)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sums[p][1], sums[p][0], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()), key=repr)


def conversation_rows(seed):
    """Shared starts of all lengths, copies, a hot first turn, a long conversation and its copy, ties and nulls."""
    rng = random.Random(seed)
    say = ["a", "b", "", "ä€", "longer text"]
    rows = []
    for c in range(260):
        n = rng.randrange(1, 9)
        rows += [(c, t, ("user", "assistant")[t % 2], "hello" if t == 0 and c % 3 else rng.choice(say)) for t in range(n)]
    for c in (400, 401, 402, 499):
        rows += [(c, t, "user", f"turn {t}") for t in range(150)]
    rows += [(499, 200, "user", "one more"), (500, 0, None, None), (501, None, "user", "first"), (501, None, "user", "first"), (501, 1, None, "x"), (501, 1, "system", None)]
    rows += [(None, 0, "user", "nobody's"), (100_007, 0, "user", "no base"), (100_008, 0, "user", "no base"), (100_009, 0, "user", "no base")]
    return [*rows, *rows[:5]]


@pytest.mark.parametrize("heavy", [1, 40, 600, 1 << 13])
def test_trie(spark, heavy):
    rows = conversation_rows(heavy)
    table = many(spark, rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "depth": F.lit("x"), "m": F.lit(3)})
    got = sorted((tuple(r) for r in trie.build(table, heavy_turns=heavy).collect()), key=repr)
    assert got == plain_trie(rows)


def test_trie_of_turnless(spark):
    """A conversation whose first turns a missing base should give has none: it is a member of the root alone."""
    alone = next(c for c in range(100_001, 100_100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(alone, 0, "user", "gone")]
    got = [tuple(r) for r in trie.build(many(spark, rows, "conv_id long, turn long, role string, text string", 1)).collect()]
    assert got == plain_trie(rows) == [(alone, 0, None, 1, 0, 1, 0, sha(str(alone)))]


def test_trie_of_nothing(spark):
    assert trie.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(1 if i % 3 else i, i) for i in range(500)]
    want = defaultdict(list)
    for rep, c in rows:
        want[rep].append(c)
    assert dict(trie.digest_members(many(spark, rows, "rep long, conv_id long")).collect()) == {r: sha(",".join(map(str, sorted(cs)))) for r, cs in want.items()}


def test_level_order_bits():
    """Roots 0 and 1; 0 has children 2 and 3, 3 has 4."""
    degrees = np.array([2, 0, 0, 1, 0])
    bits = trie.Louds.encode(degrees, 2)
    assert bits.tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 0]
    t = trie.Louds(bits)
    assert t.parents.tolist() == [-1, -1, 0, 0, 3] and t.degrees.tolist() == degrees.tolist() and t.n_roots == 2 and t.levels() == [(0, 2), (2, 4), (4, 5)]


def test_shards_are_files(spark, tmp_path):
    rows = conversation_rows(3)
    trie.build(many(spark, rows, "conv_id long, turn long, role string, text string"), path=str(tmp_path / "tries")).count()
    stored = spark.read.parquet(str(tmp_path / "tries"))
    assert stored.agg(F.sum("n_nodes")).first()[0] == len(plain_trie(rows)) - 1
    assert all(len(r["louds"]) == (2 * r["n_nodes"] + 8) // 8 for r in stored.collect())
