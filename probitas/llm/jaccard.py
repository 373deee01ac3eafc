"""N-gram Jaccard join by universe partition and pigeonhole: exact components of documents alike."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, buckets, join_unique, release, set_aside, stage, unstage
from .components import connected_components, extend_components
from .hashing import U, mix, window_hashes, word_hashes
from .shared import shared_hashes

#: Extra segments, at least and as a share of the most members two sets alike differ in: sets alike agree in one more.
SPARE, SPARE_SHARE = 4, 0.25
#: For the allocation's cost: the share of a band's documents that a set has some text in common with, and the chance
#: that it shares a given shingle with such a one.
PARTNERS, ALIKE = 0.001, 0.25


def shingles(data: bytes, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased; fewer words are one."""
    words = word_hashes(data, fold=True)[0]
    if len(words) < k:
        return window_hashes(words, len(words)) if len(words) else np.empty(0, np.uint64)
    return np.unique(window_hashes(words, k))


def set_name(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(most: int, share: int) -> list[int]:
    """First sizes of the bands; a set and any larger one alike lie in the same band or in neighbours."""
    first = [1]
    while first[-1] <= most:
        first.append(first[-1] * 100 // share + 1)
    return first


def allocate(top: int, share: int, docs: int) -> tuple[int, int, int]:
    """(exact, deletion, spare): how many segments of a band whose largest size is ``top`` are matched exactly, how
    many up to one deletion, and how many are extra.

    Two sets alike, the smaller of at most ``top`` shingles, differ in at most H = top * (100 - share) / share
    shingles. If no exact segment agreed and every deletion segment differed twice, they would differ in
    exact + 2 * deletion. With exact + 2 * deletion = H + 1 + spare, segments of a weight of 1 + spare must match
    (an exact one weighs 1, a deletion one 2). The cheapest split counts signatures sent and chance candidates met.
    """
    h = top * (100 - share) // share
    spare = max(SPARE, int(h * SPARE_SHARE))
    need = h + 1 + spare
    best = None
    for deletion in range(need // 2 + 1):
        exact = need - 2 * deletion
        segments = exact + deletion
        size = top / segments
        met = docs * PARTNERS
        cost = exact * (1 + met * ALIKE**size) + deletion * ((1 + size) + met * size * ALIKE ** max(0.0, size - 1))
        if best is None or cost < best[0]:
            best = (cost, exact, deletion)
    return best[1], best[2], spare


def signatures(h: np.ndarray, band: int, exact: int, deletion: int, spare: int = SPARE) -> tuple[np.ndarray, int]:
    """The set's signatures in one band's scheme, and how many of them any set alike has too, at least.

    A hash tells each shingle's segment; deletion segments come first and give the whole segment's hash and those
    without one of its shingles. Segments that agree make up 1 + spare of the scheme's count at least, where a
    deletion segment counts two; empty ones, which send nothing, may be among them.
    """
    segments = exact + deletion
    seg = (mix(h ^ U((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(33)).astype(np.int64) % segments
    value = mix(h + U(0x7F4A7C15))
    total = np.zeros(segments, np.uint64)
    np.add.at(total, seg, value)
    size = np.bincount(seg, minlength=segments)
    name = mix(np.arange(segments, dtype=np.uint64) + U((band << 32) % (1 << 64)) + U(1))
    empty_counts = (size[:deletion] <= 1).sum() * 2 + (size[deletion:] == 0).sum()
    use = np.ones(segments, bool) if empty_counts > spare else size > 0
    out = [mix(total[use] ^ name[use])]
    if deletion:
        cut = seg < deletion
        if empty_counts <= spare:
            cut &= size[seg] > 1
        out.append(mix((total[seg[cut]] - value[cut]) ^ name[seg[cut]]))
    need = max(1, 1 + spare - int(empty_counts)) if empty_counts <= spare else 1
    return np.concatenate(out), -(-need // 2) if deletion else need


def parities(h: np.ndarray) -> bytes:
    """The set's size in four bytes, and the parity of the number of its hashes in each of four to eight cells a
    member (a power of two, a bit each)."""
    cells = 1 << max(6, (4 * len(h) - 1).bit_length())
    odd = (np.bincount((h & U(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return len(h).to_bytes(4, "little") + np.packbits(odd, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (64-bit words along the last axis) of as many cells as ``words`` hold: those of halves are their xor."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of how many members two sets do not share: their cells of different parity."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def link_sets(docs: DataFrame, k: int = 4, share: int = 85) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four staged tables: (doc_id, key, n_shingles, set_id) of all rows, set_id a 64-bit name of the shingle set
    (null if empty); (set_id, least, rows) with each set's smallest doc_id and number of rows; (sig, set_id, n, own,
    need) of the signatures that several sets have, own where the band is the set's; (set_id, body, parities) with
    the shingle hashes of the sets that have any.
    """
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names = [], []
            for text in b.column(2).to_pylist():
                h = shingles((text or "").encode(), k)
                sizes.append(len(h))
                names.append(set_name(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["doc_id", "key", "n_shingles", "set_id"])
        release()

    sets = stage(docs.select("doc_id", "key", "text").mapInArrow(digest, "doc_id long, key long, n_shingles long, set_id long"), "sets")
    named = sets.filter(F.col("set_id").isNotNull())
    # One text stands for each set, that of the smallest (key, doc_id); the others are known by a list.
    stands = named.groupBy("set_id").agg(F.min(F.struct("key", "doc_id")).alias("_s"), F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    stands = stage(stands.select("set_id", "n", F.col("_s.key").alias("_k"), F.col("_s.doc_id").alias("_d"), "least", "rows"), "stands")
    several = stage(stands.filter("rows > 1").select("set_id", "_k", "_d", "rows"), "several")
    others = join_unique(named.select("set_id", "doc_id", "key"), several, "set_id", "rows")
    others = stage(others.filter(~(F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")))).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), "others", [several])
    first = bands(int(stands.agg(F.max("n")).first()[0] or 0), share)
    edges = np.array(first)
    # One count per band: a few dozen.
    band_of = F.size(F.filter(F.array(*[F.lit(x) for x in first]), lambda x: x <= F.col("n"))) - 1
    count = dict(stands.groupBy(band_of.alias("b")).agg(F.count("*")).collect())
    scheme = [allocate(first[b + 1] - 1, share, count.get(b, 0)) for b in range(len(first) - 1)]

    def sigs_of(h: np.ndarray) -> list[tuple[int, tuple[np.ndarray, int]]]:
        """By band: the set's own, where it may be the smaller one, and the one below, where it is the larger."""
        b = int(np.searchsorted(edges, len(h), "right")) - 1
        return [(x, signatures(h, x, *scheme[x])) for x in (b, b - 1) if x >= 0 and (first[x + 1] - 1) * (100 - share) // share > 0]

    def all_sigs(data: bytes) -> np.ndarray:
        h = shingles(data, k)
        return np.concatenate([np.empty(0, np.uint64), *(s for _, (s, _) in sigs_of(h))])

    single = docs.join(broadcast_if_small(others), F.expr("doc_id <=> _d AND key = _k"), "left_anti").filter(F.length("text") > 0)
    single = single.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "key", "text")
    sharing = shared_hashes(single, all_sigs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, bodies, cells, sigs, below, needs = [], [], [], [], [], [], []
            for text, shared in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "shared")), strict=True):
                h = shingles(text.encode(), k)
                known = np.frombuffer(b"".join(shared), np.uint32)
                found: list[list[int]] = [[], []]
                least = [0, 0]
                for band, (s, need) in sigs_of(h):
                    s = s[np.isin((s & U(0xFFFFFFFF)).astype(np.uint32), known)]
                    if len(s) >= need:  # with fewer that any other set has, no set is alike
                        which = band != int(np.searchsorted(edges, len(h), "right")) - 1
                        found[which], least[which] = s.view(np.int64).tolist(), need
                if not any(found):
                    continue
                for column, x in zip((ids, sizes, bodies, cells, sigs, below, needs), (set_name(h), len(h), h.tobytes(), parities(h), *found, least), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, sizes, bodies, cells, sigs, below, needs), kinds, strict=True)], ["set_id", "n", "body", "parities", "own", "below", "needs"])
        release()

    # joined by a shuffle at any size: both sides grow with the corpus
    content = stage(single.join(sharing, ["doc_id", "key"]).mapInArrow(describe, "set_id long, n long, body binary, parities binary, own array<long>, below array<long>, needs array<int>"), "content")
    part = lambda c: content.select(F.explode(c).alias("sig"), "set_id", "n", F.lit(c == "own").alias("own"), F.get("needs", F.lit(int(c != "own"))).alias("need"))
    rows = stage(part("own").unionByName(part("below")).distinct(), "signatures", [others, sharing])
    rows = stage(rarest(rows), "rarest", [rows])
    often = content.groupBy("set_id").agg(F.count("*").alias("c")).filter("c > 1")
    if not often.isEmpty():  # the very same row more than once
        content = stage(content.drop("own", "below", "needs").distinct(), "content", [content])
    return sets, stands.select("set_id", "least", "rows"), rows, content


def rarest(rows: DataFrame, cut: bool = True) -> DataFrame:
    """Rows of (sig, set_id, n, own, need) without those that cannot matter; ``cut`` leaves each set the rarest only.

    A signature counts that several sets have, one of them in its own band. Sets alike have ``need`` such in common
    at least, so a set of fewer is alike to none. The rarest of those they have in common, in one order of all
    signatures, is followed in both sets' lists by need - 1 others: with the need - 1 most frequent left out of each
    list, they still meet in it. So what very many documents share, a common passage, brings few sets together.
    """
    often = rows.groupBy("sig").agg(F.count("*").alias("c"), F.max("own").alias("led")).filter("c > 1 and led").drop("led")
    lists = rows.join(often, "sig").groupBy("set_id", "own").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("c", "sig"))).alias("s"))
    lists = lists.filter(F.size("s") >= F.col("need"))
    if cut:
        lists = lists.withColumn("s", F.slice("s", F.lit(1), F.size("s") - F.col("need") + 1))
    return lists.select("set_id", "n", "own", "need", F.explode("s.sig").alias("sig"))


#: Pairs of one block of the verification, and bytes of the contents that come with them.
BLOCK_PAIRS, BLOCK_BYTES = 20_000, 16 << 20


def by_blocks(pairs: DataFrame, content: DataFrame, column: str, alike: Callable[[bytes, bytes], bool], name: str) -> DataFrame:
    """Those of the staged ``pairs`` for whose ends ``alike(a's column, b's column)`` holds; ``pairs`` is deleted.

    Pairs are dealt to the cells of a square grid by the hashes of both ends, and a set's content goes once to
    each cell where it has a pair, not once with each pair; a set of very many pairs is spread over a row. The
    number of cells follows that of pairs and the bytes of their ends.
    """
    count = pairs.count()
    width = content.agg(F.avg(F.octet_length(column))).first()[0] or 0
    side = max(1, math.isqrt(max(buckets(content.sparkSession, 16), count // BLOCK_PAIRS, int(2 * count * width) // BLOCK_BYTES)))
    cell = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(side))
    dealt = pairs.select((cell("a", 1) * side + cell("b", 2)).alias("block"), "a", "b")
    ends = dealt.select(F.col("block").alias("cell"), F.explode(F.array("a", "b")).alias("set_id")).distinct()
    needed = ends.join(content.select("set_id", column), "set_id").select("cell", "set_id", column)

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(right.column("set_id").to_pylist(), right.column(column), strict=True))
        mask = [alike(held[x].as_buffer(), held[y].as_buffer()) for x, y in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)]
        out = left.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))
        del held
        release()
        return out

    return stage(dealt.groupBy("block").cogroup(needed.groupBy("cell")).applyInArrow(test, "a long, b long"), name, [pairs])


def verify(pairs: DataFrame, content: DataFrame, share: int) -> DataFrame:
    """Those of the staged ``pairs`` (a, b) whose sets are alike, exactly.

    Parities of some tenth of the sets' size are held together first: their distance is never above the sets'
    difference, so what they refuse is not alike. Only for what they let pass the sets are brought together.
    """

    def may_be(x: bytes, y: bytes) -> bool:
        x, y = bytes(x), bytes(y)
        return (100 + share) * least_difference(x[4:], y[4:]) <= (100 - share) * (int.from_bytes(x[:4], "little") + int.from_bytes(y[:4], "little"))

    return by_sets(by_blocks(pairs, content, "parities", may_be, "passed"), content, share)


def by_sets(pairs: DataFrame, content: DataFrame, share: int) -> DataFrame:
    """The exact test."""

    def alike(x: bytes, y: bytes) -> bool:
        both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= share * (len(both) - common)

    return by_blocks(pairs, content, "body", alike, "alike")


def _fits(share: int):
    return (100 * F.least("n", "m") >= share * F.greatest("n", "m")) & (F.col("a") != F.col("b"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likeliest(rows: DataFrame, share: int) -> DataFrame:
    """One pair for each set: with the one that leads most of its signatures (the smallest of the band's own)."""
    lead = rows.filter("own").groupBy("sig").agg(F.min(F.struct("set_id", "n")).alias("lead")).select("sig", F.col("lead.set_id").alias("b"), F.col("lead.n").alias("m"))
    met = rows.withColumnRenamed("set_id", "a").join(lead, "sig").filter(_fits(share))
    # the leaders of one set: as many as it has signatures at most
    return stage(_pairs(met.groupBy("a").agg(F.mode("b", True).alias("b"))), "likeliest")


def open_signatures(rows: DataFrame, component: DataFrame) -> DataFrame:
    """The rows of signatures whose sets are not all in one component yet, with their component; ``rows`` is deleted."""
    labelled = rows.join(component.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    ends = labelled.groupBy("sig").agg(F.count("*").alias("m"), *[f(F.struct("component", "set_id", "n", "own")).alias(k) for k, f in (("low", F.min), ("high", F.max))])
    ends = ends.filter(F.col("low.component") < F.col("high.component"))
    return stage(labelled.join(ends, "sig"), "open", [rows])


def across(open_: DataFrame, share: int) -> DataFrame:
    """For each open row one pair: with an end of its signature's components that is not its own."""
    end = F.when(F.col("component") != F.col("low.component"), F.col("low")).otherwise(F.col("high"))
    met = open_.withColumn("end", end).select(F.col("set_id").alias("a"), F.col("end.set_id").alias("b"), "n", F.col("end.n").alias("m"), (F.col("own") | F.col("end.own")).alias("ok"))
    return _pairs(met.filter(_fits(share) & F.col("ok")))


#: Open rows of one task of the last search.
SEARCH_ROWS = 20_000


def search_blocks(open_: DataFrame) -> DataFrame:
    """(block, part, sig, set_id, component): the open rows dealt to the tasks of the last search.

    Signatures are gathered in blocks by the smallest component they hold, so that a set and its parities go to
    few blocks; a block of more than SEARCH_ROWS rows is dealt to parts by signature, so a row is in one part. Only
    a single signature of more than SEARCH_ROWS sets is tiled: each set goes to the parts of all pairs of tiles that
    hold its own, and each pair of sets meets in one at least.
    """
    rows = open_.select(F.col("low.component").alias("block"), "sig", "set_id", "component", "m")
    common = rows.filter(F.col("m") <= SEARCH_ROWS).drop("m")
    large = common.groupBy("block").agg(F.ceil(F.count("*") / SEARCH_ROWS).cast("int").alias("parts")).filter("parts > 1")
    common = common.join(broadcast_if_small(stage(large, "large")), "block", "left")  # at most a row for SEARCH_ROWS rows
    common = common.withColumn("part", F.coalesce(F.pmod(F.xxhash64("sig"), F.col("parts")), F.lit(0)).cast("long")).drop("parts")
    tiles = F.ceil(2 * F.col("m") / SEARCH_ROWS).cast("long")
    tiled = rows.filter(F.col("m") > SEARCH_ROWS).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("tiles")))
    tiled = tiled.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    part = 1 + F.least("tile", "with") * F.col("tiles") + F.greatest("tile", "with")
    # a block of its own for each signature; parts from 1 on keep it apart from a component of the same number
    tiled = tiled.select(F.col("sig").alias("block"), "sig", "set_id", "component", (-part).alias("part"))
    return common.unionByName(tiled)


#: Pairs that a task of the last search holds before it cuts them to a forest.
FOREST_PAIRS = 200_000


def forest(label: np.ndarray, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y), nearest first, join components (``label``) that those before do not: a spanning
    forest, so of a forest and more pairs again."""
    up = {c: c for c in label.tolist()}
    out = []
    for i in np.argsort(apart, kind="stable").tolist():
        a, b = int(label[x[i]]), int(label[y[i]])
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            out.append(i)
    return np.array(out, np.int64)


def search(open_: DataFrame, content: DataFrame, share: int, spanning: bool) -> DataFrame:
    """Staged (a, b): the pairs of open rows of different components whose parities allow them to be alike.

    In a block each set outside the largest component is held against all members of its signatures at once;
    pairs that fail are never rows of a table. ``spanning``: only as many of each block as would join its components,
    the nearest by parities.
    """
    spread = search_blocks(open_)
    ends = spread.select(F.col("block").alias("at"), F.col("part").alias("of"), F.col("set_id").alias("member")).distinct()
    needed = ends.join(content.select(F.col("set_id").alias("member"), "parities"), "member").select("at", "of", "member", "parities")

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        sig, ids, component = (left.column(c).to_numpy() for c in ("sig", "set_id", "component"))
        names, who = np.unique(ids, return_inverse=True)
        label = np.zeros(len(names), np.int64)
        label[who] = component
        kinds, count = np.unique(label, return_counts=True)
        order = np.argsort(sig, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(sig[order])) + 1, [len(sig)]])
        group = np.zeros(len(sig), np.int64)
        group[order] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        by_set = np.argsort(who, kind="stable")
        own = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(names)))])
        held = dict(zip(right.column("member").to_pylist(), right.column("parities").to_pylist(), strict=True))
        size = np.array([int.from_bytes(held[i][:4], "little") for i in names.tolist()])
        cells = np.array([(len(held[i]) - 4) // 8 for i in names.tolist()])
        tables, place = {}, np.zeros(len(names), np.int64)
        for c in np.unique(cells).tolist():
            at = np.flatnonzero(cells == c)
            place[at] = np.arange(len(at))
            tables[c] = np.frombuffer(b"".join(held[i][4:] for i in names[at].tolist()), np.uint64).reshape(len(at), c)
        pairs = np.empty((3, 0), np.int64)
        more: list[np.ndarray] = []
        for x in np.flatnonzero(label != kinds[count.argmax()]).tolist():
            met = np.zeros(len(names), bool)
            for g in group[by_set[own[x] : own[x + 1]]].tolist():
                met[who[order[edge[g] : edge[g + 1]]]] = True
            met &= (label != label[x]) & (100 * np.minimum(size, size[x]) >= share * np.maximum(size, size[x]))
            for c, table in tables.items():
                y = np.flatnonzero(met & (cells == c))
                words = min(c, int(cells[x]))
                apart = np.bitwise_count(folded(table[place[y]], words) ^ folded(tables[int(cells[x])][place[x]], words)).sum(1, dtype=np.int64)
                good = (100 + share) * apart <= (100 - share) * (size[x] + size[y])
                more.append(np.stack([np.full(good.sum(), x), y[good], apart[good]]))
            if sum(m.shape[1] for m in more) > FOREST_PAIRS or len(more) > FOREST_PAIRS // 10:
                pairs, more = np.concatenate([pairs, *more], axis=1), []
                if spanning:
                    pairs = pairs[:, forest(label, *pairs)]
        pairs = np.concatenate([pairs, *more], axis=1)
        if spanning:
            pairs = pairs[:, forest(label, *pairs)]
        left_, right_ = names[pairs[0]], names[pairs[1]]
        del held, tables
        release()
        return pa.table([pa.array(np.minimum(left_, right_)), pa.array(np.maximum(left_, right_))], names=["a", "b"])

    pairs = spread.groupBy("block", "part").cogroup(needed.groupBy("at", "of")).applyInArrow(test, "a long, b long")
    return stage(pairs.distinct(), "search")


#: What is done about signatures that are open still: a pair for each row, a search of the nearest, one of all pairs.
STEPS = ("across", "spanning", "all")


def find_components(docs: DataFrame, k: int = 4, share: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Documents link when the Jaccard similarity of their sets of k-word shingles (A-Z lower-cased) is at least
    ``share`` percent; component_id is the smallest doc_id reachable. Equal sets are one node. Signatures tell
    candidates; each is verified exactly: every set with its likeliest partner first, then each set with one of
    another component that still shares a signature, then the nearest pairs that would join the components that do,
    at last all pairs between components that still do. So a group alike, which is one component by then, is never
    made into all its pairs. Texts without words (null ones too) have an empty set and stay alone; null doc_ids can
    link others and get the smallest id they reach (null where none); repeated rows get the same row each; columns
    other than doc_id and text are not read, whatever their names. Empty tables give an empty result.
    """
    sets, stands, rows, content = link_sets(docs, k, share)
    tested = likeliest(rows, share)
    component = stage(connected_components(verify(tested, content, share)), "components")
    for step in STEPS:
        open_ = open_signatures(rows, component)
        if open_.isEmpty():
            break
        rows = stage(open_.select(*rows.columns), "rows")  # signatures once closed stay closed
        if step == "across":
            new = verify(stage(across(open_, share), "pairs"), content, share)
        else:
            new = by_sets(search(open_, content, share, step == "spanning"), content, share)
        component = extend_components(component, new)
        unstage(open_)
    unstage(rows)
    unstage(content)
    labels = stands.join(component.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("_c", F.coalesce("component", "set_id")).select("set_id", "least", "rows", "_c")
    labels = stage(labels, "labels")
    smallest = stage(labels.groupBy("_c").agg(F.min("least").alias("component_id"), F.count("*").alias("_sets")), "smallest")
    final = stage(join_unique(labels, smallest, "_c", "_sets").select("set_id", "component_id", "rows"), "final", [labels, smallest])
    named = join_unique(sets.filter(F.col("set_id").isNotNull()), final, "set_id", "rows")
    alone = sets.filter(F.col("set_id").isNull()).withColumn("component_id", F.lit(None).cast("long"))
    return named.unionByName(alone).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "key")


def keep_one(docs: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.

    Rows that repeat entirely stay once; rows of one doc_id with different content all stay, as do rows with
    a null doc_id. Columns are those of ``docs``.
    """
    found = find_components(docs, k, share)
    drop = stage(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("key").alias("_key")).distinct(), "drop")
    often = stage(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "often")
    slim, restore = set_aside(docs, ["doc_id", "text"])
    out = slim.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit("")))).join(broadcast_if_small(drop), ["doc_id", "_key"], "left_anti")
    if often.isEmpty():
        return restore(out)
    return restore(out.join(broadcast_if_small(often), "doc_id", "left_anti").unionByName(out.join(broadcast_if_small(often), "doc_id", "left_semi").distinct()))
