"""Prefix tries of conversations: rebuilt turns, succinct level-order shards, and their rollups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, buckets, join_unique, new_folder, release, stage, unstage
from .running import MASK, running

#: A base conversation is the one whose number ends in two zeros; up to HEADS - 1 of its turns come first.
BASE, HEADS = 100, 6
#: A node with more turns than this in and below it (over distinct conversations) is of the upper levels.
HEAVY = 1 << 13
#: A shard's trie is written once it has so many turns.
FLUSH = 1 << 15
#: Decimal ids are hashed in pieces of so many.
PIECE = 1 << 14


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): 16 bytes that name role and text (null: empty), code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.unhex(F.left(name, F.lit(32))).alias("digest"), F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, len, depth from 1, digest, chars), and all conversations (conv_id, len).

    Conversation c begins with the first crc32(c) % HEADS turns of c - c % BASE and goes on with its own after as many.
    """
    turns = stage(turn_digests(conversations), "turns")
    placed = stage(running(turns, "conv_id", ["turn", "digest"], ["one"]).select("conv_id", "before_one", "digest", "chars"), "placed", [turns])
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = placed.filter((F.col("conv_id") % BASE == 0) & (F.col("before_one") < HEADS - 1))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")
    of_base = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("n_base"))
    own = counts.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), h.alias("h")).join(of_base, "base", "left")
    skip = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = stage(own.select("conv_id", "base", "h", skip.alias("skip"), (skip + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len"), F.col("n").alias("rows")), "convs")
    kept = join_unique(placed, convs.select("conv_id", "h", "skip", "len", "rows"), "conv_id", "rows").filter(F.col("before_one") >= F.col("h"))
    kept = kept.select("conv_id", "len", (F.col("skip") + F.col("before_one") - F.col("h") + 1).alias("depth"), "digest", "chars")
    # at most BASE conversations meet the HEADS - 1 turns of one base
    first = convs.select("conv_id", "len", "base", "h").join(heads.select(F.col("conv_id").alias("base"), "before_one", "digest", "chars"), "base").filter(F.col("before_one") < F.col("h"))
    first = first.select("conv_id", "len", (F.col("before_one") + 1).alias("depth"), "digest", "chars")
    return stage(kept.unionByName(first), "rebuilt"), convs.select("conv_id", "len")


def node_name(depth: str, a: str, b: str) -> F.Column:
    return F.concat_ws(":", F.col(depth).cast("string"), F.col(a).cast("string"), F.col(b).cast("string"))


def with_nodes(rows: DataFrame) -> DataFrame:
    """Turns with the names of their node and its parent: the depth and two sums of 60 bits over the turns up to it,
    each turn hashed with its depth. Sums, not chains, so that a conversation of any length is summed in parts."""
    at = F.col("depth").cast("string")
    number = lambda salt: F.conv(F.left(F.md5(F.concat(F.hex("digest"), F.lit(salt), at)), F.lit(15)), 16, 10).cast("long")
    summed = running(stage(rows.withColumns({"f": number("a"), "g": number("b"), "up": F.col("depth") - 1}), "hashed"), "conv_id", ["depth"], ["f", "g"])
    both = summed.withColumns({c: (F.col(f"before_{c}") + F.col(c)).bitwiseAND(F.lit(MASK)) for c in ("f", "g")})
    return both.select("conv_id", "len", "depth", "digest", "chars", node_name("depth", "f", "g").alias("node"), node_name("up", "before_f", "before_g").alias("parent"))


#: The name of the node without turns.
ROOT = "0:0:0"
TRIE = "roots array<string>, above array<string>, depths array<int>, n_nodes long, louds binary, labels binary, conv_ids binary, n_convs binary, chars binary, ends binary"
TRIE_NAMES = [c.split()[0] for c in TRIE.split(", ")]


class Louds:
    """A forest in level order as a bit string: for each node, the forest's top first, a 1 for each child, then a 0."""

    def __init__(self, bits: np.ndarray) -> None:
        ones = bits.astype(bool)
        zeros = np.flatnonzero(~ones)
        self.degrees = np.diff(zeros, prepend=-1) - 1
        # the i-th 1 is node i: the zeros before it are those of the top and of the nodes before its parent; the top is -1
        self.parents = np.cumsum(~ones)[ones] - 1
        self.n_roots = int(self.degrees[0]) if len(zeros) else 0
        self.degrees = self.degrees[1:]

    @staticmethod
    def encode(degrees: np.ndarray, n_roots: int) -> np.ndarray:
        every = np.concatenate([[n_roots], degrees])
        bits = np.ones(int(every.sum()) + len(every), np.uint8)
        bits[np.cumsum(every + 1) - 1] = 0
        return bits

    def levels(self) -> list[tuple[int, int]]:
        """[first, end) of each level."""
        below = np.concatenate([[0], np.cumsum(self.degrees)]) + self.n_roots
        out, first, end = [], 0, self.n_roots
        while first < end:
            out.append((first, end))
            first, end = end, int(below[end])
        return out


def build_trie(seqs: list[tuple]) -> dict:
    """The trie of sequences (root, above, conv_id, m, depth, labels, chars) that are not equal to each other: its
    nodes in level order. Sequences of one root share their first turn; a root's parent, ``above``, is not here."""
    lengths = np.array([len(s[5]) for s in seqs])
    labels, label = np.unique(np.array([x for s in seqs for x in s[5]], "S16"), return_inverse=True)
    chars = np.array([x for s in seqs for x in s[6]], np.int64)
    conv, m = np.array([s[2] for s in seqs], np.int64), np.array([s[3] for s in seqs], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    names = {s[0]: (i, s) for i, s in reversed(list(enumerate(seqs)))}
    number = {r: i for i, r in enumerate(names)}
    at = np.array([number[s[0]] for s in seqs])  # the node of each sequence at this level
    alive, total, n_roots = np.arange(len(seqs)), len(number), len(number)
    parts: list[tuple] = []
    level, parents = 0, [np.full(n_roots, -1)]
    first_of_level = 0
    while True:
        n = total - first_of_level
        local = at - first_of_level
        low, count = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        np.minimum.at(low, local, conv[alive])
        np.add.at(count, local, m[alive])
        own_label, own_chars, ends = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        own_label[local], own_chars[local] = label[offsets[alive] + level], chars[offsets[alive] + level]
        done = lengths[alive] == level + 1
        ends[local[done]] = conv[alive[done]]  # distinct sequences: one at most ends at a node
        parts.append((own_label, low, count, own_chars, ends))
        alive, at = alive[~done], at[~done]
        if not len(alive):
            break
        level += 1
        key = at * (len(labels) + 1) + label[offsets[alive] + level]
        fresh, at = np.unique(key, return_inverse=True)
        parents.append(fresh // (len(labels) + 1))
        first_of_level, at = total, at + total
        total += len(fresh)
    own_label, low, count, own_chars, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    degrees = np.zeros(total, np.int64)
    np.add.at(degrees, np.concatenate(parents[1:]).astype(np.int64) if len(parents) > 1 else np.empty(0, np.int64), 1)
    raw = b"".join(bytes(x).ljust(16, b"\0") for x in labels[own_label])
    return {
        "roots": list(number), "above": [names[r][1][1] for r in number], "depths": [names[r][1][4] for r in number], "n_nodes": total,
        "louds": np.packbits(Louds.encode(degrees, n_roots)).tobytes(), "labels": raw, "conv_ids": low.tobytes(), "n_convs": count.tobytes(), "chars": own_chars.tobytes(), "ends": ends.tobytes(),
    }


NODES = "conv_id long, depth long, parent_conv_id long, above string, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"
NODE_NAMES = [c.split()[0] for c in NODES.split(", ")]


def roll_up(row: dict) -> dict[str, np.ndarray | list]:
    """The nodes of a stored trie, with what their subtrees sum to: levels are added to their parents, last first."""
    n = row["n_nodes"]
    tree = Louds(np.unpackbits(np.frombuffer(row["louds"], np.uint8))[: 2 * n + 1])
    numbers = {c: np.frombuffer(row[c], np.int64) for c in ("conv_ids", "n_convs", "chars", "ends")}
    up = tree.parents
    saved, leaves, depth = (numbers["n_convs"] - 1) * numbers["chars"], (tree.degrees == 0).astype(np.int64), np.zeros(n, np.int64)
    levels = tree.levels()
    depth[: tree.n_roots] = row["depths"]
    for first, end in levels[1:]:
        depth[first:end] = depth[up[first:end]] + 1
    for first, end in reversed(levels[1:]):
        np.add.at(saved, up[first:end], saved[first:end])
        np.add.at(leaves, up[first:end], leaves[first:end])
    parent = pa.array(numbers["conv_ids"][up], pa.int64(), mask=up < 0)
    above = [*row["above"], *[None] * (n - tree.n_roots)]
    return {"conv_id": numbers["conv_ids"], "depth": depth, "parent_conv_id": parent, "above": above, "n_convs": numbers["n_convs"], "n_children": tree.degrees, "n_leaves": leaves, "saved_tokens": saved, "ends": pa.array(numbers["ends"], pa.int64(), mask=numbers["ends"] < 0)}


def write_tries(light: DataFrame, path: str) -> DataFrame:
    """The tries of (root, above, conv_id, m, depth, labels, chars), written to ``path``: all sequences of a root are in
    one row, of some FLUSH turns. Read again."""
    spark = light.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns = 0

        def flushed() -> pa.RecordBatch:
            row = build_trie(held)
            kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([row[c]], k) for c, k in zip(TRIE_NAMES, kinds, strict=True)], TRIE_NAMES)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns >= FLUSH and row[0] != held[-1][0]:
                    yield flushed()
                    held, turns = [], 0
                held.append(row)
                turns += len(row[5])
        if held:
            yield flushed()
        release()

    dealt = light.repartition(buckets(spark, 8), "root").sortWithinPartitions("root", "conv_id")
    dealt.mapInArrow(build, TRIE).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TRIE).parquet(path)


def read_tries(tries: DataFrame) -> DataFrame:
    """The nodes (NODES) of stored tries."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = roll_up({c: batch.column(j)[i].as_py() for j, c in enumerate(TRIE_NAMES)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.string() if c == "above" else pa.int64()) for c, x in columns.items()], NODE_NAMES)

    return tries.mapInArrow(expand, NODES)


def upper_nodes(heavy: DataFrame, light_roots: DataFrame, root: DataFrame) -> DataFrame:
    """The nodes of the upper levels (NODES and ``node``), merged apart from the shards.

    ``heavy``: turns of distinct conversations at heavy nodes, with m; ``light_roots``: the shards' topmost nodes;
    ``root``: one row, the node without turns. A node's own sum, with those of the shards below it, is put on the turn
    of its smallest conversation; sums from each turn to the conversation's last, added over the turns at a node, are
    its subtree's: however deep the upper levels are, it takes the same number of joins.
    """
    below = light_roots.groupBy(F.col("above").alias("node")).agg(F.count("*").alias("light"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    nodes = heavy.groupBy("node", "parent", "depth").agg(F.sum("m").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.min(F.when(F.col("depth") == F.col("len"), F.col("conv_id"))).alias("ends"))
    nodes = stage(nodes.unionByName(root).join(below, "node", "left"), "upper")
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars") + zero("saved")).alias("saved"), zero("leaves").alias("leaves"))
    turns = stage(heavy.select("conv_id", "depth", "node").join(own, ["conv_id", "depth"], "left").withColumns({"saved": zero("saved"), "leaves": zero("leaves")}), "upper_turns")
    summed = running(turns, "conv_id", ["-depth"], ["saved", "leaves"])
    per = summed.groupBy("node").agg(F.sum(F.col("before_saved") + F.col("saved")).alias("all_saved"), F.sum(F.col("before_leaves") + F.col("leaves")).alias("all_leaves"))
    of_node = nodes.select("node", "parent", "depth", "conv_id", "n_convs", "ends", zero("light").alias("light"), zero("saved").alias("light_saved"), zero("leaves").alias("light_leaves")).join(per, "node", "left")
    of_node = stage(of_node, "upper_sums", [turns])
    children = of_node.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("heavy"), F.sum(F.when(F.col("depth") == 1, F.col("all_saved"))).alias("top_saved"), F.sum(F.when(F.col("depth") == 1, F.col("all_leaves"))).alias("top_leaves"))
    names = of_node.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = of_node.join(children, "node", "left").join(names, "parent", "left")
    top, n_children = F.col("depth") == 0, F.col("light") + zero("heavy")
    leaves = F.when(~top, F.col("all_leaves")).otherwise(F.col("light_leaves") + zero("top_leaves"))
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.lit(None).cast("string").alias("above"), "n_convs", n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(leaves).cast("long").alias("n_leaves"),
        F.when(~top, F.col("all_saved")).otherwise(F.col("light_saved") + zero("top_saved")).alias("saved_tokens"), "ends", "node",
    )


def digest_members(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of (rep, conv_id): the decimal conv_ids of each rep in ascending order, comma-joined, hashed.

    A hash of a text has to go through it in order, so one task reads the ids of one rep: as texts that the sort's
    tasks have made, PIECE ids in each, one piece in memory at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]]))
            cuts = sorted({*starts.tolist(), *range(0, len(rep), PIECE)})
            text = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(rep)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rep[cuts]), pa.array([part] * len(cuts), pa.int32()), pa.array(np.arange(number, number + len(cuts))), pa.array(text)], ["rep", "part", "number", "text"])
            number += len(cuts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, hashed = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for r, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if r == rep:
                    hashed.update(b"," + text.encode())
                    continue
                if hashed:
                    done[0].append(rep)
                    done[1].append(hashed.hexdigest())
                rep, hashed = r, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], ["rep", "ends_sha256"])
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([hashed.hexdigest()], pa.string())], ["rep", "ends_sha256"])

    sorted_ = members.select("rep", "conv_id").orderBy("rep", "conv_id").mapInArrow(pieces, "rep long, part int, number long, text string")
    return sorted_.repartition("rep").sortWithinPartitions("rep", "part", "number").mapInArrow(digest, "rep long, ends_sha256 string")


def build(conversations: DataFrame, path: str | None = None, heavy_turns: int = HEAVY) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the
    trie of rebuilt ``conversations`` (conv_id, turn, role, text); the shards' tries are written to ``path``.

    Turns are ordered by number, null first, equal ones by digest of role and text, so repeated rows are turns each.
    Rows without a conv_id belong to no conversation; null roles and texts are empty; other columns are not read; an
    empty table has no node. Equal rebuilt conversations are one sequence from the start, so a group of copies, however
    large, is one path. Nodes with more than ``heavy_turns`` turns below are merged by joins; each other node lies in a
    shard, below a root of at most as many turns.
    """
    spark = conversations.sparkSession
    rebuilt, convs = rebuild(conversations)
    rows = stage(with_nodes(rebuilt), "nodes", [rebuilt])
    last = rows.filter("depth = len").select("conv_id", "len", F.col("node").alias("key")).unionByName(convs.filter("len = 0").select("conv_id", "len", F.lit(ROOT).alias("key")))
    last = stage(last, "last")
    seqs = stage(last.groupBy("key", "len").agg(F.count("*").alias("m"), F.min("conv_id").alias("rep")), "sequences")
    members = stage(join_unique(last, seqs.select("key", "rep", F.col("m").alias("rows")), "key", "rows").select("rep", "conv_id"), "members")
    ends = stage(digest_members(members), "ends", [members, last])
    turns = stage(join_unique(rows, seqs.filter("len > 0").select(F.col("rep").alias("conv_id"), "m", F.col("len").alias("rows")), "conv_id", "rows"), "distinct_turns", [rows])
    weight = turns.groupBy("node").agg(F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    heavy = stage(weight.filter(F.col("weight") > heavy_turns).select("node", F.lit(True).alias("heavy")), "heavy")
    marked = stage(turns.join(broadcast_if_small(heavy), "node", "left"), "marked", [turns])
    # at most heavy_turns turns of a conversation are below its first node that is not heavy
    light = marked.filter("heavy is null").groupBy("conv_id").agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("depth", "node", "parent", "digest", "chars"))).alias("t"))
    light = light.select(F.get("t.node", F.lit(0)).alias("root"), F.get("t.parent", F.lit(0)).alias("above"), "conv_id", "m", F.get("t.depth", F.lit(0)).cast("int").alias("depth"), F.col("t.digest").alias("labels"), F.col("t.chars").alias("chars"))
    shards = stage(read_tries(write_tries(light, path or new_folder(spark, "tries"))), "shard_nodes")
    root = seqs.agg(F.sum("m").alias("n_convs"), F.min("rep").alias("conv_id"), F.min(F.when(F.col("len") == 0, F.col("rep"))).alias("ends")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit("").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("chars"), "ends")
    upper = stage(upper_nodes(marked.filter("heavy"), shards.filter("above is not null"), root), "upper_nodes")
    names = upper.select(F.col("node").alias("above"), F.col("conv_id").alias("_up"))
    columns = [c for c in NODE_NAMES if c != "above"]
    inner = shards.filter("above is null").select(*columns)
    tops = shards.filter("above is not null").drop("parent_conv_id").join(names, "above").withColumnRenamed("_up", "parent_conv_id").select(*columns)
    every = inner.unionByName(tops).unionByName(upper.select(*columns))
    none = hashlib.sha256(b"").hexdigest()
    ended = every.filter("ends is not null").join(ends.withColumnRenamed("rep", "ends"), "ends")
    out = ended.unionByName(every.filter("ends is null").withColumn("ends_sha256", F.lit(none)))
    unstage(marked, seqs)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
