"""A Merkle manifest of a table: one tree a group, one over the groups, and every row's authentication path."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_unique, stage, unstage
from .running import running

#: A block holds 2 ** HEIGHT consecutive nodes of one level: one task's unit at a time.
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = bytes | None  # a digest as hex text; None where the level has no such node


def leaf_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """The row's digest, 32 bytes: each field as ``-`` if null, else its UTF-8 length, a colon and the value, hashed
    together. ``changed`` gives other values for fields."""

    def one(name: str) -> Column:
        value = changed.get(name, F.col(f"`{name}`")).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.unhex(F.sha2(F.concat(*map(one, fields)), 256))


def combine(left: Node, right: Node) -> Node:
    """The parent of two neighbours; a node without a neighbour is hashed alone."""
    return None if left is None else hashlib.sha256(left if right is None else left + right).hexdigest().encode()


class Treehash:
    """Builds the node of ``height`` over the leaves from ``start`` on, one leaf or hash at a step, on a stack of at
    most height + 1 nodes."""

    def __init__(self, height: int, start: int, leaves: list[bytes], node: Node = None, ready: bool = False) -> None:
        self.height, self.next, self.leaves, self.node = height, start, leaves, node
        self.stack: list[tuple[int, Node]] = []
        self.ready = ready or start >= len(leaves)  # beyond the last leaf there is nothing to build

    def low(self) -> int:
        """The height of its lowest node: what the schedule looks at; unbounded when it needs no more steps."""
        return 1 << 30 if self.ready else self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (h, right), (_, left) = stack.pop(), stack.pop()
            stack.append((h + 1, combine(left, right)))
        else:
            stack.append((0, self.leaves[self.next] if self.next < len(self.leaves) else None))
            self.next += 1
        if stack[0][0] == self.height:
            self.node, self.ready, self.stack = stack[0][1], True, []


def build(leaves: list[bytes], height: int) -> tuple[Node, list[Node], list[Node]]:
    """The root over ``leaves`` in 2 ** height places, and of each level below it the first and the second node."""
    first: list[Node] = [None] * (height + 1)
    second: list[Node] = [None] * height
    stack: list[tuple[int, int, Node]] = []
    for i in range(1 << height):
        node = (0, i, leaves[i] if i < len(leaves) else None)
        while True:
            h, at, value = node
            if at == 0:
                first[h] = value
            elif at == 1 and h < height:
                second[h] = value
            if not stack or stack[-1][0] != h or h == height:
                break
            node = (h + 1, at >> 1, combine(stack.pop()[2], value))
        stack.append(node)
    return stack[0][2], first[:height], second


def traverse(leaves: list[bytes], height: int) -> Iterator[list[Node]]:
    """The siblings of each leaf, lowest first, leaf by leaf.

    Every level keeps its present sibling and a treehash that builds the one after it. After a leaf, levels whose
    sibling changes take the finished node and start the next; then 2 * height - 1 steps go to the treehash with the
    lowest node, the lower level first. So each node is ready when it is due, and some 3 * height digests are held.
    """
    _, left, auth = build(leaves, height)
    stacks = [Treehash(h, 0, leaves, left[h], True) for h in range(height)]
    for leaf in range(len(leaves)):
        yield list(auth)
        for h in range(height):
            if (leaf + 1) % (1 << h):
                break
            auth[h] = stacks[h].node
            stacks[h] = Treehash(h, (leaf + 1 + (1 << h)) ^ (1 << h), leaves)
        for _ in range(2 * height - 1):
            focus = min(stacks, key=Treehash.low)
            if focus.ready:
                break
            focus.step()


def sides_of(index: int, siblings: list[Node]) -> str:
    """By level: the sibling stands left (L), right (R), or there is none (-)."""
    return "".join("-" if s is None else "L" if index >> h & 1 else "R" for h, s in enumerate(siblings))


def fold_up(leaf: bytes, sides: str, siblings: bytes) -> bytes:
    """The root, as hex text, that a leaf gives with its path; ``siblings`` are 32 bytes each."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = hashlib.sha256(leaf).hexdigest().encode()
            continue
        s = siblings[at : at + 32].hex().encode()
        at += 32
        leaf = hashlib.sha256(s + leaf if side == "L" else leaf + s).hexdigest().encode()
    return leaf


def _height(count: int, most: int) -> int:
    return min(most, max(count - 1, 0).bit_length())


def _blocks(nodes: DataFrame, height: int, item: list[str]) -> DataFrame:
    """Nodes (grp, idx, cnt, and ``item`` with the digest first) to blocks of at most 2 ** height, with their root."""
    kind = ", ".join(f"`{c}`: {dict(nodes.dtypes)[c]}" for c in ["idx", *item])
    grouped = nodes.groupBy("grp", F.shiftright("idx", height).alias("block")).agg(F.max("cnt").alias("cnt"), F.array_sort(F.collect_list(F.struct("idx", *item))).alias("items"))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pc.struct_field(batch.column(3).flatten(), [1]).to_pylist()
            out, at = [], 0
            for cnt, n in zip(batch.column(2).to_pylist(), pc.list_value_length(batch.column(3)).to_pylist(), strict=True):
                leaves = [d.hex().encode() for d in digests[at : at + n]]
                at += n
                out.append(bytes.fromhex(build(leaves, _height(cnt, height))[0].decode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["grp", "block", "cnt", "items", "top"])

    return stage(grouped.mapInArrow(roots, f"grp string, block long, cnt long, items array<struct<{kind}>>, top binary"), "blocks")


def climb(nodes: DataFrame, most: int, height: int, item: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every level, lowest first, and each group's root (grp, digest); ``most``: nodes of the largest
    group. A level has 2 ** height times fewer nodes than the one below."""
    levels = []
    while True:
        levels.append(_blocks(nodes, height, item))
        most, item = -(-most // (1 << height)), ["digest"]
        nodes = levels[-1].select("grp", F.col("block").alias("idx"), F.ceil(F.col("cnt") / (1 << height)).cast("long").alias("cnt"), F.col("top").alias("digest"))
        if most <= 1:
            return levels, nodes.select("grp", "digest")


def descend(levels: list[DataFrame], upper: DataFrame, height: int, item: list[str], types: dict[str, str]) -> DataFrame:
    """Walk each block's leaves in order and put their block's own path (``upper``: grp, idx, sides, siblings,
    subroot, root) behind theirs: the paths of the lowest level's nodes, with their ``item`` columns."""
    for k in range(len(levels) - 1, -1, -1):
        keep = item if k == 0 else ["digest"]
        met = levels[k].drop("top").join(upper.withColumnRenamed("idx", "block"), ["grp", "block"])
        names = ["grp", "idx", *keep, "sides", "siblings", "subroot", "root"]
        kinds = {"grp": "string", "idx": "long", "sides": "string", "siblings": "binary", "subroot": "binary", "root": "binary"} | types

        def paths(batches: Iterator[pa.RecordBatch], names=names, keep=keep) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c != "items"}
                blocks = batch.column(batch.schema.get_field_index("items"))
                item_type = blocks.type.value_type
                arrow = {"grp": pa.string(), "sides": pa.string(), "siblings": pa.binary(), "subroot": pa.binary(), "root": pa.binary()} | {f.name: f.type for f in item_type}
                for b in range(batch.num_rows):  # one block at a time: at most 2 ** height rows
                    items = blocks[b].as_py()
                    leaves = [x["digest"].hex().encode() for x in items]
                    sides, siblings = [], []
                    for x, auth in zip(items, traverse(leaves, _height(columns["cnt"][b], height)), strict=True):
                        sides.append(sides_of(x["idx"], auth) + columns["sides"][b])
                        siblings.append(b"".join(bytes.fromhex(s.decode()) for s in auth if s is not None) + columns["siblings"][b])
                    n = len(items)
                    made = {"sides": sides, "siblings": siblings} | {c: [columns[c][b]] * n for c in ("grp", "subroot", "root")} | {c: [x[c] for x in items] for c in ["idx", *keep]}
                    yield pa.RecordBatch.from_arrays([pa.array(made[c], arrow[c]) for c in names], names)

        upper = met.mapInArrow(paths, ", ".join(f"`{c}` {kinds[c]}" for c in names))
        if k:
            upper = stage(upper.drop("digest"), "paths")
    return upper


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", claim: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(order, group, digest, claim, sides, siblings, subroot, root) of every row of ``docs``.

    Leaves of one group ascend by ``order`` (null first; equal ones by digest, so repeated rows are leaves each); the
    groups' roots, null first, then bytewise, are the leaves of the last tree. ``claim``: a digest that somebody gives
    for the row, kept beside its own for `verify`; null or none: its own. An empty table gives no rows. Null fields
    count as ``-``; columns that are not named are not read, whatever their names.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = stage(docs.select(key.alias("grp"), F.col(f"`{order}`").alias("ord"), leaf_digest(fields).alias("digest"), (F.lit(None).cast("binary") if claim is None else claim).alias("claim"), F.lit(1).cast("long").alias("one")), "leaves")
    counts = stage(leaves.groupBy("grp").agg(F.count("*").alias("cnt")).withColumn("rows", F.col("cnt")), "counts")
    most = counts.agg(F.max("cnt"), F.count("*")).first()
    item = ["digest", "ord", "claim"]
    types = {c: t for c, t in leaves.dtypes if c in item}
    name = F.when(F.col("grp") != "", F.expr("substr(grp, 2)")).alias(group)
    if not most[1]:
        return spark.createDataFrame([], f"`{order}` {types['ord']}, `{group}` string, digest binary, claim binary, sides string, siblings binary, subroot binary, root binary")
    placed = running(leaves, "grp", ["ord", "digest"], ["one"])
    nodes = join_unique(placed.select("grp", F.col("before_one").alias("idx"), *item), counts, "grp", "rows")
    levels, subroots = climb(nodes, most[0], height, item)
    unstage(placed, leaves)
    tops = stage(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.lit(1).cast("long").alias("one")), "subroots")
    ranked = running(tops, "grp", ["name"], ["one"]).select("grp", F.col("before_one").alias("idx"), F.lit(most[1]).cast("long").alias("cnt"), "digest", "name")
    top_levels, root = climb(ranked, most[1], height, ["digest", "name"])
    start = root.select("grp", F.lit(0).cast("long").alias("idx"), F.lit("").alias("sides"), F.unhex(F.lit("")).alias("siblings"), F.unhex(F.lit("")).alias("subroot"), F.col("digest").alias("root"))
    upper = descend(top_levels, start, height, ["digest", "name"], {"digest": "binary", "name": "string"})
    upper = stage(upper.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "sides", "siblings", F.col("digest").alias("subroot"), "root"), "upper")
    out = descend(levels, upper, height, item, types)
    return out.select(F.col("ord").alias(order), name, "digest", F.coalesce("claim", "digest").alias("claim"), "sides", "siblings", "subroot", "root")


def verify(proofs: DataFrame) -> DataFrame:
    """`prove`'s rows with ``proof_sha256`` (the siblings as hex text, hashed) and ``folded_root``, which the claimed
    digest gives with the row's path."""
    names = [*proofs.columns, "proof_sha256", "folded_root"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claim, sides, siblings = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("claim", "sides", "siblings"))
            proof = [hashlib.sha256(s.hex().encode()).hexdigest() for s in siblings]
            folded = [fold_up(c.hex().encode(), x, s).decode() for c, x, s in zip(claim, sides, siblings, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proof, pa.string()), pa.array(folded, pa.string())], names)

    return proofs.mapInArrow(fold, ", ".join([*(f"`{c}` {t}" for c, t in proofs.dtypes), "proof_sha256 string, folded_root string"]))
