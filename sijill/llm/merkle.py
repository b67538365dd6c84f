"""Merkle manifest of a table: a tree of digests a language, authentication paths by Merkle traversal, one root over all.

A row's leaf is the digest of its columns, made by SQL functions; only the digests travel on. Rows are put in order by range
partitions, their place is their number within the partition plus the sizes of those before, and ``BLOCK`` neighbours (an aligned
subtree) become one row. A block's tree is walked leaf by leaf: one treehash stack a level makes the nodes that the path needs
next, always the one whose tail is lowest, so it holds a logarithmic number of nodes. The roots of the blocks are the leaves of the
next tier, walked the same way, until a language has one node; the subroots make one more tree. What lies above a block is the
same for all its leaves, is joined to the block once and appended to each path.

Edge cases: a null in a column is ``-``, an empty text has length 0; a null language is a language of its own, before all
others; null ids come before all others; rows of one id stand in order of their leaf, rows alike in all columns have each their
own place; a null ``n_chars`` can't be tampered with and verifies; a table without rows gives no rows; other columns don't count.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sijill.llm.common import prepare, stored

#: log2 of the leaves of a block.
BITS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


# ------------------------------------------------------------------ digests of rows


def _field(value: Column) -> Column:
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(values: dict[str, Column] | None = None) -> Column:
    """Hex digest of a row's columns; ``values`` stand in for some of them."""
    return F.sha2(F.concat(*[_field((values or {}).get(c, F.col(c))) for c in COLUMNS]), 256)


# ------------------------------------------------------------------ one block


def parent(left: bytes | None, right: bytes | None) -> bytes | None:
    """The digest over one or two nodes (hex); a missing node has no parent."""
    if left is None:
        return None
    return hashlib.sha256(left + right if right else left).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return max(0, n - 1).bit_length()


class Treehash:
    """Makes the node of ``level`` over the leaves from ``start`` on, a leaf or a parent a step; its stack is as high as the level."""

    def __init__(self, level: int):
        self.level, self.at, self.stack, self.node = level, 0, [], None

    def begin(self, start: int) -> int:
        self.at, self.stack, self.node = start, [], None
        return self.level

    def step(self, leaves: list[bytes]) -> float:
        """Level of the lowest tail after the step; infinite when the node is made."""
        s = self.stack
        if len(s) > 1 and s[-1][0] == s[-2][0]:
            level, right = s.pop()
            s[-1] = (level + 1, parent(s[-1][1], right))
        else:
            s.append((0, leaves[self.at] if self.at < len(leaves) else None))
            self.at += 1
        if s[-1][0] == self.level:
            self.node = s.pop()[1]
            return _DONE
        return s[-1][0]


_DONE = float("inf")


def root(leaves: list[bytes], levels: int) -> bytes:
    """The node ``levels`` above all leaves, with a stack of one node a level."""
    whole = Treehash(levels)
    while whole.step(leaves) < _DONE:
        pass
    return whole.node


def traverse(leaves: list[bytes], levels: int) -> Iterator[list[bytes | None]]:
    """For each leaf in turn its sibling on each of ``levels`` levels; None where it has none.

    The path of the first leaf comes from one treehash over all leaves. After leaf s, the levels whose node changes take what their
    stack has made, and begin on the node they need 2 ** (level + 1) leaves later; 2 * levels - 1 steps go to the lowest tails
    (a stack that has just begun counts as its level).
    """
    first: list[list] = [[] for _ in range(levels)]  # of each level the first two nodes
    whole = Treehash(levels)
    while whole.step(leaves) < _DONE:
        level, node = whole.stack[-1]
        if len(first[level]) < 2:
            first[level].append(node)
    path, stacks, low = [two[1] for two in first], [Treehash(h) for h in range(levels)], [_DONE] * levels
    for stack, two in zip(stacks, first, strict=True):
        stack.node = two[0]
    for s in range(len(leaves)):
        yield path
        for h in range(levels):
            if (s + 1) % (1 << h):
                break
            path[h] = stacks[h].node
            low[h] = stacks[h].begin((s + 1 + (1 << h)) ^ (1 << h))
        for _ in range(2 * levels - 1):
            lowest = min(low)
            if lowest == _DONE:
                break
            h = low.index(lowest)
            low[h] = stacks[h].step(leaves)


# ------------------------------------------------------------------ tiers of blocks


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos, their place in the order of ``order`` within their ``tree``, and n, how many the tree has."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    put = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    put = stored(put.withColumn("_at", F.monotonically_increasing_id()), f"merkle-{name}-placed")
    part = F.shiftrightunsigned("_at", 33)
    sizes = put.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")  # as many rows as partitions it lies in
    before = F.sum("_size").over(tree.orderBy("_part")) - F.col("_size")
    starts = sizes.select("tree", "_part", F.sum("_size").over(tree).alias("n"), (before - F.col("_first")).alias("_shift"))
    out = put.withColumn("_part", part).join(starts, ["tree", "_part"])
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def blocked(rows: DataFrame, bits: int, *more: str) -> DataFrame:
    """A row a block: tree, block, n (leaves of the tree) and its rows (pos, node and ``more``) in order; never over 2 ** bits."""
    return rows.groupBy("tree", F.shiftright("pos", bits).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node", *more))).alias("rows"))


def _levels(n: int, bits: int) -> int:
    return min(bits, height(n))


def _raised(batches, bits: int):
    for b in batches:
        made = []
        for n, rows in zip(b.column("n").to_pylist(), b.column("rows"), strict=True):
            nodes = [x.hex().encode() for x in pa.array(rows.values.field("node")).to_pylist()]
            made.append(bytes.fromhex(root(nodes, _levels(n, bits)).decode()))
        n = [-(-x // (1 << bits)) for x in b.column("n").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("block"), pa.array(n, pa.int64()), pa.array(made, pa.binary())], ["tree", "pos", "n", "node"])


def _walked(batches, bits: int):
    """Of an upper tier's blocks: a row a node with its siblings up to the tree's root, nearest first; levels without one are left out."""
    for b in batches:
        trees, places, paths, roots = [], [], [], []
        for tree, n, rows, above, top in zip(b.column("tree").to_pylist(), b.column("n").to_pylist(), b.column("rows").to_pylist(), b.column("above").to_pylist(), b.column("root").to_pylist(), strict=True):
            nodes = [r["node"].hex().encode() for r in rows]
            for r, path in zip(rows, traverse(nodes, _levels(n, bits)), strict=True):
                trees.append(tree)
                places.append(r["pos"])
                paths.append(sides(path, r["pos"]) + above)
                roots.append(top)
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(places, pa.int64()), pa.array(paths, pa.list_(pa.string())), pa.array(roots, pa.string())], ["tree", "pos", "above", "root"])


def sides(path: list[bytes | None], pos: int) -> list[str]:
    """A path's entries: L or R, where the sibling stands, and its digest; ``-`` for a level without one."""
    return [("L" if pos >> h & 1 else "R") + s.decode() if s else "-" for h, s in enumerate(path)]


def raised(rows: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, n, node) of the blocks' roots, as the next tier's leaves."""
    return rows.mapInArrow(functools.partial(_raised, bits=bits), "tree string, pos long, n long, node binary")


def ways(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, above, root) for ``nodes`` (tree, pos, n, node): the way from each to its tree's root, tier by tier."""
    tiers = []
    while nodes.where("n > 1").limit(1).count():
        tiers.append(stored(blocked(nodes, bits), "merkle-tier"))
        nodes = stored(raised(tiers[-1], bits), "merkle-nodes")
    found = nodes.select("tree", "pos", F.array().cast("array<string>").alias("above"), F.lower(F.hex("node")).alias("root"))
    for rows in reversed(tiers):
        found = rows.join(found.withColumnRenamed("pos", "block"), ["tree", "block"]).mapInArrow(functools.partial(_walked, bits=bits), "tree string, pos long, above array<string>, root string")
    return found


# ------------------------------------------------------------------ manifest


def folded(node: str, way: list[str]) -> str:
    """The root that a leaf's digest leads to."""
    for s in way:
        node = hashlib.sha256((s[1:] + node if s[0] == "L" else node + s[1:] if s[0] == "R" else node).encode()).hexdigest()
    return node


_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(batches, bits: int):
    for b in batches:
        out: list[tuple] = []
        for n, rows, above, sub, top in zip(*(b.column(c).to_pylist() for c in ("n", "rows", "above", "subroot", "root")), strict=True):
            upper = "".join(s[1:] for s in above)
            nodes = [r["node"].hex().encode() for r in rows]
            for r, node, path in zip(rows, nodes, traverse(nodes, _levels(n, bits)), strict=True):
                way = sides(path, r["pos"])
                proof = hashlib.sha256(("".join(s[1:] for s in way) + upper).encode()).hexdigest()
                again = folded((r["changed"].hex() if r["changed"] else node.decode()), way + above)
                out.append((r["doc_id"], node.decode(), sub, top, proof, again, again == top))
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """A row for each of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, its language's root, the root, and its proof checked.

    proof_sha256 is the digest of the path's siblings. Where ``tampered`` holds, 1 is added to n_chars before the path is folded.
    ``bits``: log2 of the leaves of a block.
    """
    prepare(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # keeps the order of bytes, null first
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    changed = F.when(tampered, F.unhex(leaf({"n_chars": more}))) if tampered is not None else F.lit(None).cast("binary")
    own = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf()).alias("node"), changed.alias("changed"))
    own = stored(own, "merkle-leaves")
    blocks = stored(blocked(placed(own, ["doc_id", "node"], "leaves"), bits, "doc_id", "changed"), "merkle-blocks")
    above = stored(ways(stored(raised(blocks, bits), "merkle-roots"), bits), "merkle-ways")
    subroots = above.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.unhex("root").alias("node"))
    subroots = stored(placed(subroots, ["name"], "subroots"), "merkle-subroots")
    tops = subroots.select("tree", "pos", "name").join(ways(subroots.select("tree", "pos", "n", "node"), bits), ["tree", "pos"])
    tops = tops.select(F.col("name").alias("tree"), F.col("above").alias("last"), F.col("root").alias("top"))
    upper = above.join(tops, "tree").select("tree", F.col("pos").alias("block"), F.concat("above", "last").alias("above"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    return blocks.join(upper, ["tree", "block"]).mapInArrow(functools.partial(_proved, bits=bits), _SCHEMA)
