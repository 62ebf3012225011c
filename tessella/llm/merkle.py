"""Merkle manifests: a leaf for each row, a tree for each group, a tree over the groups, a proof for each row.

Rows of a group are numbered in the order of their key by one range sort. Aligned
blocks of 2^12 rows are traversed fractally: two stacks of subtrees stand over a block,
the existing ones, from which proofs are read, and the desired ones, which grow by two
units for each leaf and are whole when the existing ones are used up. A block's root is
a node of the next tier, whose proofs are made alike, so no task ever holds more than a
block, however many rows a group has. Proofs of the tiers above are joined to a block's
rows before its traversal, which appends them.

A proof is a list with one entry for each level of the tree, from the leaf up: "L" or "R"
and the digest of the sibling on that side, or "-" where a node stands alone and its
parent is the hash of it only. fold() gives the root that a leaf and a proof lead to.

Defined cases: null keys come first, null groups are a group of their own and come first;
rows with equal keys follow their digests, and equal rows are leaves each on its own; an
empty table has no rows and no root; null values, texts of any length and values that hold
the separators have encodings of their own (lengths precede values).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: log2 of the rows of a block, and the height of a subtree in its stacks.
BLOCK_BITS = 12
SUBTREE = 4


def digest_of(*columns: Column) -> Column:
    """sha256 of values written as '-' or as byte count, ':' and value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` lead to."""

    def up(node, entry):
        sibling = F.substring(entry, 2, 64)
        return F.sha2(F.when(entry.startswith("L"), F.concat(sibling, node)).when(entry.startswith("R"), F.concat(node, sibling)).otherwise(node), 256)

    return F.aggregate(proof, leaf, up)


def siblings(proof: Column) -> Column:
    """The digests of a proof's siblings in a row, from the leaf up."""
    return F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), "")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(n: int) -> int:
    """Levels between n nodes and their root."""
    return (n - 1).bit_length()


def block_root(leaves: list[str], height: int) -> str:
    for _ in range(height):
        leaves = [_hash(a + b) for a, b in zip(leaves[::2], [*leaves[1::2], *[""] * (len(leaves) % 2)], strict=True)]
    return leaves[0]


class Subtree:
    """The nodes of the levels from ``low`` to below ``high`` over the leaves of the ``number``-th subtree, made unit by unit."""

    def __init__(self, leaves: list[str], low: int, high: int, number: int) -> None:
        self.leaves, self.low, self.top = leaves, low, high - 1
        self.at, self.end = number << high, min(len(leaves), (number + 1) << high)
        self.first = number << high
        self.open: list[tuple[int, str]] = []
        self.rows: list[list[str]] = [[] for _ in range(high - low)]

    def _put(self, level: int, node: str) -> None:
        if level >= self.low:
            self.rows[level - self.low].append(node)
        if level < self.top:
            self.open.append((level, node))

    def grow(self) -> bool:
        """One hash or one leaf; False when all nodes are there."""
        if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            (level, right), (_, left) = self.open.pop(), self.open.pop()
            self._put(level + 1, _hash(left + right))
        elif self.at < self.end:
            self.at += 1
            self._put(0, self.leaves[self.at - 1])
        elif self.open:
            level, node = self.open.pop()
            self._put(level + 1, _hash(node))
        else:
            return False
        return True

    def whole(self) -> Subtree:
        while self.grow():
            pass
        return self

    def sibling(self, leaf: int, level: int) -> str:
        """The entry of a proof: side and digest, '-' for none."""
        k = ((leaf >> level) ^ 1) - (self.first >> level)
        row = self.rows[level - self.low]
        return ("R" if k & 1 else "L") + row[k] if k < len(row) else "-"


def traversal(leaves: list[str], height: int, step: int = SUBTREE) -> Iterator[list[str]]:
    """The proofs of one leaf after the other, with two subtrees held for every ``step`` levels."""
    spans = [(low, min(height, low + step)) for low in range(0, height, step)]
    existing = [Subtree(leaves, low, high, 0).whole() for low, high in spans]
    desired = [Subtree(leaves, low, high, 1) for low, high in spans]
    for leaf in range(len(leaves)):
        yield [tree.sibling(leaf, level) for tree, (low, high) in zip(existing, spans, strict=True) for level in range(low, high)]
        for i, (low, high) in enumerate(spans):
            if (leaf + 1) % (1 << high) == 0:
                existing[i] = desired[i].whole()
                desired[i] = Subtree(leaves, low, high, ((leaf + 1) >> high) + 1)
            else:
                desired[i].grow() and desired[i].grow()


def numbered(rows: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """``rows`` with ``at`` (place in the group from 0) and ``of`` (rows of the group): one range sort, then sums of counts.

    No task gets a whole group: the sort cuts groups by their order, and the sums run over
    one row for each task and group.
    """
    by = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    keyed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "numbered")
    keyed = keyed.withColumn("task", F.shiftright("at", 33))
    g = F.col(group) if group else F.lit(None).cast("string")
    counts = keyed.groupBy("task", g.alias("g")).agg(F.count("*").alias("k"), F.min("at").alias("start"))
    from pyspark.sql import Window

    w = Window.partitionBy("g")
    before = F.sum("k").over(w.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("task").alias("task_"), "g", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"), F.sum("k").over(w).alias("of"))
    on = (F.col("task") == F.col("task_")) & (g.eqNullSafe(F.col("g")))
    return keyed.join(counts, on).select(*rows.columns, (F.col("at") + F.col("shift")).alias("at"), "of")


def _levels(of: int, bits: int) -> int:
    return bits if of > 1 << bits else _height(of)


def _ordered(block: pa.Table) -> pa.Table:
    return block.sort_by("at")


def _tier_above(nodes: DataFrame, group: str | None, bits: int) -> DataFrame:
    """(group, at, of, digest) of the blocks of ``nodes``."""
    keys = [group] if group else []
    schema = "".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}, " for c in keys) + "at long, of long, digest string"

    def root(block: pa.Table) -> pa.Table:
        block = _ordered(block)
        of, at = block["of"][0].as_py(), block["at"][0].as_py()
        found = {"at": [at >> bits], "of": [((of - 1) >> bits) + 1], "digest": [block_root(block["digest"].to_pylist(), _levels(of, bits))]}
        return pa.table({**{c: block[c].slice(0, 1) for c in keys}, **{k: pa.array(v, pa.string() if k == "digest" else pa.int64()) for k, v in found.items()}})

    rows = nodes.select(*keys, "at", "of", "digest").withColumn("block", F.shiftright("at", bits))
    return rows.groupBy(*keys, "block").applyInArrow(root, schema)


def _tiers(nodes: DataFrame, group: str | None, bits: int) -> list[DataFrame]:
    """``nodes`` and the tiers above, up to one node for each group; each has 2^bits times fewer rows."""
    tiers = [nodes]
    while tiers[-1].where("of > 1").limit(1).count():
        tiers.append(stored(_tier_above(tiers[-1], group, bits), "tier"))
    return tiers


def _proved(nodes: DataFrame, above: DataFrame, group: str | None, bits: int, step: int) -> DataFrame:
    """``nodes`` with their proofs; ``above`` has those of their blocks and, as further columns, what is the same for all rows of a block."""
    keys = [group] if group else []
    given = [c for c in above.columns if c not in (*keys, "at", "of", "digest", "proof")]
    up = above.select(*[F.col(c).alias(f"{c}_up") for c in keys], F.col("at").alias("block_up"), F.col("proof").alias("rest"), *given)
    rows = nodes.withColumn("block", F.shiftright("at", bits))
    on = F.col("block") == F.col("block_up")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_up"))
    rows = rows.join(up, on).select(*nodes.columns, "block", "rest", *given)
    out = rows.drop("block", "rest").withColumn("proof", F.lit(None).cast("array<string>")).schema

    def prove(block: pa.Table) -> pa.Table:
        block = _ordered(block)
        rest = block["rest"][0].as_py()
        leaves = block["digest"].to_pylist()
        proofs = pa.array(([*p, *rest] for p in traversal(leaves, _levels(block["of"][0].as_py(), bits), step)), pa.list_(pa.string()), size=len(leaves))
        return block.drop_columns(["block", "rest"]).append_column("proof", proofs)

    return rows.groupBy(*keys, "block").applyInArrow(prove, out)


def manifest(rows: DataFrame, key: str, group: str, digest: str, carry: tuple[str, ...] = (), bits: int = BLOCK_BITS, step: int = SUBTREE) -> DataFrame:
    """(key, group, carry..., leaf, at, subroot, root, proof): what proves that a row belongs to the dataset.

    ``digest`` is the column of the leaves' digests (see digest_of). Trees over the rows of a
    group by ascending ``key`` have the group's subroot; the tree over the subroots by group has
    the root.
    """
    leaves = rows.select(F.col(key).alias("key"), F.col(group).alias("part"), F.col(digest).alias("digest"), *carry)
    leaves = stored(numbered(leaves, ["key", "digest"], "part"), "leaves")
    tiers = _tiers(leaves, "part", bits)
    upper = _tiers(stored(numbered(tiers[-1].select("part", "digest"), ["part"]), "subroots"), None, bits)
    proved = upper[-1].withColumn("proof", F.array().cast("array<string>")).withColumn("root", F.col("digest"))
    for tier in reversed(upper[:-1]):
        proved = stored(_proved(tier, proved, None, bits, step), "proved")
    top = proved.select("part", F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("of"), "digest", "proof", "root", F.col("digest").alias("subroot"))
    for tier in reversed(tiers[1:-1]):
        top = stored(_proved(tier, top, "part", bits, step), "proved")
    if len(tiers) > 1:
        top = _proved(leaves, top, "part", bits, step)
    else:
        top = leaves.join(top.select(F.col("part").alias("part_up"), "proof", "root", "subroot"), F.col("part").eqNullSafe(F.col("part_up")))
    return top.select(F.col("key").alias(key), F.col("part").alias(group), *carry, F.col("digest").alias("leaf"), "at", "subroot", "root", "proof")
