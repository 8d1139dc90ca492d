"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard.  At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's path,
and the least draw wins.  A child's draw depends on nothing but its own weight,
so a change of weights moves rows only into or out of the subtrees whose
weights change.

The law is ``key``: the id and the tree alone decide the shard.  A new shard is
added as a region of its own, so every row that moves, moves into it.

Defined results: a null text has size 1 and the checksum of an empty text; a
null key is hashed as a key of its own; equal rows get neighbouring slots of
the same shard; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells that slots are numbered in, side by side; each has its own window task.
CELLS = 4096


@dataclass(frozen=True)
class Node:
    """A subtree: a leaf has a shard number, another node has children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return self.own_weight if self.shard is not None else sum(c.weight for c in self.children)


def leaf(name: str, shard: int, weight: float = 1.0) -> Node:
    return Node(name, shard=shard, own_weight=weight)


def tree(regions: int = 2, racks: int = 2, shards: int = 2) -> Node:
    """A regular tree with shards numbered from 0 in path order."""
    number = iter(range(regions * racks * shards))
    return Node("root", tuple(Node(f"region{r}", tuple(Node(f"region{r}/rack{k}", tuple(leaf(f"region{r}/rack{k}/shard{s}", next(number)) for s in range(shards))) for k in range(racks))) for r in range(regions)))


def with_region(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    name = f"region{len(root.children)}"
    return Node(root.name, (*root.children, Node(name, (Node(f"{name}/rack0", (leaf(f"{name}/rack0/shard0", shard, weight),)),))))


def draw(key: Column, child: Node) -> Column:
    """The child's draw for a key: exponential with the child's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(child.weight))


def choose(key: Column, node: Node) -> Column:
    """The shard number that a key reaches from this node."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"{node.name} has no child with a weight")
    if len(live) == 1:
        return choose(key, live[0])
    draws = [draw(key, c) for c in live]
    least = F.least(*draws)
    out = choose(key, live[-1])
    for d, child in reversed(list(zip(draws, live))[:-1]):
        out = F.when(d == least, choose(key, child)).otherwise(out)
    return out


def assign(docs: DataFrame, root: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of every row, now and with one more shard, and its slot there.

    Columns: ``doc_id``, ``size`` long, ``text_crc32`` long, ``law`` string,
    ``shard`` int, ``slot`` long (0, 1, ... in each shard), ``grown_shard`` int.

    Slots are numbered in ``CELLS`` hash cells of each shard at once; the only
    table that meets in one task has a row for each shard and cell.
    """
    root = root or tree()
    leaves = [n for r in root.children for k in r.children for n in k.children]
    grown = with_region(root, 1 + max(n.shard for n in leaves))
    key = F.col("doc_id")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
        .withColumn("shard", choose(key, root).cast("int"))
        .withColumn("grown_shard", choose(key, grown).cast("int"))
        .withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(CELLS)).cast("int"))
    )
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    # At most 8 bytes * shards * CELLS: the bound of the table does not depend on the rows.
    placed = rows.withColumn("place", F.row_number().over(here)).join(F.broadcast(starts), ["shard", "cell"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
