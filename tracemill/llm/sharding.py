"""Placement of rows by a weighted hash tree: region, rack, shard.

At every level each child draws ``-weight / ln(u)`` with u from the hash of (doc_id, path of the child), and the largest draw wins.
Children win in proportion to their weight, and a draw depends on nothing but the id, the child and its weight.  So a changed
weight moves rows only into or out of the subtree that it belongs to, and a subtree that is added takes rows only into itself.

Law ``key``: doc_id and the number of shards decide.  The first ``BASE`` shards form the regions and racks of ``balanced_tree``; every
further shard is a rack of its own in a region of its own, so one more shard takes rows only into itself.

Defined cases: a null text has size 1 and the checksum of the empty text; a null id hashes as the text ``null``.  Rows with
equal ids, repeated ones too, share a shard and get a slot each.  Equal draws (equal to the last bit) go to the first path.  An
empty table gives no rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import numbered

BASE = 8
BLOCK_ROWS = 20000


@dataclass(frozen=True)
class Node:
    """A subtree; ``shard`` is set in leaves only.  The weight of an inner node is the sum of its children."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def balanced_tree(shards: int, weights: dict[int, float] | None = None) -> Node:
    """Two shards a rack and two racks a region for the first BASE shards, a region for each further one."""
    weights = weights or {}
    leaf = lambda s: Node(f"shard{s}", (), weights.get(s, 1.0), s)
    regions = []
    for region in range(-(-min(shards, BASE) // 4)):
        inside = range(4 * region, min(4 * region + 4, shards, BASE))
        racks = [Node(f"rack{r}", tuple(leaf(s) for s in inside if s % 4 // 2 == r)) for r in (0, 1)]
        regions.append(Node(f"region{region}", tuple(r for r in racks if r.children)))
    for shard in range(BASE, shards):
        regions.append(Node(f"region-of-{shard}", (Node("rack0", (leaf(shard),)),)))
    return Node("root", tuple(regions))


def uniform(key: Column, path: str) -> Column:
    """A number above 0 and below 1 from the key and the path of a child."""
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(path), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def choose(key: Column, node: Node, path: str = "") -> Column:
    """The shard of a key below ``node``: the draws of its children, then the winner's own subtree."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"{path or 'the tree'} has no child with a weight above 0")
    inside = [choose(key, c, f"{path}/{c.name}") for c in live]
    if len(live) == 1:
        return inside[0]
    draws = [F.lit(-float(c.weight)) / F.log(uniform(key, f"{path}/{c.name}")) for c in live]
    most = reduce(F.greatest, draws) if len(draws) == 2 else F.greatest(*draws)
    picked = F.when(draws[0] == most, inside[0])
    for draw, shard in zip(draws[1:-1], inside[1:-1], strict=True):
        picked = picked.when(draw == most, shard)
    return picked.otherwise(inside[-1])


def place(documents: DataFrame, shards: int = BASE, tree: Node | None = None, grown: Node | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; slots count from 0 in each shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        choose(key, tree or balanced_tree(shards)).cast("int").alias("shard"),
        choose(key, grown or balanced_tree(shards + 1)).cast("int").alias("grown_shard"),
    )
    blocks = max(1, -(-documents.count() // block_rows))
    return numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", blocks).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
