"""Shards by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard. At a node,
every child draws an exponential number from a hash of the row's key and the
child's name, divided by the child's weight; the smallest draw wins, so each
child wins in proportion to its weight. A draw knows nothing of other
children: if a child's weight grows, rows move only into its subtree, if it
shrinks, only out of it.

Columns only: a narrow, row-wise expression without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import numbered, uniform
from quire.session import durable

#: Shards that are laid out as a full tree: 3 regions of 2 racks of 4.
BASE = 24
RACKS, PER_RACK = 2, 4
#: Buckets that one shard's slots are numbered in.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A leaf has a shard number and a weight."""

    name: str
    children: tuple["Node", ...] = field(default=())
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def topology(shards: int, base: int = BASE) -> Node:
    """The tree of so many equal shards.

    The first ``base`` shards form full regions. Each later one opens a region
    of its own: no other subtree's weight changes, so it takes rows only into
    itself.
    """
    per_region = RACKS * PER_RACK
    if base % per_region or shards < base:
        raise ValueError(f"{shards} shards on a base of {base}: the base is full regions of {per_region}")
    regions = []
    for r in range(base // per_region):
        racks = []
        for k in range(RACKS):
            first = r * per_region + k * PER_RACK
            leaves = tuple(Node(f"shard{i}", shard=i) for i in range(first, first + PER_RACK))
            racks.append(Node(f"rack{r}.{k}", leaves))
        regions.append(Node(f"region{r}", tuple(racks)))
    for i in range(base, shards):
        rack = Node(f"rack{i}.late", (Node(f"shard{i}", shard=i),))
        regions.append(Node(f"region{i}.late", (rack,)))
    return Node("root", tuple(regions))


def descend(key: Column, tree: Node) -> Column:
    """The shard number of a row with this key (int). A null key is a key as well."""
    inner: dict[str, tuple[Node, ...]] = {}
    shard_of: dict[str, int] = {}
    depth, level = 0, [tree]
    while any(n.children for n in level):
        depth += 1
        for n in level:
            if n.children:
                inner[n.name] = n.children
        level = [c for n in level for c in n.children]
    stack = [tree]
    while stack:
        n = stack.pop()
        stack += n.children
        if not n.children:
            shard_of[n.name] = n.shard
    kids = F.create_map(*[
        part
        for name, children in inner.items()
        for part in (F.lit(name), F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight")) for c in children]))
    ])
    here = F.lit(tree.name)
    for _ in range(depth):
        drawn = F.transform(
            F.element_at(kids, here),
            lambda c: F.struct((-F.log(uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")),
        )
        below = F.array_min(drawn)["name"]
        here = F.coalesce(below, here)
    numbers = F.create_map(*[part for name, i in shard_of.items() for part in (F.lit(name), F.lit(i))])
    return F.element_at(numbers, here)


def with_shard(docs: DataFrame, tree: Node, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """All rows and columns, with the shard; an existing column of that name is replaced."""
    return docs.withColumn(name, descend(F.col(key), tree))


def shard_report(docs: DataFrame, shards: int = BASE, base: int = BASE) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard with one more.

    Law ``key``: the id and the number of shards decide. A null text has 8
    bytes and the checksum of an empty one; rows without an id meet in one
    shard; repeated rows each have their own slot; an empty table gives none;
    further columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select(
        "doc_id",
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(F.col("doc_id"), topology(shards, base)).alias("shard"),
        descend(F.col("doc_id"), topology(shards + 1, base)).alias("grown_shard"),
    )
    placed = numbered(durable(facts), "shard", ["doc_id", "text_crc32", "size"], SLOT_BUCKETS, "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
