"""Shards by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends from region to rack to shard. At each node every child draws -ln(u) / weight, u a hash of the row's id
and the child's name, and the smallest draw wins: a child wins in proportion to its weight, and a change of weight
moves rows only into or out of the subtree whose weight changed. A new shard in a region of its own therefore takes
rows into itself and moves none between the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equireach.llm.common import partitions_for


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with a number; the weight of a parent is that of its shards."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8) -> Node:
    """The first `base` shards fill regions of `racks` racks of `per_rack` shards; each later one opens a region of its own."""

    def leaf(i: int) -> Node:
        return Node(f"shard{i}", shard=i)

    regions = []
    first = min(shards, base)
    for r, at in enumerate(range(0, first, racks * per_rack)):
        own = [Node(f"rack{k}", tuple(leaf(i) for i in range(k, min(k + per_rack, first)))) for k in range(at, min(at + racks * per_rack, first), per_rack)]
        regions.append(Node(f"region{r}", tuple(own)))
    regions += [Node(f"region-of-{i}", (Node(f"rack-of-{i}", (leaf(i),)),)) for i in range(first, shards)]
    return Node("root", tuple(regions))


def shard_of(key: Column, node: Node) -> Column:
    """The number of the shard that a key descends to."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return shard_of(key, node.children[0])

    def draw(child: Node) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11).cast("double") + 0.5) / float(1 << 53)
        return -F.log(u) / F.lit(float(child.weight))

    best = F.array_min(F.array(*(F.struct(draw(c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children))))["child"]
    out = F.lit(None).cast("int")
    for i, child in reversed(list(enumerate(node.children))):
        out = F.when(best == i, shard_of(key, child)).otherwise(out)
    return out


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", now: Node | None = None, grown: Node | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The law is `key`: the id and the tree alone decide, whatever the other rows are. A null text has size 1 and the
    crc32 of nothing, 0; a null id is a key like any other; rows that repeat lie in one shard at slots of their own.
    slot numbers a shard's rows from 0 without gaps. An empty table gives an empty result; other columns are not read.
    """
    now, grown = now or tree(shards), grown or tree(shards + 1)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), now), "grown_shard": shard_of(F.col("doc_id"), grown)})
    # slots: rows are dealt to buckets by id and numbered there; a bucket's first slot is the count of those before it
    buckets = partitions_for(docs) * 4
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("shard").alias("b_shard"), F.col("bucket").alias("b_bucket"), (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("nth", nth).join(before, (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("nth") + F.col("before")).cast("long").alias("slot"), "grown_shard")
