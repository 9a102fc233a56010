"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in regions and shards in racks; a node weighs what the shards below it weigh. A document
descends the three levels. At each it draws, for every child, an exponential variate -ln(u) / weight from the hash
of its doc_id and the child's name, and goes to the child with the least: a child wins with probability in proportion
to its weight. A changed weight changes the draws of that node and its ancestors alone, so documents only move into
or out of subtrees whose weights change. A grown tree has the new shard in a region of its own, so that nothing else
changes weight and documents only move into the new shard.

The law is `key`: doc_id and the tree decide. Slots number a shard's rows in the order of the doc_id's hash; each
shard is numbered in hash ranges of its own, whose sizes are summed first, so no task holds a whole shard.

Null texts have one byte of size and the checksum of an empty text; a null doc_id is hashed as an empty string.
Rows that share a doc_id lie in one shard and one hash range of it, so they are numbered in one task. Texts of any length
only give their size and checksum. Only the two named columns of docs are read, whatever the names of others. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for


@dataclass(frozen=True)
class Tree:
    """regions: racks: {shard: weight}."""

    regions: tuple[tuple[dict[int, float], ...], ...]

    @classmethod
    def of(cls, shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
        ids = list(range(shards))
        racked = [dict.fromkeys(ids[i : i + per_rack], 1.0) for i in range(0, shards, per_rack)]
        return cls(tuple(tuple(racked[i : i + racks]) for i in range(0, len(racked), racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        new = 1 + max(s for region in self.regions for rack in region for s in rack)
        return Tree((*self.regions, ({new: weight},)))

    def place(self, key: Column) -> Column:
        """The shard, an int column."""

        def rack(name: str, shards: dict[int, float]) -> Column:
            return _descend(key, [(f"{name}/{s}", w, F.lit(s)) for s, w in shards.items()])

        def region(name: str, racks) -> Column:
            return _descend(key, [(f"{name}/{i}", sum(r.values()), rack(f"{name}/{i}", r)) for i, r in enumerate(racks)])

        return _descend(key, [(str(i), sum(sum(r.values()) for r in racks), region(str(i), racks)) for i, racks in enumerate(self.regions)])


def _unit(c: Column) -> Column:
    """The first 52 bits of the digest of c, as a number between 0 and 1."""
    return (F.conv(F.substring(F.md5(c), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _descend(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    children = [c for c in children if c[1] > 0]
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*(F.struct((-F.log(_unit(F.concat(key, F.lit(f"@{name}")))) / w).alias("draw"), F.lit(i).alias("child")) for i, (name, w, _) in enumerate(children)))
    won, out = F.array_min(draws)["child"], None
    for i, (_, _, below) in enumerate(children):
        out = F.when(won == i, below) if out is None else out.when(won == i, below)
    return out


def assign_shards(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    chunks = parts_for(docs)
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        tree.place(key).alias("shard"),
        tree.grown().place(key).alias("grown_shard"),
        F.md5(key).alias("_order"),
        F.floor(_unit(key) * chunks).cast("int").alias("_chunk"),
    )
    # As many rows as shards times chunks, whatever the input.
    counts = placed.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    first = F.sum("_n").over(Window.partitionBy("shard").orderBy("_chunk")) - F.col("_n")
    starts = counts.select("shard", "_chunk", first.alias("_first"))
    inside = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_order", "doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("_inside", inside).join(F.broadcast(starts), ["shard", "_chunk"])
    slot = F.col("_first") + F.col("_inside") - 1
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")
