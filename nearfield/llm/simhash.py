"""SimHash near-deduplication by pigeonhole blocks.

A fingerprint of 64 bits is split into BLOCKS blocks. Two fingerprints that differ in at most DISTANCE bits agree
on at least BLOCKS - DISTANCE blocks, so they share the key made of one choice of that many blocks. Distinct
fingerprints, not documents, are joined on these keys, and pairs are kept after their Hamming distance is verified.

A key with over BUCKET fingerprints is not paired. Its fingerprints go by a second exact way: each names all
fingerprints within half the distance (65 for a distance of 2, itself included). Two that name the same one are
within the distance, and any two within the distance name a common one, so linking all that name a value to the
least of them gives the same components without pairs. This needs an even distance.

Components are found by alternating large-star and small-star rounds on tables in the shared folder.

Texts without a word, null ones too, have fingerprint zero and are linked like any other. Rows that share a doc_id
are separate documents with one number; a null doc_id is larger than all others. A text's words and shingle hashes are
held in one worker, however long it is, and its bits are counted in steps. Only the two named columns of docs are read,
whatever the names of others. An empty table gives an empty result.

A node that links to very many others has all its edges under one key where edges meet the smallest neighbours; Spark's
adaptive execution splits such a key, and all aggregates combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Held, Stash, numbered_rows, sized, stash, tidy, unhot_join

SHINGLE, BLOCKS, DISTANCE, BUCKET = 3, 4, 2, 32


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, _print: a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        def one(text: bytes | None) -> int:
            found = (text or b"").lower().split()  # of bytes: A-Z, and just the white space of the contract
            if not found:
                return 0
            parts = zip(*(found[i:] for i in range(shingle))) if len(found) > shingle else [found]
            h = np.fromiter((xxh64_intdigest(b" ".join(p), 42) for p in parts), np.uint64)
            # In steps, as a text may be of any length.
            ones = sum(np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
            return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])

        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(one, texts), pa.int64())], ["doc_id", "_print"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("_print", T.LongType())]))


def block_keys(c: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """An array of longs: the choice of blocks in the top bits is hashed with the blocks' bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    return F.array(*(F.struct(F.lit(n).alias("choice"), F.array(*(part[i] for i in chosen)).alias("bits")) for n, chosen in enumerate(combinations(range(blocks), blocks - distance))))


def links(prints: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """u, v with u > v: links between the distinct _print values that have the components of all links."""
    if distance % 2 or not 0 < distance < blocks:
        raise ValueError("distance must be even and less than blocks")
    keyed = prints.select("_print", F.explode(block_keys(F.col("_print"), blocks, distance)).alias("_key"))
    sizes = Held(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")).df
    total = prints.count()
    shared = Held(unhot_join(keyed, sizes, "_key", "_n", total)).df
    small = shared.where(F.col("_n") <= bucket)
    a, b = small.select("_key", F.col("_print").alias("u")), small.select("_key", F.col("_print").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    pairs = a.join(b, "_key").where((F.col("u") > F.col("v")) & near).select("u", "v")
    crowded = shared.where(F.col("_n") > bucket).select("_print").distinct()
    masks = [sum(1 << i for i in bits) for n in range(distance // 2 + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    named = crowded.select("_print", F.explode(F.array(*map(F.lit, signed))).alias("_mask")).select("_print", F.col("_print").bitwiseXOR(F.col("_mask")).alias("_named"))
    # At most len(masks) fingerprints can name a value.
    stars = named.groupBy("_named").agg(F.collect_list("_print").alias("_by")).where(F.size("_by") > 1)
    stars = stars.select(F.array_min("_by").alias("v"), F.explode("_by").alias("u")).where("u > v").select("u", "v")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (u, v with u > v): the smallest node of its component."""

    def checked(df: DataFrame) -> tuple[Stash, tuple]:
        table = Stash(df, "simhash-edges", rows=F.count(F.lit(1)), hashes=F.bit_xor(F.xxhash64("u", "v")))
        return table, (table.seen["rows"], table.seen["hashes"])

    now, state = checked(edges)
    while state[0]:
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        step = Stash(sized(large, 2 * state[0]), "simhash-large")
        least = step.df.groupBy("u").agg(F.min("v").alias("m"))
        small = step.df.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        after, found = checked(sized(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u > v").distinct(), 2 * state[0]))
        step.drop()
        now.drop()
        tidy()
        now, (state, before) = after, (found, state)
        if state == before:
            break
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links reach), group_size."""
    rows = Stash(fingerprints(docs, id_col, text_col, shingle), "simhash-prints").df
    prints = Stash(rows.groupBy("_print").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows")), "simhash-distinct").df
    roots = components(links(prints.select("_print"), blocks, distance, bucket))
    rooted = prints.join(roots, prints["_print"] == roots["node"], "left").select("_print", "_least", "_rows", F.coalesce("root", "_print").alias("_root"))
    best = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.sum("_rows").alias("group_size"))
    found = stash(rooted.select("_print", "_rows", "_root").join(best, "_root").drop("_root"), "simhash-components")
    total = rows.count()
    return unhot_join(rows, found, "_print", "_rows", total).select("doc_id", F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), "component_id", "group_size")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but one row of each component, with all columns of docs: of the rows with its smallest doc_id
    the first in a numbering of the rows."""
    table, row = numbered_rows(docs, "simhash-numbered")
    # Numbers rank rows by doc_id first, so the smallest of a component is that of the row that stays.
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc_id"), F.col(row).alias("row"))
    found = simhash_dedup(table.select(rank.alias("rank"), F.col(text_col).alias("text")), "rank", "text", **how)
    dropped = found.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(row))
    return table.join(dropped, row, "left_anti").select(*docs.columns)
