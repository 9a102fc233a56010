"""Near-deduplication of a corpus by the Jaccard similarity of whole sets of five-word shingles.

1. Rows of equal sets are one node. A node has BANDS keys, each of ROWS MinHash values, so two sets of similarity s
   share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8, and more above.
2. Nodes that share a key are candidates. In each of STARS steps the nodes of a key that aren't in the component of most
   of its nodes are compared with PIVOTS of those, the pivots; in the first step a node is compared with one pivot only,
   of all its keys. After that every such node is compared with all nodes of the key that are in other components, first
   by four bits of each MinHash value: two sets of similarity 0.8 differ in over UNLIKE of the ROWS * BANDS with
   probability 3e-7, and only those that don't are compared whole. So no two nodes of a key end in different components
   without a comparison, while a large group of near copies is linked by its pivots, and texts that share a passage but
   little else make few pairs.
3. Candidates are linked where their whole sets have a similarity of NEAR or more. Of each component of links one row
   stays: of those with the smallest doc_id the first in a numbering of the rows; a null doc_id is larger than all others.

Rows that another operator gives one component_id (`linked`, in the pipeline simhash_dedup) are linked to begin with, and
the above joins what that leaves apart. SimHash alone doesn't find such pairs: the fingerprints of sets of similarity 0.8
differ in 15 of 100 bits, so no choice of blocks that they surely share is long enough to tell texts apart, and blocks that
they share by chance would need about 60 keys of 16 bits a document, each shared by one of 65 536 unrelated texts.

Words are split and lower-cased as for SimHash. A text of fewer words than a shingle is one shingle, and texts without a
word, null ones too, are equal. Verdicts are of rows, whatever doc_id they share. A text's shingles are held in one
worker, 8 bytes each, however long it is. Only the two named columns are read; all of docs come back, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, Held, Stash, hash_place, numbered_rows, scratch, share_for, sized, tidy, unhot_join
from .simhash import components

SHINGLE, ROWS, BANDS, STARS, PIVOTS = 5, 6, 24, 2, 6
#: The nodes around a component that are compared in pairs, and how many of more nodes are looked at to order differences.
BUCKET, SAMPLE = 32, 16
#: How many shared differences a pair is looked for by: more than the five shingles of one changed word.
MATCHES = 6
#: The similarity of linked sets, as a fraction.
NEAR = (4, 5)
#: Of ROWS * BANDS MinHash values with their lowest four bits, how many may differ in sets that are compared whole.
UNLIKE = 50
#: Shingles that are hashed by all functions at a time.
STEP = 4096


def shingle_set(text: bytes | None, shingle: int = SHINGLE):
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    parts = zip(*(found[i:] for i in range(shingle))) if len(found) > shingle else [found]
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(p), 42) for p in parts), np.uint64))


def _digest(shingles) -> bytes:
    from hashlib import blake2b

    return blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(rows: DataFrame) -> DataFrame:
    """_row, doc_id, _set (a digest), _n (its size), _bands, _signs: a row for each row of _row, doc_id, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        factors = np.random.default_rng(0).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)

        def keys(s) -> tuple[list[int], list[int]]:
            """The bands, and four bits of each value, sixteen a number."""
            least = np.min([(s[i : i + STEP, None] * factors).min(axis=0) for i in range(0, len(s), STEP)], axis=0)
            bits = (least & np.uint64(15)).astype(np.uint8)
            signs = (bits[::2] | bits[1::2] << 4).view("<i8").tolist()
            return [xxh64_intdigest(m.tobytes(), b) - (1 << 63) for b, m in enumerate(least.reshape(BANDS, ROWS))], signs

        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for lo in range(0, b.num_rows, 1000):
                sets = [shingle_set(t) for t in texts.slice(lo, 1000).to_pylist()]
                both = list(map(keys, sets))
                columns = [pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), *(pa.array((x[k] for x in both), pa.list_(pa.int64())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1000), b.column(1).slice(lo, 1000), *columns], ["_row", "doc_id", "_set", "_n", "_bands", "_signs"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, _set binary, _n long, _bands array<long>, _signs array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """_node, _shingles: the whole sets, as bytes, of rows of _node, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for lo in range(0, b.num_rows, 1000):
                sets = (shingle_set(t).tobytes() for t in texts.slice(lo, 1000).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1000), pa.array(sets, pa.binary())], ["_node", "_shingles"])

    return rows.select("_node", "_text").mapInArrow(run, "_node long, _shingles binary")


def verified(pairs: Stash, sets: DataFrame) -> tuple[DataFrame, Held]:
    """The pairs (u, v) of nodes whose whole sets are near, and what is held until they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(NEAR[1] * both >= NEAR[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    out = pairs.df
    asked = out.select(F.explode(F.array("u", "v")).alias("_node")).groupBy("_node").agg(F.count(F.lit(1)).alias("_pairs"))
    whole = Held(sets.join(asked, "_node"))
    for side in ("v", "u"):
        one = whole.df.select(F.col("_node").alias(side), F.col("_shingles").alias(f"_of_{side}"), F.col("_pairs").alias(f"_pairs_{side}"))
        out = unhot_join(out, one, side, f"_pairs_{side}", pairs.seen["rows"])
    return out.select("u", "v", "_of_u", "_of_v").mapInArrow(run, "u long, v long"), whole


def _standing(groups: DataFrame) -> DataFrame:
    """_most, _of (the sets looked at), _items (shingles in two or more of them), _counts: for rows of _most, _some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for i in range(b.num_rows):
                some = [np.frombuffer(s.as_py(), np.uint64) for s in b.column(1)[i].values]
                items, counts = np.unique(np.concatenate(some), return_counts=True)
                often = counts > 1
                row = [b.column(0).slice(i, 1), pa.array([len(some)], pa.int64()), *(pa.array([x[often].astype(np.uint64).tobytes()], pa.binary()) for x in (items, counts))]
                yield pa.RecordBatch.from_arrays(row, ["_most", "_of", "_items", "_counts"])

    return groups.select("_most", "_some").mapInArrow(run, "_most long, _of long, _items binary, _counts binary")


def _differences(rows: DataFrame) -> DataFrame:
    """_most, _node, _n, _root, _off (how many differences a set has), _rare (the first of them, rarest first): for rows of
    _most, _node, _n, _root, _shingles, _of, _items, _counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            off, rare = [], []
            for x, of, items, counts in zip(*(b.column(i).to_pylist() for i in range(4, 8))):
                x, items, counts = (np.frombuffer(s or b"", np.uint64) for s in (x, items, counts))
                usual = 2 * counts > (of or 0)
                # A difference is one of a set that has an unusual item or lacks a usual one.
                seen = np.isin(items, x, assume_unique=True)
                odd = np.concatenate([np.setdiff1d(x, items, assume_unique=True), items[seen != usual]])
                held = np.concatenate([np.zeros(len(odd) - (seen != usual).sum(), np.uint64), np.where(usual, np.uint64(of or 0) - counts, counts)[seen != usual]])
                # Of a near pair, the rarest shared difference is among so many of each.
                first = np.lexsort((odd, held))[: len(x) * (NEAR[1] - NEAR[0]) // NEAR[0] + 1]
                off.append(len(odd))
                rare.append(odd[first].view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(off, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], ["_most", "_node", "_n", "_root", "_off", "_rare"])

    return rows.select("_most", "_node", "_n", "_root", "_shingles", "_of", "_items", "_counts").mapInArrow(run, "_most long, _node long, _n long, _root long, _off long, _rare array<long>")


def by_differences(members: DataFrame, sizes: DataFrame, sets: DataFrame, total: int) -> tuple[DataFrame, Held]:
    """_node, _pivot: what must be compared that all near nodes of a _most, of members (_most, _node, _n, _root), end in one
    component; and what is held until that is written. sizes has _most, _size."""
    places = unhot_join(members.select("_most", "_node"), sizes, "_most", "_size", total)
    looked = places.where(hash_place(F.col("_node")) < share_for(SAMPLE, F.col("_size"))).join(sets, "_node")
    standing = _standing(looked.groupBy("_most").agg(F.collect_list("_shingles").alias("_some")))
    standing = Stash(sizes.join(standing, "_most", "left"), "near-standing").df
    rows = Stash(_differences(unhot_join(members.join(sets, "_node"), standing, "_most", "_size", total)), "near-differences").df
    # Sets differ by at most so much of both sizes, as a fraction. Without a shared difference they differ by all of both.
    few, of = NEAR[1] - NEAR[0], NEAR[1] + NEAR[0]
    spare = F.col("_n") * few - F.col("_off") * of
    best = rows.groupBy("_most").agg(F.max(F.struct(spare.alias("spare"), "_node", "_root")).alias("_best"))
    stars = unhot_join(rows, best.join(sizes, "_most"), "_most", "_size", total).where((F.col("_root") != F.col("_best._root")) & (spare + F.col("_best.spare") >= 0))
    items = Held(rows.select("_most", "_node", "_n", "_root", "_off", F.size("_rare").alias("_first"), F.posexplode("_rare").alias("_at", "_item")))
    x, y = (items.df.select("_most", "_item", *(F.col(c).alias(c + end) for c in ("_node", "_n", "_root", "_off", "_at", "_first"))) for end in ("_x", "_y"))
    # Of a near pair's shared differences, at least `common`, the rarest `asked` are among the first off - common + asked of each.
    common = F.ceil((F.col("_off_x") + F.col("_off_y") - F.floor((F.col("_n_x") + F.col("_n_y")) * few / of)) / 2)
    asked = F.least(F.lit(MATCHES), common, *(F.col(f"_first_{e}") - F.col(f"_off_{e}") + common for e in "xy"))
    early = [F.col(f"_at_{e}") < F.col(f"_off_{e}") - common + asked for e in "xy"]
    fit = (F.col("_node_x") > F.col("_node_y")) & (F.col("_root_x") != F.col("_root_y")) & (common > 0) & early[0] & early[1]
    shared = x.join(y, ["_most", "_item"]).where(fit).groupBy("_most", "_node_x", "_node_y").agg(F.count(F.lit(1)).alias("_shared"), F.first(asked).alias("_asked"))
    shared = shared.where("_shared >= _asked").select(F.col("_node_x").alias("_node"), F.col("_node_y").alias("_pivot"))
    return shared.unionByName(stars.select("_node", F.col("_best._node").alias("_pivot"))), items


def grouped(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the components of nodes (_node, _set) whose rows found (_set, _group) puts in one group."""
    named = Stash(found.distinct().join(nodes.select("_set", "_node"), "_set").select("_group", "_node"), "near-grouped", rows=F.count(F.lit(1)))
    least = named.df.groupBy("_group").agg(F.min("_node").alias("_least"), F.count(F.lit(1)).alias("_nodes")).where("_nodes > 1")
    edges = unhot_join(named.df, least, "_group", "_nodes", named.seen["rows"]).where("_node > _least")
    return components(sized(edges.select(F.col("_node").alias("u"), F.col("_least").alias("v")).distinct(), named.seen["rows"]))


def roots(nodes: DataFrame, rows: DataFrame, stars: int = STARS, start: DataFrame | None = None) -> DataFrame:
    """node, root: the components of all links among nodes (_node, _n, _best, _bands, _signs) that share a key, and of
    those of start (node, root)."""

    def fit(x: Column, y: Column) -> Column:
        return F.least(x, y) * NEAR[1] >= F.greatest(x, y) * NEAR[0]

    def unlike(x: Column, y: Column) -> Column:
        """How many groups of four bits differ."""
        out = F.lit(0)
        for i in range(ROWS * BANDS // 16):
            t = x[i].bitwiseXOR(y[i])
            for n in (2, 1):
                t = t.bitwiseOR(F.shiftrightunsigned(t, n))
            out = out + F.bit_count(t.bitwiseAND(F.lit(0x1111111111111111)))
        return out

    keyed = nodes.select("_node", "_n", F.explode("_bands").alias("_key"))
    keys = Held(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_nodes")).where("_nodes > 1"))
    total = BANDS * nodes.count()
    shared = unhot_join(keyed, keys.df, "_key", "_nodes", total).select("_key", "_node", "_n", F.col("_node").alias("_root"))
    if start is not None:
        # A component to begin with is a key too, so all of its nodes are here.
        begun = nodes.select("_node", "_n").join(start.toDF("_node", "_root"), "_node").select(F.xxhash64("_root", F.lit("start")).alias("_key"), "_node", "_n", "_root")
        shared = shared.drop("_root").join(start.toDF("_node", "_root"), "_node", "left").select("_key", "_node", "_n", F.coalesce("_root", "_node").alias("_root")).unionByName(begun)
    first = Stash(shared, "near-rooted", rows=F.count(F.lit(1)))
    keys.drop()
    rooted, size = first.df, first.seen["rows"]
    # The texts of candidates are read once, by the row that stands for a node.
    named = rooted.select("_node").distinct().join(nodes.select("_node", F.col("_best._row").alias("_row")), "_node")
    sets = Stash(_sets(rows.join(named, "_row")), "near-sets").df
    asked = None
    for step in [*range(stars), None]:
        held, crowds = [], None
        chosen = [F.min_by("_node", F.xxhash64("_node", F.lit(n))) for n in range(PIVOTS if step else 1)]
        of = rooted.groupBy("_key", "_root").agg(F.count(F.lit(1)).alias("_of"), F.array(*chosen).alias("_pivots"))
        most = F.max(F.struct("_of", "_root", "_pivots")).alias("_most")
        mixed = of.groupBy("_key").agg(most, F.sum("_of").alias("_weight"), F.count(F.lit(1)).alias("_roots")).where("_roots > 1")
        mixed = Held(mixed.select("_key", F.col("_most._root").alias("_most"), F.array_distinct("_most._pivots").alias("_pivots"), "_weight"))
        some = unhot_join(rooted, mixed.df, "_key", "_weight", total)
        rest = some.where("_root <> _most")
        if step == 0:
            rest = rest.groupBy("_node").agg(F.max(F.col("_pivots")[0]).alias("_pivot"))
        elif step is not None:
            rest = rest.select("_node", F.explode("_pivots").alias("_pivot"))
        else:
            members = Stash(some.select("_most", "_node", "_n", "_root").distinct(), "near-members", rows=F.count(F.lit(1)))
            held.append(Held(members.df.groupBy("_most").agg(F.count(F.lit(1)).alias("_size"))))
            sizes = held[0].df
            crowded = sizes.where(F.col("_size") > BUCKET)
            if crowded.count():
                around = unhot_join(members.df, crowded, "_most", "_size", members.seen["rows"]).drop("_size")
                crowds, kept = by_differences(around, crowded, sets, members.seen["rows"])
                held.append(kept)
            some = unhot_join(rooted, mixed.df.join(sizes.where(F.col("_size") <= BUCKET), "_most"), "_key", "_weight", total)
            signed = some.join(nodes.select("_node", "_signs"), "_node")
            other = signed.where("_root <> _most").select("_key", F.col("_node").alias("_pivot"), F.col("_n").alias("_n_x"), F.col("_root").alias("_root_x"), F.col("_signs").alias("_signs_x"))
            like = fit(F.col("_n"), F.col("_n_x")) & (unlike(F.col("_signs"), F.col("_signs_x")) <= UNLIKE)
            rest = signed.join(other, "_key").where((F.col("_root") != F.col("_root_x")) & like).select("_node", "_pivot")
            rest = rest.unionByName(crowds) if crowds is not None else rest
        pairs = rest.select(F.greatest("_node", "_pivot").alias("u"), F.least("_node", "_pivot").alias("v")).distinct()
        pairs = pairs if asked is None else pairs.join(asked, ["u", "v"], "left_anti")
        pairs = Stash(pairs if step is None else sized(pairs, size * len(chosen)), "near-pairs", rows=F.count(F.lit(1)))
        for table in (mixed, *held):
            table.drop()
        tidy()
        if not pairs.seen["rows"]:
            continue
        asked = pairs.df if asked is None else asked.unionByName(pairs.df)
        near, whole = verified(pairs, sets)
        links = Stash(near.repartition(1 + size // FILE_ROWS), "near-links", rows=F.count(F.lit(1)))
        whole.drop()
        if links.seen["rows"]:
            found = links.df
            root = rooted.select("_node", "_root").distinct()
            ends = found.join(root.toDF("u", "a"), "u").join(root.toDF("v", "b"), "v").where("a <> b")
            merged = components(sized(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), size))
            after = rooted.join(merged, rooted["_root"] == merged["node"], "left")
            rooted = Stash(sized(after.select("_key", "_node", "_n", F.coalesce("root", "_root").alias("_root")), size), "near-rooted").df
    return rooted.select(F.col("_node").alias("node"), F.col("_root").alias("root")).distinct()


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stars: int = STARS, linked: Callable[..., DataFrame] | None = None) -> DataFrame:
    """docs without all but one row of each component, with all columns of docs. linked(rows, id_col, text_col) gives
    doc_id, component_id and group_size of rows that are linked besides."""
    table, row = numbered_rows(docs, "near-numbered")
    rows = table.select(F.col(row).alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    signed = Stash(signatures(rows), "near-signatures").df
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_best")
    alike = signed.groupBy("_set").agg(best, F.count(F.lit(1)).alias("_rows"), *(F.first(c).alias(c) for c in ("_n", "_bands", "_signs")))
    nodes = Stash(alike.withColumn("_node", F.monotonically_increasing_id()), "near-nodes").df
    start = None
    if linked:
        # What linked leaves goes at once: held tables weigh on the driver in all that follows.
        with scratch():
            groups = linked(rows, "_row", "_text").where("group_size > 1").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
            groups = Stash(groups, "near-groups", keep=True)
        start = grouped(groups.df.join(signed.select("_row", "_set"), "_row").select("_set", "_group"), nodes)
        groups.drop()
    found = roots(nodes, rows, stars, start)
    rooted = nodes.select("_node", "_set", "_best", "_rows").join(found, nodes["_node"] == found["node"], "left").withColumn("_root", F.coalesce("root", "_node"))
    first = rooted.groupBy("_root").agg(F.min("_best").alias("_first"), F.count(F.lit(1)).alias("_nodes"))
    # Nodes of one row that no other is linked to stay.
    kept = Stash(rooted.join(first, "_root").where("_rows > 1 OR _nodes > 1").select("_set", F.col("_first._row").alias("_keep"), "_rows"), "near-kept").df
    judged = unhot_join(signed.select("_row", "_set"), kept, "_set", "_rows", signed.count())
    dropped = judged.where("_row <> _keep").select(F.col("_row").alias(row))
    return table.join(dropped, row, "left_anti").select(*docs.columns)
