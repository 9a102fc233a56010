"""Exact nearest neighbours: score every vector, keep the best."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.similarity import DenseScan, SparseScan, cosine, literal, similarity, size_of, sorted_sparse
from ..vectors import DenseFloat, Similarity, SparseBool
from .blocks import NARROW, Best, ids_of, pack, unpack

#: Bytes of query vectors up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of a block at most, and queries of a block that are scored at a time.
BLOCK, CHUNK = 4096, 256
#: Queries whose best rows a task holds at most, give or take a few, and at least where there are fewer tasks than cores could run.
HELD, LEAST = 16_384, 256
#: Pairs of vectors up to which knn_join() scores them by expressions.
FEW_PAIRS = 4_000_000


def with_score(corpus: DataFrame, query: DenseFloat | SparseBool | Column, kind: Similarity | str, vec_col: str = "vec", into: str = "score") -> DataFrame:
    """The rows with a vector, and their score."""
    q = query if isinstance(query, Column) else literal(query)
    return corpus.where(F.col(vec_col).isNotNull()).withColumn(into, similarity(kind, q, F.col(vec_col)))


def top(scored: DataFrame, k: int, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """The k best rows, ties by id: each task keeps k, and only those meet."""
    return scored.orderBy(F.desc(score_col), id_col).limit(k)


def exact_topk(corpus: DataFrame, query: DenseFloat | SparseBool | Column, kind: Similarity | str, k: int, id_col: str = "id", vec_col: str = "vec", fetch: tuple[str, ...] | None = ()) -> DataFrame:
    """id, score and the columns to fetch (None: all) of the k nearest rows."""
    scored = with_score(corpus, query, kind, vec_col)
    columns = [c for c in corpus.columns if c != id_col] if fetch is None else list(fetch)
    return top(scored.select(id_col, "score", *columns), k, id_col)


def explain_exact(hits: DataFrame) -> DataFrame:
    return hits.withColumn("explanation", F.lit("Exact similarity of the query vector and the stored vector."))


def ranked(scored: DataFrame, k: int, by: str = "qid", id_col: str = "id", score_col: str = "score") -> DataFrame:
    """The k best rows of each query with their rank from 1. Tasks cut to k before anything is shuffled."""
    order = Window.partitionBy(by).orderBy(F.desc(score_col), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bytes(df: DataFrame, vec_col: str) -> int:
    """What the vectors of df hold."""
    size = F.coalesce(F.size(F.col(vec_col)) if isinstance(df.schema[vec_col].dataType, T.ArrayType) else F.size(F.col(vec_col)["true_indices"]), F.lit(0))
    return df.agg(F.sum((4 * size + 32).cast("long"))).first()[0] or 0


def _broadcast_if_small(queries: DataFrame, vec_col: str) -> DataFrame:
    """queries, marked for broadcast after a count of what they hold."""
    return F.broadcast(queries) if _bytes(queries, vec_col) <= BROADCAST_BYTES else queries


def knn_join(queries: DataFrame, corpus: DataFrame, kind: Similarity | str, k: int, qid_col: str = "qid", q_col: str = "vec", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """qid, id, score, rank: the k nearest rows of each query. Up to FEW_PAIRS pairs are scored by expressions, more by
    knn_join_blocks(), a hundred times as fast."""
    kind = Similarity.of(kind)
    if queries.count() * corpus.count() > FEW_PAIRS:
        return knn_join_blocks(queries, corpus, kind, k, qid_col, q_col, id_col, vec_col)
    asked = sorted_sparse(F.col(q_col)) if kind.sparse else F.col(q_col)
    q = queries.where(F.col(q_col).isNotNull()).select(F.col(qid_col).alias("qid"), asked.alias("_q"))
    stored = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"))
    if kind is Similarity.COSINE:  # sizes are of rows, not of pairs
        q, stored = q.withColumn("_qs", size_of(F.col("_q"))), stored.withColumn("_vs", size_of(F.col("_v")))
        score = cosine(F.col("_q"), F.col("_v"), F.col("_qs") * F.col("_vs"))
    else:
        score = similarity(kind, F.col("_q"), F.col("_v"), normal=True)
    return ranked(stored.crossJoin(_broadcast_if_small(q, "_q")).select("qid", "id", score.alias("score")), k)


def dealt(queries: DataFrame, corpus: DataFrame, of_queries, of_corpus) -> tuple[DataFrame, int]:
    """(every pair of a block of queries, with q_ before its columns, and a stored block; among how many tasks the stored
    blocks of a query are). of_queries, of_corpus: pack such rows.

    A task has some queries, HELD at most, and is handed the stored blocks one after the other, so what it holds doesn't
    grow with either side, and each side is shuffled once. All stored blocks come to each task unless queries are few.
    """
    n, m = queries.count(), corpus.count()
    tasks = max(12, 3 * queries.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, -(-n // min(HELD, max(LEAST, -(-n // tasks)))))
    shares = max(1, min(-(-tasks // groups), -(-m // BLOCK)))
    q = of_queries(queries.repartition(groups))
    stored = of_corpus(corpus).repartition(shares)
    return stored.hint("shuffle_replicate_nl").crossJoin(q.select(*(F.col(c).alias(f"q_{c}") for c in q.columns))), shares


def scan_of(kind: Similarity, stored):
    return SparseScan(kind, stored, NARROW) if kind.sparse else DenseScan(kind, stored)


def part_of(block, lo: int, hi: int):
    """Rows lo to hi of a matrix or sparse block."""
    return block[lo:hi] if hasattr(block, "shape") else block.part(lo, hi)


def kept(cells: bytes, rows: int, sparse: bool):
    """The block, as a copy that outlives its batch."""
    return unpack(bytes(cells), rows, sparse)


def knn_join_blocks(queries: DataFrame, corpus: DataFrame, kind: Similarity | str, k: int, qid_col: str = "qid", q_col: str = "vec", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """What knn_join() returns, by products of blocks.

    Both sides are packed into blocks, which dealt() brings together. A task keeps in arrays the best k rows that it has
    seen of each of its queries; of a product, or of l1 of sums of rounded differences, it looks at the rows that may be
    among those, as far as rounding goes, and scores them one by one. So ties are cut by their ids.
    """
    kind = Similarity.of(kind)
    sparse = kind.sparse
    q = queries.where(F.col(q_col).isNotNull()).select(F.col(qid_col).alias("qid"), F.col(q_col).alias("vec"))
    stored = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    pairs, _ = dealt(q, stored, lambda df: pack(df, "qid", "vec", BLOCK, sparse), lambda df: pack(df, "id", "vec", BLOCK, sparse))
    q_type, id_type = q.schema["qid"].dataType, stored.schema["id"].dataType
    q_arrow, id_arrow = to_arrow_type(q_type), to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        state: dict = {}  # by query block: its ids and vectors, and the best rows
        last, scan, ids = None, None, None
        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            for n in range(b.num_rows):
                if last != c["no"][n].as_py():
                    last, ids = c["no"][n].as_py(), ids_of(c["ids"][n])
                    scan = scan_of(kind, kept(c["cells"][n].as_buffer(), c["rows"][n].as_py(), sparse))
                if (no := c["q_no"][n].as_py()) not in state:
                    rows = c["q_rows"][n].as_py()
                    state[no] = c["q_ids"][n].values, kept(c["q_cells"][n].as_buffer(), rows, sparse), Best(rows, k, ids.dtype)
                _, asked, best = state[no]
                if ids.dtype != best.ids.dtype:
                    ids, best.ids = ids.astype(object), best.ids.astype(object)
                for lo in range(0, len(best.ids), CHUNK):
                    hi = min(lo + CHUNK, len(best.ids))
                    some, cut = part_of(asked, lo, hi), best.cut(lo, hi)
                    seen = 0
                    if np.isneginf(cut).any():  # some rows give the first cut
                        seen = min(len(ids), max(LEAST, 8 * best.k))
                        which, at = (x.ravel() for x in np.indices((hi - lo, seen)))
                        best.add(which + lo, scan.scores(some, which, at, many=True), ids[at])
                        cut = best.cut(lo, hi)
                    near = scan.near(some, cut)
                    near[:, :seen] = False
                    which, at = np.divmod(np.flatnonzero(near), len(ids))  # np.nonzero() takes ten times as long
                    if len(which):
                        best.add(which + lo, scan.scores(some, which, at, many=True), ids[at])
        for qids, _, best in state.values():
            which, names, scores, _ = best.found()
            for lo in range(0, len(which), 1 << 16):
                hi = lo + (1 << 16)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(which[lo:hi])).cast(q_arrow), pa.array(names[lo:hi], id_arrow), pa.array(scores[lo:hi], pa.float64())], ["qid", "id", "score"])

    schema = T.StructType([T.StructField("qid", q_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    return ranked(pairs.mapInArrow(run, schema), k)


def _dims(df: DataFrame, vec_col: str) -> int | None:
    c = F.col(vec_col)
    dims = F.size(c) if isinstance(df.schema[vec_col].dataType, T.ArrayType) else c["total_indices"]
    row = df.where(c.isNotNull()).select(dims).first()
    return row[0] if row else None


def within(corpus: DataFrame, query: DenseFloat | SparseBool, kind: Similarity | str, min_score: float, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """id, score of all rows that score at least min_score."""
    return with_score(corpus, query, kind, vec_col).where(F.col("score") >= min_score).select(id_col, "score")

