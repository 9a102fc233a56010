"""Approximate nearest neighbours: count shared terms, keep the best candidates, score those exactly.

Postings have a row for each term of each vector: id, tbl, hash, freq. Counting is one equi-join with the query's
terms and one aggregate that combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import VectorError
from ..functions.hashing import HashModel, Term
from ..functions.similarity import literal, similarity, sorted_sparse
from ..vectors import DenseFloat, Similarity, SparseBool
from .blocks import Best, Codes, Hits, TermBlock, ids_of, pack, with_pair_scores, with_terms
from .exact import BLOCK, BROADCAST_BYTES, CHUNK, dealt, kept, part_of, ranked, scan_of, top

POSTINGS = "id, tbl, hash, freq"


def postings_of(corpus: DataFrame, model: HashModel, id_col: str = "id", vec_col: str = "vec", probes: int = 0) -> DataFrame:
    """id, tbl, hash, freq; rows without a vector have none."""
    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"))
    terms = with_terms(rows, "_v", model, "_terms", probes).select("id", F.explode("_terms").alias("_t"))
    return terms.select("id", "_t.tbl", "_t.hash", "_t.freq")


def term_table(spark: SparkSession, terms: list[Term]) -> DataFrame:
    """tbl, hash, q_freq, times: a query's terms, with how often each occurs."""
    counted: dict[Term, int] = {}
    for t in terms:
        counted[t] = counted.get(t, 0) + 1
    return spark.createDataFrame([(t, list(h), f, n) for (t, h, f), n in counted.items()], "tbl int, hash array<int>, q_freq int, times int")


def lookup(postings: DataFrame, tbl: int, hashed: tuple[int, ...]) -> DataFrame:
    """The postings of one term."""
    return postings.where((F.col("tbl") == tbl) & (F.col("hash") == F.lit(list(hashed)).cast("array<int>")))


def lookup_bytes(postings: DataFrame, model: HashModel, term: bytes, field: str = "vec") -> DataFrame:
    """The postings of the term that has these bytes in indexes which store terms as bytes."""
    if not isinstance(term, (bytes, bytearray)):
        raise VectorError(f"Field [{field}] doesn't support term queries with value of type [{type(term).__name__}]")
    found = [lookup(postings, tbl, hashed) for tbl, hashed in model.terms_of(bytes(term))]
    return reduce(DataFrame.unionByName, found) if found else postings.limit(0)


def hit_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """id, hits. Each occurrence of a term in the query counts what both sides have of it; ids without a hit are out.

    A query has as many terms as tables and probes, so they are broadcast.
    """
    found = postings.join(F.broadcast(terms), ["tbl", "hash"])
    return found.groupBy("id").agg(F.sum(F.least("q_freq", "freq") * F.col("times")).cast("long").alias("hits"))


def presence_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """id, hits: the occurrences of query terms that the row has, whatever their frequencies."""
    return postings.join(F.broadcast(terms), ["tbl", "hash"]).groupBy("id").agg(F.sum("times").cast("long").alias("hits"))


def candidates(hits: DataFrame, n: int, segment: Column | None = None) -> DataFrame:
    """The n rows with most hits, ties by id; with a segment, n of each."""
    if segment is None:
        return hits.orderBy(F.desc("hits"), "id").limit(n)
    return ranked(hits.withColumn("segment", segment), n, "segment", "id", "hits").drop("rank")


def segment_of(id_col: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(segments)).cast("int")


def approximate_topk(corpus: DataFrame, postings: DataFrame, query: DenseFloat | SparseBool, model: HashModel, kind: Similarity | str, n_candidates: int, k: int, id_col: str = "id", vec_col: str = "vec", probes: int = 0, segment: Column | None = None, fetch: tuple[str, ...] = ()) -> DataFrame:
    """id, score, hits and the columns to fetch of the k best candidates."""
    terms = model.hash_literal(query, probes) if probes else model.hash_literal(query)
    chosen = candidates(hit_counts(postings, term_table(corpus.sparkSession, terms)), n_candidates, segment)
    if segment is None:
        chosen = F.broadcast(chosen)  # n_candidates rows
    stored = corpus.where(F.col(vec_col).isNotNull()).join(chosen.select(F.col("id").alias("_id"), "hits"), F.col(id_col) == F.col("_id"))
    return top(stored.select(id_col, similarity(kind, literal(query), F.col(vec_col)).alias("score"), "hits", *fetch), k, id_col)


#: Candidates of one query up to which their ids go to the driver, to be looked up.
FETCHED = 10_000


def lookup_topk(rows_of, postings: DataFrame, query: DenseFloat | SparseBool, terms: list[Term], kind: Similarity | str, n_candidates: int, k: int, id_col: str = "id", vec_col: str = "vec", fetch: tuple[str, ...] = ()) -> DataFrame:
    """What approximate_topk() gives, with vectors read for the candidates alone: their ids, at most n_candidates, are
    collected, and rows_of(ids) has their rows."""
    spark, id_type = postings.sparkSession, postings.schema["id"].dataType.simpleString()
    found = [tuple(r) for r in candidates(hit_counts(postings, term_table(spark, terms)), n_candidates).collect()]
    hits = F.broadcast(spark.createDataFrame(found, f"_id {id_type}, hits long"))
    stored = rows_of([i for i, _ in found]).where(F.col(vec_col).isNotNull()).join(hits, F.col(id_col) == F.col("_id"))
    return top(stored.select(id_col, similarity(kind, literal(query), F.col(vec_col)).alias("score"), "hits", *fetch), k, id_col)


def explain_approximate(hits: DataFrame, n_hashes: int) -> DataFrame:
    text = F.format_string("Share [%d] of [%d] hashes. Exact similarity is [%f].", F.col("hits"), F.lit(n_hashes), F.col("score"))
    return hits.withColumn("explanation", text)


def approximate_join(queries: DataFrame, corpus: DataFrame, postings: DataFrame | None, model: HashModel, kind: Similarity | str, n_candidates: int, k: int, qid_col: str = "qid", q_col: str = "vec", id_col: str = "id", vec_col: str = "vec", probes: int = 0, segments: int = 1) -> DataFrame:
    """qid, id, score, hits, rank: the k best candidates of each query, all queries in one job. Each of the segments,
    to which ids are dealt by hash, has n_candidates of its own. postings: None for those of the corpus by the model.

    Most pairs of a query and a row share a term where tables have few hashes, so pairs that do are not written down: both
    sides are packed into blocks with their terms, which dealt() brings together, hits of a pair of blocks are counted in
    memory, and a task keeps the best candidates of its queries with their scores. Rows that share an id with others meet
    by _join_by_terms() instead.
    """
    kind = Similarity.of(kind)
    q = queries.where(F.col(q_col).isNotNull()).select(F.col(qid_col).alias("qid"), (sorted_sparse(F.col(q_col)) if kind.sparse else F.col(q_col)).alias("vec"))
    stored = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    if _repeated(q, "qid") or _repeated(stored, "id"):
        return _join_by_terms(q, stored, postings_of(stored, model) if postings is None else postings, model, kind, n_candidates, k, probes, segments)
    if postings is None:
        hashed = with_terms(stored, "vec", model, "terms")
    else:
        hashed = stored.join(postings.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tbl", "hash", "freq"))).alias("terms")), "id")
    segment = segment_of(F.col("id"), segments) if segments > 1 else F.lit(0)

    def of_queries(df: DataFrame) -> DataFrame:
        return pack(with_terms(df, "vec", model, "terms", probes), "qid", "vec", BLOCK, kind.sparse, "terms")

    def of_corpus(df: DataFrame) -> DataFrame:
        parts = [pack(df.where(segment == s) if segments > 1 else df, "id", "vec", BLOCK, kind.sparse, "terms").withColumn("segment", F.lit(s)) for s in range(segments)]
        return reduce(DataFrame.unionByName, parts).withColumn("no", F.monotonically_increasing_id())

    pairs, shares = dealt(q, hashed, of_queries, of_corpus)
    q_type, id_type = q.schema["qid"].dataType, stored.schema["id"].dataType
    q_arrow, id_arrow = to_arrow_type(q_type), to_arrow_type(id_type)
    n_best = max(1, n_candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        state: dict = {}  # by query block: its ids, vectors and terms, and of each segment the best candidates, by hits
        last = None
        for b in batches:
            c = {name: b.column(name) for name in b.schema.names}
            for n in range(b.num_rows):
                if last != c["no"][n].as_py():
                    last, ids, rows, part = c["no"][n].as_py(), ids_of(c["ids"][n]), c["rows"][n].as_py(), c["segment"][n].as_py()
                    scan = scan_of(kind, kept(c["cells"][n].as_buffer(), rows, kind.sparse))
                    codes = Codes(TermBlock.frombytes(bytes(c["terms"][n].as_buffer()), rows))
                    least_id = ids.min() if ids.dtype != object else None
                if (no := c["q_no"][n].as_py()) not in state:
                    rows = c["q_rows"][n].as_py()
                    state[no] = c["q_ids"][n].values, kept(c["q_cells"][n].as_buffer(), rows, kind.sparse), TermBlock.frombytes(bytes(c["q_terms"][n].as_buffer()), rows), {}
                qids, asked, terms, found = state[no]
                best = found.setdefault(part, Best(len(qids), n_best, ids.dtype))
                if ids.dtype != best.ids.dtype:
                    ids, best.ids, least_id = ids.astype(object), best.ids.astype(object), None
                hits = Hits(codes, terms)
                for lo in range(0, len(qids), CHUNK // 4):
                    hi = min(lo + CHUNK // 4, len(qids))
                    counted, cut = hits.of(lo, hi), best.cut(lo, hi)
                    least = np.maximum(cut, 1)
                    if len(ids) > n_best and (fresh := np.flatnonzero(np.isneginf(cut))).size:
                        least[fresh] = np.maximum(1, np.partition(counted[fresh], len(ids) - n_best, axis=1)[:, len(ids) - n_best])
                    if least_id is not None:  # all ids of the block come after the last candidate's, so more hits are needed
                        least += (cut >= 1) & (best.ids[lo:hi, -1] < least_id)
                    least = np.minimum(least, np.iinfo(counted.dtype).max).astype(counted.dtype)
                    which, at = np.divmod(np.flatnonzero(counted >= least[:, None]), len(ids))
                    if len(which):
                        some = part_of(asked, lo, hi)
                        best.add(which + lo, counted[which, at].astype(float), ids[at], lambda new: scan.scores(some, which[new], at[new]))
        for qids, _, _, found in state.values():
            chosen = [x.found() for x in found.values()]
            if shares == 1:  # no other task has candidates of these queries
                last_best = Best(len(qids), k, object if any(x[1].dtype == object for x in chosen) else np.int64)
                for which, names, hit, score in chosen:
                    last_best.add(which, score, names, lambda new: hit[new])
                chosen = [tuple(last_best.found()[i] for i in (0, 1, 3, 2))]
            for part, (which, names, hit, score) in zip(found, chosen):
                for lo in range(0, len(which), 1 << 16):
                    hi = lo + (1 << 16)
                    columns = [qids.take(pa.array(which[lo:hi])).cast(q_arrow), pa.array(names[lo:hi], id_arrow), pa.array(hit[lo:hi].astype(np.int64)), pa.array(score[lo:hi], pa.float64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), part, np.int32))], ["qid", "id", "hits", "score", "part"])

    schema = T.StructType([T.StructField("qid", q_type), T.StructField("id", id_type), T.StructField("hits", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("part", T.IntegerType())])
    chosen = pairs.mapInArrow(run, schema)
    if shares > 1:
        order = Window.partitionBy("qid", "part").orderBy(F.desc("hits"), "id")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_candidates)
    return ranked(chosen.select("qid", "id", "hits", "score"), k)


def _repeated(df: DataFrame, column: str) -> bool:
    return bool(df.groupBy(column).count().where("count > 1").take(1))


def _join_by_terms(q: DataFrame, stored: DataFrame, postings: DataFrame, model: HashModel, kind: Similarity, n_candidates: int, k: int, probes: int, segments: int) -> DataFrame:
    """approximate_join() by a join of terms, in which the hits of rows that share an id add up."""
    terms = postings_of(q, model, "qid", "vec", probes).groupBy(F.col("id").alias("qid"), "tbl", "hash", F.col("freq").alias("q_freq")).agg(F.count(F.lit(1)).alias("times"))
    if terms.count() * 64 <= BROADCAST_BYTES:
        terms = F.broadcast(terms)
    hits = postings.join(terms, ["tbl", "hash"]).groupBy("qid", "id").agg(F.sum(F.least("q_freq", "freq") * F.col("times")).cast("long").alias("hits"))
    order = Window.partitionBy("qid", segment_of(F.col("id"), segments)).orderBy(F.desc("hits"), "id")
    chosen = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_candidates).drop("rank")
    pairs = chosen.join(stored.withColumnRenamed("vec", "_v"), "id").join(q.withColumnRenamed("vec", "_q"), "qid")
    return ranked(with_pair_scores(pairs.select("qid", "id", "hits", "_q", "_v"), kind, "_q", "_v").select("qid", "id", "hits", "score"), k)
