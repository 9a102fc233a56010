"""Joins of many queries: what a task holds and what is shuffled, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.facade import NearestNeighbors
from nearfield.functions.hashing import model_of
from nearfield.functions.similarity import SparseScan
from nearfield.mapping import CosineLsh, HammingLsh, JaccardLsh, L2Lsh, PermutationLsh
from nearfield.operators import approximate as a
from nearfield.operators import exact
from nearfield.operators.blocks import Best, SparseBlock
from nearfield.sources.readers import from_numpy
from nearfield.vectors import Similarity


def rows_of(df, *columns):
    return sorted(tuple(f"{r[c]:.9g}" if c == "score" else r[c] for c in ("qid", "rank", "id", "score", *columns)) for r in df.collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n, dims, sparse, ids="id"):
    """With copies and, of sparse ones, empty rows."""
    r = np.random.default_rng(7)
    x = r.standard_normal((n, dims)).astype(np.float32)
    x[1::5] = x[0]
    x = x > 1.2 if sparse else x
    if sparse:
        x[3::11] = False
    return from_numpy(spark, x).withColumn("id", F.expr(ids))


MODELS = [
    (CosineLsh(24, 6, 3), "cosine", 0),
    (L2Lsh(24, 6, 2, 2), "l2", 0),
    (L2Lsh(24, 5, 3, 3), "l2", 3),
    (JaccardLsh(24, 6, 1), "jaccard", 0),
    (JaccardLsh(24, 6, 3), "jaccard", 0),
    (HammingLsh(24, 6, 4), "hamming", 0),
    (PermutationLsh(24, 6, True), "cosine", 0),
    (PermutationLsh(24, 6, False), "l1", 0),
]


@pytest.mark.parametrize("mapping, kind, probes", MODELS)
@pytest.mark.parametrize("segments", [1, 3])
def test_hits_in_blocks(spark, monkeypatch, mapping, kind, probes, segments):
    """What a join of terms gives, whatever blocks rows fall into, for ids of any kind, with and without postings."""
    ids = "id" if segments == 1 else "concat('x', id % 97, '-', id)"
    df, model = vectors(spark, 400, 24, mapping.sparse, ids).repartition(3), model_of(mapping)
    df = df.withColumn("vec", F.when(F.xxhash64("id") % 10 != 3, F.col("vec")))
    asked = df.where(F.xxhash64("id") % 4 == 0).withColumnRenamed("id", "qid")
    q, stored = asked.where("vec IS NOT NULL").select("qid", "vec"), df.where("vec IS NOT NULL").select("id", "vec")
    postings = a.postings_of(df, model)
    want = rows_of(a._join_by_terms(q, stored, postings, model, Similarity.of(kind), 7, 4, probes, segments), "hits")
    assert want
    for held, block, given in ((16_384, 4096, None), (16_384, 4096, postings), (30, 50, None)):
        monkeypatch.setattr(exact, "HELD", held)
        for module in (a, exact):
            monkeypatch.setattr(module, "BLOCK", block)
        assert rows_of(a.approximate_join(asked, df, given, model, kind, 7, 4, probes=probes, segments=segments), "hits") == want


def test_rows_that_share_an_id_add_up(spark):
    df, model = vectors(spark, 60, 24, False, "id % 40"), model_of(CosineLsh(24, 6, 3))
    asked = df.withColumnRenamed("id", "qid")
    got = a.approximate_join(asked, df, a.postings_of(df, model), model, "cosine", 7, 4)
    assert rows_of(got, "hits") == rows_of(a._join_by_terms(asked.select("qid", "vec"), df.select("id", "vec"), a.postings_of(df, model), model, Similarity.COSINE, 7, 4, 0, 1), "hits")


def test_approximate_joins_write_no_pairs(spark):
    """Hits of pairs are counted in memory: no plan joins terms, and what is shuffled are rows and blocks of vectors, and
    the best of each query."""
    df = vectors(spark, 300, 24, False)
    asked = df.withColumnRenamed("id", "qid")
    fitted = NearestNeighbors(spark, "lsh", "angular", {"L": 6, "k": 3}, {"candidates": 7}).fit(df)
    for found in (a.approximate_join(asked, df, None, model_of(L2Lsh(24, 6, 2, 2)), "l2", 7, 4), fitted.kneighbors_frame(asked, 4)):
        plan = plan_of(found)
        assert "CartesianProduct" in plan and "tbl" not in plan.split("CartesianProduct")[0]
        assert not any(x in plan for x in ("SortMergeJoin", "BroadcastHashJoin", "HashAggregate"))
    fitted.close()


@pytest.mark.parametrize("kind", ["l2", "cosine", "jaccard"])
def test_many_pairs_are_joined_by_blocks(spark, kind):
    df = vectors(spark, 2100, 8, kind == "jaccard")
    asked = df.withColumnRenamed("id", "qid")
    assert 2100**2 > exact.FEW_PAIRS and "MapInArrow" in plan_of(exact.knn_join(asked, df, kind, 3))
    few = asked.where("qid % 300 = 0")
    got = [r for r in rows_of(exact.knn_join(asked, df, kind, 3)) if r[0] % 300 == 0]
    assert "MapInArrow" not in plan_of(exact.knn_join(few, df, kind, 3)) and got == rows_of(exact.knn_join(few, df, kind, 3))


@pytest.mark.parametrize("kind", ["l1", "l2", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e-22, 1e18])
def test_odd_vectors_in_blocks(spark, kind, scale):
    """Values that aren't numbers, zero vectors, very small and very large ones rank as with scores one by one."""
    r = np.random.default_rng(8)
    x = r.standard_normal((900, 6)).astype(np.float32)
    x[::3] *= np.float32(scale)
    x[700] = 0
    x[701] = 0
    x[500, 2] = np.nan
    df = from_numpy(spark, x).repartition(3)
    asked = df.where("id % 50 = 0 OR id = 701").withColumnRenamed("id", "qid")
    assert rows_of(exact.knn_join_blocks(asked, df, kind, 4)) == rows_of(exact.knn_join(asked, df, kind, 4))


def test_a_task_holds_few_queries(spark, monkeypatch):
    """However many queries there are, a task has HELD of them, whose best rows lie in arrays."""
    monkeypatch.setattr(exact, "HELD", 50)
    df = vectors(spark, 1000, 8, False)
    pairs, shares = exact.dealt(df.withColumnRenamed("id", "qid"), df, lambda x: x.groupBy(F.spark_partition_id().alias("no")).count(), lambda x: x.limit(1))
    most, all_of_them = pairs.agg(F.max("q_count"), F.sum("q_count")).first()
    assert shares == 1 and most <= 60 and all_of_them == 1000
    best = Best(1000, 10, np.int64)
    assert best.value.nbytes + best.ids.nbytes + best.more.nbytes == 1000 * 10 * 24


def test_recall_report_joins_once(spark):
    """Its plan has each of both joins of blocks once."""
    from nearfield import queries

    assert plan_of(queries.QUERIES["recall_report"](spark, "/root/testdata/sf0.001")).count("CartesianProduct") == 2


@pytest.mark.parametrize("heavy", [0, 7, 512])
def test_wide_blocks_with_frequent_indices(monkeypatch, heavy):
    """Indices that many rows have are multiplied, others counted; together they are all."""
    monkeypatch.setattr(SparseScan, "HEAVY", heavy)
    r = np.random.default_rng(9)
    sets = [sorted({int(v) for v in r.zipf(1.3, 60) if v < 100_000}) for _ in range(300)]
    block = lambda of: SparseBlock(np.full(len(of), 1 << 30, np.int32), np.array([len(x) for x in of], np.int32), np.array([v for x in of for v in x], np.int32))
    asked, scan = block(sets[:40]), SparseScan(Similarity.JACCARD, block(sets), 4096)
    assert scan.bits is None and len(scan.heavy) <= heavy
    want = np.array([[len({*x} & {*y}) for y in sets] for x in sets[:40]])
    assert (scan._common(asked) == want).all()
    scores = np.array([[len({*x} & {*y}) / max(1, len({*x} | {*y})) for y in sets] for x in sets[:40]])
    assert scan.near(asked, np.sort(scores, axis=1)[:, -5])[scores >= np.sort(scores, axis=1)[:, -5:-4]].all()
    which, some = np.divmod(np.arange(40 * 300), 300)
    assert scan.scores(asked, which, some) == pytest.approx(scores.ravel())
