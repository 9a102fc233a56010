"""Similarities against a slow restatement, their edge cases, and both ways of computing them against each other."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import similarity as s
from nearfield.operators.exact import exact_topk, explain_exact, knn_join, knn_join_blocks, top, with_score, within
from nearfield.sources.readers import from_numpy, from_vectors
from nearfield.vectors import DenseFloat, Similarity, SparseBool

DENSE, SPARSE = ("l1", "l2", "cosine"), ("jaccard", "hamming")


def slow_dense(kind, a, b):
    if kind == "l1":
        return 1 / (1 + sum(abs(x - y) for x, y in zip(a, b)))
    if kind == "l2":
        return 1 / (1 + math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))))
    sizes = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))
    return 1 + sum(x * y for x, y in zip(a, b)) / sizes if sizes else 2.0 if list(a) == list(b) else 0.0


def slow_sparse(kind, a, b, n):
    if kind == "jaccard":
        return len(a & b) / len(a | b) if a | b else 1.0
    return sum((i in a) == (i in b) for i in range(n)) / n


@pytest.mark.parametrize("kind", DENSE)
def test_dense_against_slow(spark, kind):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        n = int(r.integers(1, 300))
        rows.append((r.standard_normal(n).astype(np.float32).tolist(), r.standard_normal(n).astype(np.float32).tolist()))
    rows += [([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), ([], [])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [x[0] for x in df.select(s.similarity(kind, F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([slow_dense(kind, a, b) for a, b in rows], rel=1e-6)


@pytest.mark.parametrize("kind", SPARSE)
def test_sparse_against_slow(spark, kind):
    r = random.Random(2)
    rows = []
    for _ in range(80):
        n = r.randint(10, 400)
        rows.append((set(r.sample(range(n), r.randint(0, n // 3))), set(r.sample(range(n), r.randint(0, n // 3))), n))
    rows += [(set(), set(), 10), (set(), {1}, 10), ({1, 2}, {1, 2}, 10)]
    shuffled = lambda x: r.sample(sorted(x), len(x))
    df = spark.createDataFrame([((shuffled(a), n), (sorted(b), n)) for a, b, n in rows], "a struct<true_indices:array<int>,total_indices:int>, b struct<true_indices:array<int>,total_indices:int>")
    got = [x[0] for x in df.select(s.similarity(kind, F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([slow_sparse(kind, a, b, n) for a, b, n in rows])


@given(st.lists(st.tuples(st.floats(-9, 9, width=32), st.floats(-9, 9, width=32)), min_size=1, max_size=40), st.sampled_from(DENSE))
@settings(max_examples=150, deadline=None)
def test_numpy_forms_against_slow(pairs, kind):
    a, b = zip(*pairs)
    kind_ = Similarity.of(kind)
    want = slow_dense(kind, a, b)
    assert float(s.row_scores(kind_, a, np.array([b]))[0]) == pytest.approx(want, rel=1e-5, abs=1e-5)
    assert float(s.block_scores(kind_, np.array([a]), np.array([b]))[0, 0]) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_scores_are_within_their_bounds():
    r = np.random.default_rng(3)
    v = r.standard_normal((50, 20)).astype(np.float32)
    for kind in DENSE:
        k = Similarity.of(kind)
        scores = s.block_scores(k, v, v)
        assert (scores >= -1e-9).all() and (scores <= k.max_score + 1e-6).all()
        assert np.diag(scores) == pytest.approx(k.max_score, abs=1e-3)


def test_unit_and_unsorted_literals(spark):
    assert DenseFloat((3, 4)).unit() == DenseFloat((0.6, 0.8)) and DenseFloat((0, 0)).unit() == DenseFloat((0, 0))
    assert SparseBool((5, 1, 1), 9).true_indices == (1, 5)
    df = from_vectors(spark, [DenseFloat((3, 4)), DenseFloat((0, 0))])
    assert [r[0] for r in df.orderBy("id").select(s.unit(F.col("vec"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


@pytest.mark.parametrize("kind", DENSE + SPARSE)
def test_joins_agree_with_brute_force(spark, kind):
    r = np.random.default_rng(4)
    x = r.standard_normal((120, 16)).astype(np.float32)
    x[7] = x[3]  # a tie
    if kind in SPARSE:
        x = x > 0.4
    corpus, queries = from_numpy(spark, x), from_numpy(spark, x[:25]).withColumnRenamed("id", "qid")
    as_set = lambda v: set(np.flatnonzero(v).tolist())
    score = (lambda a, b: slow_sparse(kind, as_set(a), as_set(b), 16)) if kind in SPARSE else (lambda a, b: slow_dense(kind, a.astype(float), b.astype(float)))
    for join in (knn_join, knn_join_blocks):
        got = {(g["qid"], g["rank"]): (g["id"], g["score"]) for g in join(queries, corpus, kind, 6).collect()}
        assert len(got) == 25 * 6
        for q in range(25):
            best = sorted(((-round(score(x[q], x[i]), 6), i) for i in range(120)))[:6]
            assert [got[q, n + 1][1] for n in range(6)] == pytest.approx([-b for b, _ in best], abs=1e-5)
            if kind in SPARSE:
                assert [got[q, n + 1][0] for n in range(6)] == [i for _, i in best]


def test_missing_vectors_and_few_rows(spark):
    df = from_vectors(spark, [DenseFloat((float(i), 1.0)) for i in range(5)]).withColumn("vec", F.when(F.col("id") != 2, F.col("vec")))
    assert [r["id"] for r in exact_topk(df, DenseFloat((1, 1)), "l2", 10).collect()] == [1, 0, 3, 4]
    assert exact_topk(df, DenseFloat((1, 1)), "l2", 0).count() == 0
    queries = df.withColumnRenamed("id", "qid")
    for join in (knn_join, knn_join_blocks):
        assert join(queries, df, "l2", 10).count() == 16
        assert join(queries.limit(0), df, "l2", 10).count() == 0
    assert {r["id"] for r in within(df, DenseFloat((1, 1)), "l2", 0.5).collect()} == {0, 1}


def test_plans_stay_narrow(spark):
    """The top rows meet by a take, a join's queries are broadcast, and rank is cut before the shuffle."""
    df = from_numpy(spark, np.eye(8, dtype=np.float32)).withColumn("other", F.lit("x"))
    plan = exact_topk(df, DenseFloat((1,) * 8), "cosine", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    join = knn_join(df.select(F.col("id").alias("qid"), "vec"), df, "l2", 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in join and "WindowGroupLimit" in join


def test_explanations_and_projection(spark):
    df = from_numpy(spark, np.eye(3, dtype=np.float32)).withColumn("name", F.lit("n"))
    got = explain_exact(exact_topk(df, DenseFloat((1, 0, 0)), "l2", 1, fetch=("name",))).first()
    assert got["id"] == 0 and got["name"] == "n" and got["score"] == 1 and "Exact" in got["explanation"]
    assert exact_topk(df, DenseFloat((1, 0, 0)), "l2", 1, fetch=None).columns == ["id", "score", "vec", "name"]
    assert top(with_score(df, DenseFloat((1, 0, 0)), "l1"), 2).count() == 2
