"""Registered queries: each gives the rows of its SQL, and recall is near what the models are known to reach."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from nearfield import queries
from nearfield.functions.hashing import model_of
from nearfield.functions.similarity import block_scores
from nearfield.mapping import CosineLsh, HammingLsh, JaccardLsh, L2Lsh, PermutationLsh
from nearfield.operators import approximate as a
from nearfield.operators import blocks
from nearfield.operators import exact as knn_module
from nearfield.operators.exact import knn_join, knn_join_blocks
from nearfield.sources.readers import from_numpy

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("embeddings", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(r)) for r in got.collect())
    assert rows
    if name in queries.ORACLE_SQL:
        columns = ", ".join(f'"{c}"' for c in got.columns)
        assert rows == sorted(map(repr, con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("mapping, candidates, probes, kind, want", [
    (JaccardLsh(256, 200, 1), 80, 0, "jaccard", 0.69),
    (HammingLsh(256, 128, 1), 40, 0, "hamming", 0.72),
    (CosineLsh(256, 400, 1), 80, 0, "cosine", 0.5),
    (L2Lsh(256, 300, 1, 4), 160, 2, "l2", 0.5),
    (PermutationLsh(256, 64, False), 80, 0, "cosine", 0.4),
])
def test_recall(spark, mapping, candidates, probes, kind, want):
    """A smaller draw of the corpus on which recall is known: 1000 rows, 256 dimensions, 20 neighbours."""
    r = np.random.default_rng(0)
    x = (r.random((1000, 256)) < 0.2) if mapping.sparse else r.standard_normal((1000, 256)).astype(np.float32)
    df, asked = from_numpy(spark, x), from_numpy(spark, x[:25]).withColumnRenamed("id", "qid")
    model = model_of(mapping)
    found = a.approximate_join(asked, df, a.postings_of(df, model), model, kind, 2 * candidates, 20, probes=probes).collect()
    full = block_scores(queries.Similarity.of(kind), x[:25].astype(np.float32), x.astype(np.float32))
    worst = np.sort(full, axis=1)[:, -20]
    recall = sum(f["score"] >= worst[f["qid"]] - 1e-6 for f in found) / 500
    assert recall > want - 0.15
    exact = knn_join_blocks(asked, df, kind, 20).collect()
    assert sum(f["score"] >= worst[f["qid"]] - 1e-6 for f in exact) >= 500


def test_documents_have_an_exact_join(spark):
    """The worst of five is as near as it gets: no word sets of other documents score more."""
    words = {r["id"]: set(r["vec"]["true_indices"]) for r in queries._word_sets(spark, SF).collect()}
    got = queries.QUERIES["doc_jaccard_neighbors"](spark, SF).collect()
    for qid in {r["qid"] for r in got}:
        best = sorted((len(words[qid] & w) / len(words[qid] | w) for w in words.values()), reverse=True)[:5]
        assert sorted((r["score"] for r in got if r["qid"] == qid), reverse=True) == pytest.approx(best, abs=2e-6)


def test_numbers_without_reuse_of_exchanges(spark):
    df = spark.range(200_000).selectExpr("concat('w', id * 7919 % 200003) AS w").repartition(5)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = queries.numbered(df, "w", 16).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [r["w"] for r in sorted(got, key=lambda r: r["i"])] == sorted(r["w"] for r in got) and sorted(r["i"] for r in got) == list(range(200_000))


def scored(rows):
    """Sums of doubles in another order differ in their last digits."""
    return sorted((r["qid"], r["rank"], r["id"], float(f"{r['score']:.12g}")) for r in rows)


@pytest.mark.parametrize("kind", ["l1", "l2", "cosine"])
def test_blocks_among_copies(spark, kind):
    """A large group of copies, and vectors that differ in the last digits: ids decide ties as with scores one by one."""
    r = np.random.default_rng(3)
    x = r.standard_normal((6000, 24)).astype(np.float32) * 100
    x[r.permutation(6000)[:3000]] = x[0]
    x[1::7] = np.nextafter(x[0], np.float32(np.inf))
    df = from_numpy(spark, x).repartition(5)
    asked = df.where("id % 600 < 3").withColumnRenamed("id", "qid")
    assert scored(knn_join_blocks(asked, df, kind, 10).collect()) == scored(knn_join(asked, df, kind, 10).collect())


@pytest.mark.parametrize("kind", ["jaccard", "hamming"])
@pytest.mark.parametrize("width", [300, 1 << 30])
def test_sparse_blocks(spark, kind, width):
    """Narrow ones as matrices, wide ones by equal indices; empty vectors and repeated indices too."""
    r = np.random.default_rng(4)
    sets = [r.choice(300, r.integers(0, 40), replace=False) * (width // 300) for _ in range(700)]
    stored = [(i, ([int(v) for v in np.sort(s)], width)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(stored, "id long, vec struct<true_indices: array<int>, total_indices: int>").repartition(3)
    asked = spark.createDataFrame([(i, ([*reversed(v[0]), *v[0][:2]], width)) for i, v in stored[:40]], "qid long, vec struct<true_indices: array<int>, total_indices: int>")
    assert scored(knn_join_blocks(asked, df, kind, 10).collect()) == scored(knn_join(asked, df, kind, 10).collect())


def test_blocks_of_more_queries_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(knn_module, "HELD", 100)
    df = from_numpy(spark, np.random.default_rng(5).standard_normal((900, 8)).astype(np.float32)).repartition(4)
    asked = df.withColumnRenamed("id", "qid")
    assert scored(knn_join_blocks(asked, df, "l2", 3).collect()) == scored(knn_join(asked, df, "l2", 3).collect())


@pytest.mark.parametrize("pairs", [1, 50, 1 << 22])
def test_common_indices_some_at_a_time(monkeypatch, pairs):
    monkeypatch.setattr(blocks, "PAIRS", pairs)
    r = np.random.default_rng(6)

    def block(n):
        rows = [np.sort(r.choice(200, r.integers(0, 30), replace=False)).astype(np.int32) * 1000 for _ in range(n)]
        return blocks.SparseBlock(np.full(n, 1 << 20, np.int32), np.array([len(x) for x in rows], np.int32), np.concatenate(rows)), [set(x.tolist()) for x in rows]

    (a, x), (b, y) = block(30), block(50)
    assert a.common(b).tolist() == [[len(p & q) for q in y] for p in x]
    same = blocks.SparseBlock.frombytes(a.tobytes(), 30)
    assert same.indices.tolist() == a.indices.tolist() and same.lengths.tolist() == a.lengths.tolist() and same.totals.tolist() == a.totals.tolist()
