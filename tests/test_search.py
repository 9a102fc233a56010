"""Counting, candidates, filtered and rescored search, the index and its changes, streams, SQL and the facade."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearfield import mapping as m
from nearfield import query as q
from nearfield import sql
from nearfield.errors import NotFound, VectorError
from nearfield.facade import NearestNeighbors
from nearfield.functions.hashing import model_of
from nearfield.functions.similarity import literal, similarity
from nearfield.operators import approximate as a
from nearfield.operators import scoring, transform
from nearfield.operators.exact import exact_topk
from nearfield.plans.planner import plan, search
from nearfield.sources.index import VectorIndex
from nearfield.sources.readers import from_csr, from_numpy, read_documents, read_fixed_width, to_numpy
from nearfield.streaming.ingest import apply_changes, ingest
from nearfield.vectors import DenseFloat, Empty, Indexed, Similarity, SparseBool


def postings(spark, docs):
    """docs: {id: [hash, ...]}; a repeated hash is its frequency."""
    rows = [(i, 0, [x], f.count(x)) for i, f in docs.items() for x in sorted(set(f))]
    return spark.createDataFrame(rows, "id long, tbl int, hash array<int>, freq int")


def counts(spark, docs, asked):
    terms = a.term_table(spark, [(0, (x,), f) for x, f in asked])
    return {r["id"]: r["hits"] for r in a.hit_counts(postings(spark, docs), terms).collect()}


def test_hit_counts(spark):
    assert counts(spark, {0: [42], 1: [99], 2: [42, 99]}, [(42, 1), (99, 1)]) == {0: 1, 1: 1, 2: 2}
    # Each occurrence in the query counts, and those without a hit are out.
    assert counts(spark, {0: [3, 8, 7], 1: [9, 6, 1]}, [(3, 1), (3, 1), (8, 1), (6, 1)]) == {0: 3, 1: 1}
    assert counts(spark, {0: [1, 2]}, [(7, 1)]) == {}
    # Of frequencies the smaller counts, where presence alone would give 2 and 2.
    docs = {0: [1, 1, 1, 2], 1: [1, 2, 2]}
    assert counts(spark, docs, [(1, 3), (2, 1)]) == {0: 4, 1: 2}
    terms = a.term_table(spark, [(0, (1,), 3), (0, (2,), 1)])
    assert {r["id"]: r["hits"] for r in a.presence_counts(postings(spark, docs), terms).collect()} == {0: 2, 1: 2}


def test_candidates_against_brute_force(spark):
    r = random.Random(7)
    hits = {i: r.randint(1, 6) for i in r.sample(range(1000), 300)}
    df = spark.createDataFrame(list(hits.items()), "id long, hits long")
    best = sorted(hits, key=lambda i: (-hits[i], i))
    for n in (0, 1, 50, 1000):
        assert [x["id"] for x in a.candidates(df, n).collect()] == best[:n]
    by = {x["id"] for x in a.candidates(df, 7, F.col("id") % 3).collect()}
    assert by == {i for s in range(3) for i in [j for j in best if j % 3 == s][:7]}
    assert {x["segment"] for x in df.select(a.segment_of(F.col("id"), 4).alias("segment")).collect()} == {0, 1, 2, 3}


@pytest.fixture(scope="module")
def corpus(spark):
    x = np.random.default_rng(8).standard_normal((1000, 10)).astype(np.float32)
    return x, from_numpy(spark, x).withColumn("color", F.when(F.col("id") < 100, "blue").otherwise("green")).persist()


@pytest.mark.parametrize("mapping, kind", [(m.L2Lsh(10, 40, 1, 2), "l2"), (m.CosineLsh(10, 40, 1), "cosine")])
def test_function_scores_of_filtered_rows(spark, corpus, mapping, kind):
    x, df = corpus
    asked, model = DenseFloat(tuple(x[3])), model_of(mapping)
    blue = df.where("color = 'blue'")
    scored = scoring.hashed_function_score(blue, a.postings_of(df, model), asked, model, kind)
    rows = scoring.function_score(scored, 1.0, "replace").collect()
    assert len(rows) == 100 and {r["id"] for r in rows} == set(range(100))
    top = max(rows, key=lambda r: r["score"])
    assert top["id"] == 3 and top["score"] == pytest.approx(Similarity.of(kind).max_score)
    summed = scoring.function_score(scoring.exact_function_score(blue, asked, kind, weight=3.0), F.lit(0.25), "sum").collect()
    want = {r["id"]: 0.25 + 3 * r["score"] for r in exact_topk(blue, asked, kind, 100).collect()}
    assert {r["id"]: r["score"] for r in summed} == pytest.approx(want)


@pytest.mark.parametrize("mode, want", [("multiply", 6), ("replace", 3), ("sum", 5), ("avg", 2.5), ("max", 3), ("min", 2)])
def test_boost_modes(spark, mode, want):
    df = spark.createDataFrame([(2.0, 3.0)], "base double, knn_score double")
    assert scoring.function_score(df, F.col("base"), mode).first()["score"] == want
    assert scoring.function_score(df, F.col("base"), mode, min_score=want + 1).count() == 0


def test_function_score_errors(spark, corpus):
    _, df = corpus
    with pytest.raises(VectorError, match="does not support indexed vectors"):
        scoring.exact_function_score(df, Indexed("i", "1", "vec"), "l2")
    with pytest.raises(VectorError, match="boost_mode"):
        scoring.combined(F.lit(1), F.lit(1), "product")
    holes = df.withColumn("vec", F.when(F.col("id") != 4, F.col("vec")))
    asked = DenseFloat((0,) * 10)
    with pytest.raises(PySparkException, match="no vector"):
        scoring.exact_function_score(holes, asked, "l2").collect()
    skipped = scoring.exact_function_score(holes, asked, "l2", missing="skip")
    assert skipped.where("knn_score IS NULL").count() == 1
    assert scoring.exact_function_score(scoring.exists(holes), asked, "l2").count() == 999


def test_rescoring(spark, corpus):
    x, df = corpus
    blue = df.withColumn("base", F.when(F.col("color") == "blue", 1.0).otherwise(0.0))
    knn = similarity("l2", literal(DenseFloat(tuple(x[500]))), F.col("vec"))
    for weight in (0.0, 1.0):
        got = scoring.rescore(blue, "base", knn, 100, 1.0, weight).collect()
        assert {r["id"] for r in got} == set(range(100))
        assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert [r["id"] for r in scoring.rescore(blue, "base", knn, 5, 1.0, 0.0).collect()] == [0, 1, 2, 3, 4]


def test_keyword_scores(spark):
    df = spark.createDataFrame([(1, "A red shoe", "red, RED"), (2, "blue", "shoe"), (3, None, None)], "id int, title string, body string")
    got = {r[0]: r[1] for r in df.select("id", scoring.multi_match({"title": 3.0, "body": 1.0}, ["Red", "shoe"])).collect()}
    assert got == {1: 6.0, 2: 1.0, 3: 0.0}
    assert df.where(scoring.any_word(["title", "body"], ["blue"])).count() == 1
    assert df.withColumn("r", scoring.random_score(1)).where("r >= 0 AND r < 1").count() == 3


def test_validation(spark):
    df = from_numpy(spark, np.ones((4, 10), np.float32)).withColumn("vec", F.when(F.col("id") == 2, F.slice("vec", 1, 9)).otherwise(F.col("vec")))
    with pytest.raises(PySparkException, match="Expected dimension 10 but got 9"):
        transform.validated(df, "vec", m.DenseFloatMapping(10)).collect()
    good, bad = transform.quarantined(df, "vec", m.DenseFloatMapping(10))
    assert (good.count(), bad.count()) == (3, 1)
    sparse = from_numpy(spark, np.eye(3, dtype=bool)).withColumn("vec", F.struct(F.array(F.lit(5)).alias("true_indices"), F.lit(3).alias("total_indices")))
    assert transform.quarantined(sparse, "vec", m.SparseBoolMapping(3))[1].count() == 3


def test_dimensions_with_the_largest_sums(spark):
    x = np.random.default_rng(9).random((50, 12)).astype(np.float32)
    df = from_numpy(spark, x)
    at = transform.largest_columns(df, "vec", 4)
    assert at == np.argsort(-x.astype(float).sum(axis=0), kind="stable")[:4].tolist()
    assert to_numpy(transform.reduce_dims(df, "vec", at)) == pytest.approx(x[:, at])


@pytest.fixture
def index(spark, corpus, tmp_path):
    return VectorIndex.create(corpus[1], str(tmp_path / "index"), {"vec": m.L2Lsh(10, 50, 1, 2)})


def test_search_delete_and_insert_again(spark, corpus, index):
    """Five rounds: what is deleted goes, the next move up, and what comes back is found again."""
    x, df = corpus
    for round_ in range(3):
        ask = q.L2LshQuery("vec", 1000, 1, DenseFloat(tuple(x[round_])))
        before = [r["id"] for r in search(ask, index, 42).collect()]
        assert before[0] == round_
        gone = before[:5]
        index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        after = [r["id"] for r in search(ask, index, 42).collect()]
        assert after[:37] == before[5:] and index.rows().count() == 995
        assert index.postings("vec").select("id").distinct().count() == 995
        index.upsert(df.where(F.col("id").isin(gone)))
        assert [r["id"] for r in search(ask, index, 42).collect()] == before
        if round_ == 1:
            index.compact()
            index.drop_unused()
    assert index.rows().count() == 1000


def scans(spark, run):
    """The rows that Parquet scans gave while run() ran."""
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return {e.executionId() for e in listed(store.executionsList())}

    before = executions()
    run()
    total = 0
    for e in executions() - before:
        values = listed(store.executionMetrics(e))
        for node in listed(store.planGraph(e).allNodes()):
            if node.name().startswith("Scan parquet"):
                rows = [m for m in listed(node.metrics()) if m.name() == "number of output rows"]
                total += sum(int((values.get(m.accumulatorId()) or "0").replace(",", "")) for m in rows)
    return total


def test_searches_read_little(spark, tmp_path):
    """With 100 tables, a search reads under 5 % of the rows and of the postings, and finds what a scan finds."""
    r = np.random.default_rng(12)
    n, dims = 100_000, 16
    x = (r.standard_normal((200, dims))[r.integers(0, 200, n)] + 0.1 * r.standard_normal((n, dims))).astype(np.float32)
    df, mapping = from_numpy(spark, x), m.L2Lsh(dims, 100, 4, 1)
    index = VectorIndex.create(df, str(tmp_path / "large"), {"vec": mapping})
    postings = index.postings("vec").count()
    assert postings == 100 * n
    ask = q.L2LshQuery("vec", 50, 0, DenseFloat(tuple(x[777])))
    found = []
    read = scans(spark, lambda: found.extend(search(ask, index, 10).collect()))
    assert 0 < read < 0.05 * (n + postings), read
    terms = model_of(mapping).hash_literal(ask.vec)
    rows = scans(spark, lambda: index.rows_of([r["id"] for r in found]).collect())
    assert 10 <= rows < 0.05 * n
    assert scans(spark, lambda: index.get(4321, "vec")) < 0.01 * n
    lists = scans(spark, lambda: index.postings("vec", terms).collect())
    assert lists < 0.05 * postings
    plain = a.approximate_topk(df, a.postings_of(df, model_of(mapping)), ask.vec, model_of(mapping), "l2", 50, 10).collect()
    assert [tuple(x) for x in found] == [(x["id"], x["score"], x["hits"]) for x in plain]


def test_keys_of_terms(spark):
    from nearfield.sources.index import key_of, term_key

    terms = [(0, (1,), 1), (3, (-5, 2**31 - 1, 0), 2), (-1, (2038074743,), 1), (7, (-(2**31),), 1)]
    df = spark.createDataFrame([(t, list(h)) for t, h, _ in terms], "tbl int, hash array<int>")
    assert [r[0] for r in df.select(term_key(F.col("tbl"), F.col("hash"))).collect()] == [key_of(t) for t in terms]


def test_lookups_of_many_and_of_no_ids(spark, corpus, index):
    x, df = corpus
    index.upsert(df.where("id % 10 = 3").withColumn("vec", F.transform("vec", lambda v: -v)))
    index.delete(df.where("id % 10 = 4").select("id"))
    ids = [*range(0, 1000, 7), 5000, -1]
    got = {r["id"]: r["vec"] for r in index.rows_of(ids).collect()}
    assert got == {r["id"]: r["vec"] for r in index.rows().where(F.col("id").isin(ids)).collect()} and len(got) > 100
    assert index.rows_of([]).count() == index.postings("vec", []).count() == 0
    named = VectorIndex.create(df.withColumn("id", F.concat(F.lit("n\u00e9"), F.col("id"))), index.path + "-named", {"vec": m.DenseFloatMapping(10)})
    assert list(named.get("n\u00e9512", "vec").values) == x[512].tolist() and {r["id"] for r in named.rows_of(["n\u00e91", "n\u00e999", "z"]).collect()} == {"n\u00e91", "n\u00e999"}


def test_changes_are_safe(spark, corpus, index, tmp_path):
    """Nothing is lost by a failed replacement, by another writer, by repeated ids, or by vectors inside structs."""
    x, df = corpus
    wrong = df.withColumn("vec", F.slice("vec", 1, 9))
    with pytest.raises(PySparkException, match="Expected dimension 10 but got 9"):
        VectorIndex.create(wrong, index.path, {"vec": m.DenseFloatMapping(10)}, replace=True)
    assert VectorIndex(spark, index.path).rows().count() == 1000
    before = sorted(index._files.names())
    with pytest.raises(VectorError, match="Expected distinct ids"):
        index.upsert(df.where("id < 3").unionByName(df.where("id = 2")))
    with pytest.raises(VectorError, match="Expected distinct ids"):
        index.upsert(df.where("id < 3").withColumn("id", F.lit(None).cast("long")))
    assert sorted(index._files.names()) == before
    other, number = VectorIndex(spark, index.path), index._number()
    index._number = lambda: number
    other.delete(df.where("id = 1").select("id"))
    with pytest.raises(VectorError, match="changed by another writer"):
        index.delete(df.where("id = 2").select("id"))
    del index._number
    assert index.rows().count() == 999
    VectorIndex.create(df.where("id < 10"), index.path, {"vec": m.DenseFloatMapping(10)}, replace=True)
    assert index.rows().count() == 10
    index.drop_unused()
    assert index.rows().count() == 10 and len(index._files.names()) == 2
    nested = df.select("id", F.struct(F.struct("vec").alias("bar")).alias("foo"))
    with pytest.raises(PySparkException, match="Expected dimension 11 but got 10"):
        VectorIndex.create(nested, str(tmp_path / "nested"), {"foo.bar.vec": m.L2Lsh(11, 5, 1, 2)})
    inside = VectorIndex.create(nested, str(tmp_path / "nested"), {"foo.bar.vec": m.L2Lsh(10, 50, 1, 2)})
    got = search(q.L2LshQuery("foo.bar.vec", 100, 0, Indexed(inside.path, 9, "foo.bar.vec")), inside, 1).first()
    assert (got["id"], got["score"]) == (9, 1.0)


def test_results_are_the_same_in_every_run(corpus, index):
    x, _ = corpus
    ask = q.L2LshQuery("vec", 30, 0, DenseFloat(tuple(x[77])))
    runs = [[tuple(r) for r in search(ask, index, 42).collect()] for _ in range(3)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 30


def test_plans_and_errors(spark, corpus, index):
    x, _ = corpus
    v = DenseFloat(tuple(x[0]))
    assert plan(q.Exact("vec", Similarity.L2, v), index).strategy == "exact"
    assert plan(q.L2LshQuery("vec", 9, 0, v), index).strategy == "approximate"
    text = plan(q.L2LshQuery("vec", 9, 2, v), index).explained(1).first()["explanation"]
    assert text.startswith("Share [") and "of [150] hashes" in text
    for bad in (q.CosineLshQuery("vec", 9, v), q.Exact("vec", Similarity.JACCARD, v), q.Exact("vec", Similarity.L2, Empty()), q.JaccardLshQuery("vec", 9, SparseBool((1,), 10))):
        with pytest.raises(VectorError, match="is not compatible with mapping"):
            plan(bad, index)
    with pytest.raises(VectorError, match="Expected dimension 10 but got 3"):
        plan(q.Exact("vec", Similarity.L2, DenseFloat((1, 2, 3))), index)
    with pytest.raises(VectorError, match=r"Could not find mapped field type for field \[nope\]"):
        plan(q.Exact("nope", Similarity.L2, v), index)
    with pytest.raises(VectorError, match="to be a vector field"):
        plan(q.Exact("color", Similarity.L2, v), index)
    with pytest.raises(NotFound):
        VectorIndex(spark, index.path + "-none")
    with pytest.raises(VectorError, match="exists"):
        VectorIndex.create(corpus[1], index.path, {})


def test_pointers(index):
    ask = lambda i, field="vec": q.Exact("vec", Similarity.L2, Indexed(index.path, i, field))
    assert [r["id"] for r in search(ask(42), index, 1).collect()] == [42]
    with pytest.raises(NotFound, match=r"with id \[5000\] in index \[.*\] not found"):
        search(ask(5000), index)
    with pytest.raises(NotFound, match=r"exists, but does not have field \[other\]"):
        search(ask(1, "other"), index)
    with pytest.raises(NotFound, match=r"the field \[color\] has an unexpected type"):
        search(ask(1, "color"), index)


def test_filters_and_fetched_columns(corpus, index):
    x, _ = corpus
    ask = q.Exact("vec", Similarity.L2, DenseFloat(tuple(x[500])))
    got = search(ask, index, 10, fetch=("color",), where=F.col("color") == "blue").collect()
    assert len(got) == 10 and {r["color"] for r in got} == {"blue"}


def test_many_fields_nested_fields_and_missing_vectors(spark, tmp_path):
    x = np.random.default_rng(10).standard_normal((100, 10)).astype(np.float32)
    df = from_numpy(spark, x).withColumn("bits", transform.positive_positions(F.col("vec"))).withColumn("foo", F.struct(F.struct("vec").alias("bar")))
    df = df.withColumn("cos", F.when(F.col("id") % 2 == 0, F.col("vec")))
    fields = {"vec": m.DenseFloatMapping(10), "bits": m.JaccardLsh(10, 20, 1), "cos": m.CosineLsh(10, 9, 1), "foo.bar.vec": m.DenseFloatMapping(10)}
    index = VectorIndex.create(df, str(tmp_path / "fields"), fields)
    v0, b0 = DenseFloat(tuple(x[0])), SparseBool(tuple(np.flatnonzero(x[0] > 0)), 10)
    for ask in (q.Exact("vec", Similarity.L1, v0), q.Exact("foo.bar.vec", Similarity.L2, v0), q.CosineLshQuery("cos", 13, v0), q.JaccardLshQuery("bits", 50, b0), q.Exact("bits", Similarity.HAMMING, b0)):
        first = search(ask, index, 10).first()
        assert first["score"] == pytest.approx(ask.similarity.max_score)
    assert index.rows().where("cos IS NOT NULL").count() == 50
    assert index.postings("cos").select("id").distinct().count() == 50
    assert m.get_mapping(index.rows(), "bits") == fields["bits"]
    with pytest.raises(VectorError, match="Could not find"):
        m.get_mapping(index.rows(), "zip")
    assert index.largest_terms("cos", 3).count() == 3


def test_replayed_batches_change_nothing(spark, corpus, index):
    more = corpus[1].where("id < 3").withColumn("id", F.col("id") + 5000)
    for _ in range(2):
        apply_changes(index, more, 0, "s")
    assert index.rows().count() == 1003 and index.postings("vec").where("id >= 5000").count() == 150
    changes = more.withColumn("gone", F.col("id") == 5001).withColumn("at", F.lit(1))
    apply_changes(index, changes, 1, "s", "at", "gone")
    assert index.rows().count() == 1002


def test_stream(spark, corpus, index, tmp_path):
    source = tmp_path / "in"
    for n in range(3):
        corpus[1].where(F.col("id") % 100 == n).withColumn("id", F.col("id") + 10_000).coalesce(1).write.parquet(str(source / f"part={n}"))
    changes = spark.readStream.schema(corpus[1].schema).option("maxFilesPerTrigger", 1).parquet(str(source) + "/part=*")
    writer = ingest(changes, index, compact_every=2).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)
    running = writer.start()
    running.awaitTermination(120)
    assert index.rows().where("id >= 10000").count() == 30 and index.rows().count() == 1030


def test_sql_search_of_many_rows(spark, corpus):
    """However large k is, no task gets the whole table."""
    x, df = corpus
    df.createOrReplaceTempView("sql_many")
    sql.register(spark)
    sql.register_search(spark, "near_l2", "sql_many", "l2")
    asked = "array(" + ", ".join(f"CAST({float(v)!r} AS FLOAT)" for v in x[9]) + ")"
    got = spark.sql(f"SELECT id, rank FROM near_l2({asked}, 700)")
    assert {(r["id"], r["rank"]) for r in got.collect()} == {(r["id"], n + 1) for n, r in enumerate(exact_topk(df, DenseFloat(tuple(x[9])), "l2", 700).collect())}
    plan = spark.sql(f"SELECT id, rank FROM near_l2({asked}, 5000)")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(_w0") > plan.index("place#") > plan.index("SinglePartition")


def test_sql(spark, corpus):
    x, df = corpus
    df.createOrReplaceTempView("sql_corpus")
    sql.register(spark)
    sql.register_search(spark, "near_l1", "sql_corpus", "l1")
    asked = "array(" + ", ".join(f"CAST({float(v)!r} AS FLOAT)" for v in x[9]) + ")"
    got = [(r["id"], r["rank"]) for r in spark.sql(f"SELECT * FROM near_l1({asked}, 5) ORDER BY rank").collect()]
    assert got == [(r["id"], n + 1) for n, r in enumerate(exact_topk(df, DenseFloat(tuple(x[9])), "l1", 5).collect())]
    for kind in ("l1", "l2", "cosine"):
        both = df.select(F.expr(f"vec_{kind}(vec, {asked})").alias("a"), similarity(kind, F.col("vec"), literal(DenseFloat(tuple(x[9])))).alias("b"))
        assert both.where("abs(a - b) > 1e-12").count() == 0
    bits = df.select(transform.positive_positions(F.col("vec")).alias("v"))
    for kind in ("jaccard", "hamming"):
        assert bits.where(F.expr(f"vec_{kind}(v, v)") != 1).count() == 0


@pytest.mark.parametrize("algorithm, metric, params, at_least", [
    ("exact", "euclidean", {}, 1), ("exact", "L1", {}, 1), ("exact", "angular", {}, 1), ("exact", "jaccard", {}, 1), ("exact", "hamming", {}, 1),
    ("lsh", "l2", {"L": 40, "k": 1, "w": 2}, 0.9), ("lsh", "cosine", {"L": 60, "k": 2}, 0.9), ("lsh", "jaccard", {"L": 60, "k": 1}, 0.8), ("lsh", "hamming", {"L": 12, "k": 1}, 0.8),
    ("permutation_lsh", "cosine", {"k": 8, "repeating": False}, 0.5), ("permutation_lsh", "l2", {"k": 8, "repeating": True}, 0.4),
])
def test_facade(spark, algorithm, metric, params, at_least):
    """Recall by score against brute force."""
    r = np.random.default_rng(11)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x = x > 0.3 if metric in ("jaccard", "hamming") else x
    nn = NearestNeighbors(spark, algorithm, metric, params, {"candidates": 200} | ({"probes": 1} if metric == "l2" and algorithm == "lsh" else {})).fit(x, shards=2)
    inds, sims = nn.kneighbors(x[:20], 10, return_similarity=True)
    assert inds.shape == sims.shape == (20, 10) and (inds[:, 0] >= 0).all()
    from nearfield.functions.similarity import block_scores

    full = block_scores(Similarity.of(metric), x[:20].astype(np.float32), x.astype(np.float32))
    worst = np.sort(full, axis=1)[:, -10]
    assert ((sims >= worst[:, None] - 1e-6).sum() / 200) >= at_least
    nn.set_query_params({"candidates": 1})
    if algorithm != "exact":
        found = nn.kneighbors(x[:3], 4)
        assert (found[:, 0] >= 0).all() and (found[:, 1:] == -1).all()


def test_facade_errors_and_inputs(spark):
    for pair in (("exact", "nope"), ("lsh", "l1"), ("nope", "l2")):
        with pytest.raises(VectorError, match="there are"):
            NearestNeighbors(spark, *pair)
    with pytest.raises(VectorError, match="fit"):
        NearestNeighbors(spark, "exact", "l2").kneighbors(np.eye(2), 1)
    with pytest.raises(TypeError):
        NearestNeighbors(spark, "exact", "l2").fit(3)
    vectors = [SparseBool((0, 1), 4), SparseBool((2,), 4)]
    assert NearestNeighbors(spark, "exact", "jaccard").fit(vectors).kneighbors(vectors, 1).tolist() == [[0], [1]]

    class Csr:
        indptr, indices, shape = [0, 2, 2, 3], [1, 0, 3], (3, 4)

    assert [r["vec"]["true_indices"] for r in from_csr(spark, Csr()).orderBy("id").collect()] == [[0, 1], [], [3]]


def test_readers(spark, tmp_path):
    import gzip
    import json
    import struct

    with open(tmp_path / "v.bin", "wb") as f:
        for n in range(5):
            f.write(f"id{n:08d}".encode() + struct.pack("<3f", n, n + 1, n + 2))
        f.write(b"broken")
    want = [(f"id{n:08d}", [n, n + 1, n + 2]) for n in range(5)]
    got = read_fixed_width(spark, str(tmp_path / "v.bin"), 3).orderBy("id").collect()
    assert [(r["id"], r["vec"]) for r in got] == want
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "empty.bin").write_bytes(b"")
    (tmp_path / "many" / "v 1.bin").write_bytes(b"".join(f"x{n:09d}".encode() + struct.pack("<3f", n, 0, 1) for n in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    split = read_fixed_width(spark, str(tmp_path / "many"), 3)
    assert split.rdd.getNumPartitions() > 1 and split.count() == 50_000
    assert [(r["id"], r["vec"][0]) for r in split.orderBy("id").limit(2).collect()] == [("x000000000", 0), ("x000000001", 1)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "many" / "x,y.bin").write_bytes(b"comma-1234" + struct.pack("<3f", 0, 0, 1))
    (tmp_path / "v.bin").rename(tmp_path / "many" / "broken.bin")
    assert read_fixed_width(spark, str(tmp_path / "many"), 3).count() == 50_006
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        for d in ({"id": 1, "v": [1, 2], "b": [[1, 0], 4]}, {"id": 2, "v": {"values": [3, 4]}, "b": {"true_indices": [2], "total_indices": 4, "x": 1}}, {"id": 3}):
            f.write(json.dumps(d) + "\n")
    rows = read_documents(spark, str(tmp_path / "d.json.gz"), {"v": m.DenseFloatMapping(2), "b": m.SparseBoolMapping(4)}, "id long").orderBy("id").collect()
    assert [r["v"] for r in rows] == [[1, 2], [3, 4], None]
    assert [r["b"] and (r["b"]["true_indices"], r["b"]["total_indices"]) for r in rows] == [([1, 0], 4), ([2], 4), None]
