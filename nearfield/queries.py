"""The registered queries over vectors, and the SQL that DuckDB runs for the same rows.

Hash parameters are written into the SQL as literals, so DuckDB hashes, counts, cuts and scores on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import model_of
from .functions.similarity import literal, similarity
from .mapping import CosineLsh, DenseFloatMapping, HammingLsh, JaccardLsh, L2Lsh, Mapping, PermutationLsh
from .operators import approximate as approx
from .operators import exact, scoring, transform
from .plans.planner import search
from .query import CosineLshQuery, Exact, HammingLshQuery, JaccardLshQuery, L2LshQuery, PermutationLshQuery, Query
from .sources.files import Files
from .sources.index import VectorIndex
from .sources.scratch import parts_for, scratch_path
from .vectors import DenseFloat, Indexed, Similarity, SparseBool

DIMS, K = 64, 10
#: The id of the row that single queries ask for, and what its vector is.
ASKED = 0

JACCARD, HAMMING = JaccardLsh(DIMS, 20, 2), HammingLsh(DIMS, 10, 6)
COSINE, L2 = CosineLsh(DIMS, 8, 4), L2Lsh(DIMS, 8, 2, 1)
L2_PROBED = L2Lsh(DIMS, 8, 1, 1)
PERMUTATION, REPEATING = PermutationLsh(DIMS, 12, False), PermutationLsh(DIMS, 12, True)
BASKET_DIMS, BASKETS = 1 << 30, JaccardLsh(1 << 30, 16, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label: the positions with a value over 0."""
    return _dense(spark, sf_dir).withColumn("vec", transform.positive_positions(F.col("vec")))


def _vector(df: DataFrame, id: int = ASKED):
    """The vector of one row, as a value."""
    v = df.where(F.col("id") == id).select("vec").first()[0]
    return DenseFloat(tuple(v)) if isinstance(v, list) else SparseBool(tuple(v["true_indices"]), v["total_indices"])


#: The indexes of this process, by application, table and mapping: one is written once, and read by all queries after that.
_INDEXES: dict[tuple, VectorIndex] = {}


def _index(spark: SparkSession, sf_dir: str, mapping: Mapping) -> VectorIndex:
    """The index of all of `embeddings`, with the field vec. A table that has other files by now has an index anew."""
    files = Files(spark, f"{sf_dir}/embeddings.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, files.state(), mapping)
    if key not in _INDEXES:
        rows = (_sparse if mapping.sparse else _dense)(spark, sf_dir)
        _INDEXES[key] = VectorIndex.create(rows, scratch_path(spark, "index"), {"vec": mapping})
    return _INDEXES[key]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Scores to 6 places, after all ordering."""
    for c in columns or ("score",):
        df = df.withColumn(c, F.round(c, 6))
    return df


# SQL that several queries share


_DOC = "SELECT vec_id AS id, embedding AS vec, label FROM embeddings"
_SPARSE_DOC = "SELECT vec_id AS id, list_filter(list_transform(range(0, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda i: i IS NOT NULL) AS vec, label FROM embeddings"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] * z[2])::DOUBLE))"


def _score(kind: str, a: str = "q.vec", b: str = "d.vec") -> str:
    common = f"len(list_intersect({a}, {b}))"
    return {
        "l1": f"1 / (1 + list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])::DOUBLE)))",
        "l2": f"1 / (1 + sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE))))",
        "cosine": f"(1 + {_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))",
        "jaccard": f"CASE WHEN len({a}) + len({b}) = 0 THEN 1 ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END",
        "hamming": f"({DIMS} - len({a}) - len({b}) + 2 * {common})::DOUBLE / {DIMS}",
    }[kind]


def _doc(kind: str) -> str:
    return _SPARSE_DOC if Similarity.of(kind).sparse else _DOC


def _scored_sql(kind: str, columns: str = "d.id", where: str = "true") -> str:
    """d and q, and every row's score."""
    return f"WITH d AS ({_doc(kind)}), q AS (SELECT vec FROM d WHERE id = {ASKED}), s AS (SELECT {columns}, {_score(kind)} AS score FROM d, q WHERE {where})"


def _top_sql(kind: str, k: int = K, where: str = "true", columns: str = "d.id", out: str = "id") -> str:
    return f"{_scored_sql(kind, columns, where)} SELECT {out}, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {k}"


# Exact search


def _exact_topk(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _sparse(spark, sf_dir) if Similarity.of(kind).sparse else _dense(spark, sf_dir)
        return _rounded(exact.exact_topk(df, _vector(df), kind, K))

    run.__name__ = f"exact_{kind}_topk"
    return query(_top_sql(kind))(run)


for _kind in ("l1", "l2", "cosine", "jaccard", "hamming"):
    _exact_topk(_kind)


def _join_sql(kind: str) -> str:
    return f"""WITH d AS ({_doc(kind)}), s AS (SELECT q.id AS qid, d.id AS id, {_score(kind)} AS score FROM d AS q, d),
r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s)
SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= {K}"""


def _knn_join(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _sparse(spark, sf_dir) if Similarity.of(kind).sparse else _dense(spark, sf_dir)
        return _rounded(exact.knn_join(df.withColumnRenamed("id", "qid"), df, kind, K))

    run.__name__ = f"knn_join_{kind}"
    return query(_join_sql(kind))(run)


def _knn_blocks(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _sparse(spark, sf_dir) if Similarity.of(kind).sparse else _dense(spark, sf_dir)
        return _rounded(exact.knn_join_blocks(df.withColumnRenamed("id", "qid"), df, kind, K))

    run.__name__ = f"knn_blocks_{kind}"
    return query(_join_sql(kind))(run)


for _kind in ("l2", "cosine", "jaccard"):
    _knn_join(_kind)
for _kind in ("l1", "l2", "cosine", "jaccard", "hamming"):
    _knn_blocks(_kind)


@query(f"SELECT count(*) FILTER (label <> 3) AS with_vector, count(*) AS all_rows FROM ({_DOC})")
def exists_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a vector, where those of one label have none."""
    df = _dense(spark, sf_dir).withColumn("vec", F.when(F.col("label") != 3, F.col("vec")))
    return df.agg(F.count("vec").alias("with_vector"), F.count(F.lit(1)).alias("all_rows"))


@query(_top_sql("cosine").replace(f"id = {ASKED}", "id = 7"))
def pointer_vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query names a stored vector, which is read by its id first."""
    index = _index(spark, sf_dir, DenseFloatMapping(DIMS))
    return _rounded(search(Exact("vec", Similarity.COSINE, Indexed(index.path, 7, "vec")), index, K))


@query(_top_sql("l2"))
def nested_field_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dense(spark, sf_dir)
    asked = _vector(df)
    nested = df.select("id", F.struct(F.struct("vec").alias("bar")).alias("foo"))
    return _rounded(exact.exact_topk(nested, asked, "l2", K, vec_col="foo.bar.vec"))


@query(f"""WITH d AS ({_DOC}), e AS ({_SPARSE_DOC}), q AS (SELECT vec FROM d WHERE id = {ASKED}), p AS (SELECT vec FROM e WHERE id = {ASKED}),
s AS (SELECT d.id, {_score('cosine')} + {_score('jaccard', 'p.vec', 'e.vec')} AS score FROM d JOIN e USING (id), q, p)
SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {K}""")
def multi_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vector columns in one row, both scored."""
    df = _dense(spark, sf_dir)
    asked, positive = _vector(df), _vector(_sparse(spark, sf_dir))
    two = df.withColumn("bits", transform.positive_positions(F.col("vec")))
    both = similarity("cosine", literal(asked), F.col("vec")) + similarity("jaccard", literal(positive), F.col("bits"))
    return _rounded(exact.top(two.select("id", both.alias("score")), K))


@query(f"SELECT id, len(vec)::INTEGER AS dims FROM (SELECT id, CASE WHEN id % 5 = 0 THEN vec[1:63] ELSE vec END AS vec FROM ({_DOC})) WHERE len(vec) <> {DIMS}")
def dims_mismatch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vector does not fit the mapping, where every fifth one is a value short."""
    df = _dense(spark, sf_dir).withColumn("vec", F.when(F.col("id") % 5 == 0, F.slice("vec", 1, DIMS - 1)).otherwise(F.col("vec")))
    _, bad = transform.quarantined(df, "vec", DenseFloatMapping(DIMS))
    return bad.select("id", F.size("vec").alias("dims"))


@query(f"{_scored_sql('cosine')} SELECT id, round(score, 6) AS score FROM s WHERE s.score >= 1.2")
def within_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dense(spark, sf_dir)
    return _rounded(exact.within(df, _vector(df), "cosine", 1.2))


# With other predicates and scores


@query(_top_sql("l2", where="label = 3"))
def filtered_exact_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dense(spark, sf_dir)
    return _rounded(exact.exact_topk(df.where("label = 3"), _vector(df), "l2", K))


def _function_score(name: str, mode: str, kind: str, sql: str, weight: float = 1.0, base: float | None = None, **how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _dense(spark, sf_dir)
        scored = scoring.exact_function_score(df.where("label < 5"), _vector(df), kind, weight=weight)
        out = scoring.function_score(scored, F.lit(base) if base is not None else 1.0 + F.col("label"), mode, **how)
        return _rounded(out.select("id", "score"))

    run.__name__ = name
    return query(f"{_scored_sql(kind, 'd.id, d.label', 'label < 5')}, f AS (SELECT id, {sql} AS score FROM s) SELECT id, round(score, 6) AS score FROM f{' WHERE f.score >= ' + str(how['min_score']) if how else ''}")(run)


_function_score("fs_replace", "replace", "l2", "s.score")
_function_score("fs_multiply", "multiply", "cosine", "(1.0::DOUBLE + label) * s.score")
_function_score("fs_sum_weight3", "sum", "l2", "1.0::DOUBLE + label + 3.0::DOUBLE * s.score", weight=3.0)
_function_score("fs_avg", "avg", "l1", "(1.0::DOUBLE + label + s.score) / 2")
_function_score("fs_max", "max", "cosine", "greatest(1.0::DOUBLE + label, s.score)")
_function_score("fs_min", "min", "cosine", "least(1.0::DOUBLE + label, s.score)")
_function_score("fs_min_score", "multiply", "cosine", "s.score", base=1.0, min_score=1.1)


@query(f"{_scored_sql('cosine')}, r AS (SELECT id, (s.score - 1) * (s.score - 1) AS score FROM s) SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT {K}")
def rescaled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dense(spark, sf_dir)
    scored = exact.with_score(df, _vector(df), "cosine").withColumn("score", (F.col("score") - 1) * (F.col("score") - 1))
    return _rounded(exact.top(scored.select("id", "score"), K))


@query(f"""WITH d AS ({_DOC}), q AS (SELECT vec FROM d WHERE id = {ASKED}),
b AS (SELECT *, (id % 97)::DOUBLE / 97 AS base FROM d ORDER BY base DESC, id LIMIT 100),
s AS (SELECT d.id, 0.5::DOUBLE * base + 2.0::DOUBLE * ({_score('l2')}) AS score FROM b AS d, q) SELECT id, round(score, 6) AS score FROM s""")
def rescore_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dense(spark, sf_dir)
    based = df.withColumn("base", (F.col("id") % 97).cast("double") / 97)
    return _rounded(scoring.rescore(based, "base", similarity("l2", literal(_vector(df)), F.col("vec")), 100, 0.5, 2.0).select("id", "score"))


_WORDS = ["the", "and", "de"]


@query(f"""WITH d AS ({_DOC}), q AS (SELECT vec FROM d WHERE id = {ASKED}),
t AS (SELECT d.id, d.vec, len(list_intersect(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), {_WORDS}))::DOUBLE AS words FROM d JOIN documents ON doc_id = d.id),
s AS (SELECT d.id, words + {_score('cosine')} AS score FROM t AS d, q WHERE words > 0) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {K}""")
def text_filter_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose document has a word, by the sum of a keyword score and the neighbour score."""
    df = _dense(spark, sf_dir)
    asked = _vector(df)
    joined = df.join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    words = scoring.match_score(F.col("text"), _WORDS)
    scored = joined.select("id", "vec", words.alias("words")).where("words > 0")
    return _rounded(exact.top(scored.select("id", (F.col("words") + similarity("cosine", literal(asked), F.col("vec"))).alias("score")), K))


# Hashes


def _hash_sql(mapping: Mapping, vec: str = "vec") -> str:
    """A list of (tbl, hash, freq) for a vector: dense ones a list of floats, sparse ones a list of indices."""
    model = model_of(mapping)
    entry = "{{'tbl': {t}, 'hash': {h}, 'freq': {f}}}".format
    if isinstance(mapping, JaccardLsh):
        def low(a: int, b: int) -> str:
            return f"list_min(list_transform({vec}, lambda i: (((((1 + i)::BIGINT * {a} + {b} + 2147483648) & 4294967295) - 2147483648) % 2038074743)::BIGINT))"
        tables = ", ".join(entry(t=t, h="[" + ", ".join(low(a, b) for a, b in fs) + "]", f=1) for t, fs in enumerate(model.tables))
        return f"CASE WHEN len({vec}) = 0 THEN list_transform(range(0, {mapping.L}), lambda t: {entry(t=-1, h='[2038074743::BIGINT]', f=1)}) ELSE [{tables}] END"
    if isinstance(mapping, HammingLsh):
        bits = lambda ps: " + ".join(f"CASE WHEN list_contains({vec}, {p}) THEN {1 << i} ELSE 0 END" for i, p in enumerate(ps))
        return "[" + ", ".join(entry(t=t, h=f"[({bits(ps)})::BIGINT]", f=1) for t, ps in enumerate(model.tables)) + "]"
    if isinstance(mapping, (CosineLsh, L2Lsh)):
        floats = lambda xs: "[" + ", ".join(repr(float(x)) for x in xs) + "]::FLOAT[]"
        if isinstance(mapping, CosineLsh):
            bit = lambda p, i: f"CASE WHEN {_dot(floats(p), vec)} > 0 THEN {1 << i} ELSE 0 END"
            return "[" + ", ".join(entry(t=t, h="[(" + " + ".join(bit(p, i) for i, p in enumerate(ps)) + ")::BIGINT]", f=1) for t, ps in enumerate(model.planes)) + "]"
        cell = lambda a, b: f"floor(({_dot(floats(a), vec)} + {float(b)!r}) / {float(mapping.w)!r})::BIGINT"
        return "[" + ", ".join(entry(t=t, h="[" + ", ".join(cell(a, b) for a, b in zip(ls, bs)) + "]", f=1) for t, (ls, bs) in enumerate(zip(model.lines, model.shifts))) + "]"
    place = f"list_sort(list_transform(range(0, len({vec})), lambda i: {{'m': -abs({vec}[i + 1]), 'i': i, 'h': CASE WHEN {vec}[i + 1] >= 0 THEN i + 1 ELSE -1 - i END}}))[1:{mapping.k}]"
    freq = f"({mapping.k} - len(list_filter({vec}, lambda y: abs(y) > -p.m)))::INTEGER" if mapping.repeating else "1"
    return f"list_transform({place}, lambda p: {entry(t=0, h='[p.h::BIGINT]', f=freq)})"


def _postings_cte(mapping: Mapping) -> str:
    """d, and its postings p: id, tbl, hash, freq."""
    doc = _SPARSE_DOC if mapping.sparse else _DOC
    return f"WITH d AS ({doc}), u AS (SELECT id, unnest({_hash_sql(mapping)}) AS t FROM d), p AS (SELECT id, t.tbl AS tbl, t.hash AS hash, t.freq AS freq FROM u)"


def _source(spark: SparkSession, sf_dir: str, mapping: Mapping) -> DataFrame:
    return (_sparse if mapping.sparse else _dense)(spark, sf_dir)


def _hash_query(name: str, mapping: Mapping):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return approx.postings_of(_source(spark, sf_dir, mapping), model_of(mapping)).select("id", "tbl", F.array_join(F.col("hash").cast("array<string>"), ",").alias("hash"), "freq")

    run.__name__ = name
    return query(f"{_postings_cte(mapping)} SELECT id, tbl, array_to_string(hash, ',') AS hash, freq FROM p")(run)


_hash_query("hash_jaccard", JACCARD)
_hash_query("hash_hamming", HAMMING)
_hash_query("hash_cosine", COSINE)
_hash_query("hash_l2", L2)
_hash_query("hash_permutation", PERMUTATION)
_hash_query("hash_permutation_repeating", REPEATING)


@query(None)
def hash_l2_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of every vector as a query with 5 probes; how ties are ordered has no SQL."""
    terms = approx.postings_of(_dense(spark, sf_dir), model_of(L2), probes=5)
    return terms.select("id", "tbl", F.array_join(F.col("hash").cast("array<string>"), ",").alias("hash"), "freq")


# Approximate search

CANDIDATES = 50


def _hits_cte(mapping: Mapping, count: str = "sum(least(q.freq, p.freq))") -> str:
    """Also q, the query's terms, and h: id, hits."""
    return f"{_postings_cte(mapping)}, q AS (SELECT tbl, hash, freq FROM p WHERE id = {ASKED}), h AS (SELECT p.id, {count}::BIGINT AS hits FROM p JOIN q ON p.tbl = q.tbl AND p.hash = q.hash GROUP BY p.id)"


def _asked(spark: SparkSession, sf_dir: str, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """(the postings that an index has for the query's terms, those terms)."""
    index = _index(spark, sf_dir, mapping)
    terms = model_of(mapping).hash_literal(index.get(ASKED, "vec"))
    return index.postings("vec", terms), approx.term_table(spark, terms)


@query(f"{_hits_cte(REPEATING)} SELECT id, hits FROM h")
def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approx.hit_counts(*_asked(spark, sf_dir, REPEATING))


@query(f"{_postings_cte(HAMMING)}, t AS (SELECT tbl, hash FROM p WHERE id = {ASKED} AND tbl = 3) SELECT p.id FROM p JOIN t ON p.tbl = t.tbl AND p.hash = t.hash")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the term's bytes."""
    index, model = _index(spark, sf_dir, HAMMING), model_of(HAMMING)
    term = model.hash_literal(index.get(ASKED, "vec"))[3]
    return approx.lookup_bytes(index.postings("vec", [term]), model, model.term_bytes(*term[:2])).select("id")


@query(f"{_hits_cte(JACCARD)} SELECT id, hits, {JACCARD.L} AS of_hashes FROM h ORDER BY hits DESC, id LIMIT {CANDIDATES}")
def candidates_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = approx.hit_counts(*_asked(spark, sf_dir, JACCARD))
    return approx.candidates(hits, CANDIDATES).withColumn("of_hashes", F.lit(JACCARD.L))


@query(f"{_hits_cte(COSINE)}, r AS (SELECT id, hits, id % 3 AS segment, row_number() OVER (PARTITION BY id % 3 ORDER BY hits DESC, id) AS n FROM h) SELECT id, hits, segment FROM r WHERE n <= 20")
def candidates_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approx.candidates(approx.hit_counts(*_asked(spark, sf_dir, COSINE)), 20, F.col("id") % 3)


def _lsh_sql(mapping: Mapping, kind: str, hits: str | None = None) -> str:
    return f"""{hits or _hits_cte(mapping)}, c AS (SELECT id, hits FROM h ORDER BY hits DESC, id LIMIT {CANDIDATES}), v AS (SELECT vec FROM d WHERE id = {ASKED}),
s AS (SELECT d.id, c.hits, {_score(kind, 'v.vec', 'd.vec')} AS score FROM c JOIN d USING (id), v)
SELECT id, hits, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {K}"""


def _lsh_query(mapping: Mapping, kind: str, at: Indexed) -> Query:
    if isinstance(mapping, PermutationLsh):
        return PermutationLshQuery("vec", Similarity.of(kind), CANDIDATES, at)
    if isinstance(mapping, L2Lsh):
        return L2LshQuery("vec", CANDIDATES, 2 if mapping is L2_PROBED else 0, at)
    of = {JaccardLsh: JaccardLshQuery, HammingLsh: HammingLshQuery, CosineLsh: CosineLshQuery}
    return of[type(mapping)]("vec", CANDIDATES, at)


def _lsh_topk(name: str, mapping: Mapping, kind: str, sql: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _index(spark, sf_dir, mapping)
        return _rounded(search(_lsh_query(mapping, kind, Indexed(index.path, ASKED, "vec")), index, K).select("id", "hits", "score"))

    run.__name__ = name
    return query(sql or _lsh_sql(mapping, kind))(run)


_lsh_topk("lsh_jaccard_topk", JACCARD, "jaccard")
_lsh_topk("lsh_hamming_topk", HAMMING, "hamming")
_lsh_topk("lsh_cosine_topk", COSINE, "cosine")
_lsh_topk("lsh_l2_topk", L2, "l2")
for _kind in ("cosine", "l2", "l1"):
    _lsh_topk(f"perm_{_kind}_topk", PERMUTATION, _kind)
    _lsh_topk(f"perm_repeating_{_kind}_topk", REPEATING, _kind)

# With one function a table and two probes, both neighbours of every bucket are probed, in any order.
_PROBED_HITS = f"""{_postings_cte(L2_PROBED)}, q AS (SELECT tbl, [hash[1] + s] AS hash, freq FROM p, (VALUES (-1), (0), (1)) AS n(s) WHERE id = {ASKED}),
h AS (SELECT p.id, sum(least(q.freq, p.freq))::BIGINT AS hits FROM p JOIN q ON p.tbl = q.tbl AND p.hash = q.hash GROUP BY p.id)"""
_lsh_topk("lsh_l2_multiprobe_topk", L2_PROBED, "l2", _lsh_sql(L2_PROBED, "l2", _PROBED_HITS))


def _lsh_join_sql(mapping: Mapping, kind: str) -> str:
    return f"""{_postings_cte(mapping)}, h AS (SELECT q.id AS qid, p.id AS id, sum(least(q.freq, p.freq))::BIGINT AS hits FROM p JOIN p AS q ON p.tbl = q.tbl AND p.hash = q.hash GROUP BY q.id, p.id),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS n FROM h),
s AS (SELECT c.qid, c.id, c.hits, {_score(kind)} AS score FROM c JOIN d ON d.id = c.id JOIN d AS q ON q.id = c.qid WHERE n <= {CANDIDATES}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s)
SELECT qid, id, hits, round(score, 6) AS score, rank FROM r WHERE rank <= {K}"""


def _lsh_join(name: str, mapping: Mapping, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, model = _source(spark, sf_dir, mapping), model_of(mapping)
        return _rounded(approx.approximate_join(df.withColumnRenamed("id", "qid"), df, None, model, kind, CANDIDATES, K))

    run.__name__ = name
    return query(_lsh_join_sql(mapping, kind))(run)


_lsh_join("lsh_join_l2", L2, "l2")
_lsh_join("lsh_join_cosine", COSINE, "cosine")
_lsh_join("lsh_join_jaccard", JACCARD, "jaccard")


@query(f"""{_hits_cte(COSINE, 'count(*)')} SELECT d.id, round(2.0::DOUBLE * coalesce(hits, 0) / {COSINE.L}, 6) AS score FROM d LEFT JOIN h USING (id) WHERE label < 5""")
def fs_lsh_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the query's hashes, for filtered rows; those without a shared hash stay with 0."""
    df, model = _dense(spark, sf_dir), model_of(COSINE)
    scored = scoring.hashed_function_score(df.where("label < 5"), approx.postings_of(df, model), _vector(df), model, "cosine")
    return _rounded(scoring.function_score(scored, 1.0, "replace").select("id", "score"))


def _recall_sql(mapping: Mapping, kind: str) -> str:
    exact_part = _join_sql(kind).removeprefix("WITH ")
    return f"""WITH e AS (WITH {exact_part}), a AS ({_lsh_join_sql(mapping, kind)}), w AS (SELECT qid, min(score) AS worst FROM e GROUP BY qid),
f AS (SELECT w.qid, count(a.id) FILTER (a.score >= w.worst) AS found FROM w LEFT JOIN a USING (qid) GROUP BY w.qid)
SELECT qid, found, round(found / {float(K)}, 6) AS recall FROM f"""


@query(_recall_sql(COSINE, "cosine"))
def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query, the approximate results that score at least the worst of the exact ones."""
    df, model = _dense(spark, sf_dir), model_of(COSINE)
    asked = df.withColumnRenamed("id", "qid")
    best = _rounded(exact.knn_join_blocks(asked, df, "cosine", K)).groupBy("qid").agg(F.min("score").alias("worst"))
    found = _rounded(approx.approximate_join(asked, df, None, model, "cosine", CANDIDATES, K))
    good = F.count(F.when(F.col("score") >= F.col("worst"), 1))
    counted = best.join(found, "qid", "left").groupBy("qid").agg(good.alias("found"))  # each join of blocks is run once
    return counted.select("qid", "found", F.round(F.col("found") / float(K), 6).alias("recall"))


# Conversions, documents, baskets


@query(f"WITH d AS (SELECT id, list_transform(vec, lambda x: (x * 3)::FLOAT) AS vec FROM ({_DOC})), n AS (SELECT id, vec, sqrt({_dot('vec', 'vec')}) AS size FROM d) SELECT id, round(list_sum(list_transform(vec, lambda x: abs((x / size)::FLOAT)::DOUBLE)), 6) AS l1_size, len(vec)::INTEGER AS dims FROM n")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The absolute sum of each vector after it was made three times as long and normalised."""
    df = _dense(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: (x * 3).cast("float")))
    out = transform.unit_vectors(df, "vec")
    return out.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x).cast("double")), 6).alias("l1_size"), F.size("vec").alias("dims"))


@query(f"WITH d AS ({_DOC}), u AS (SELECT generate_subscripts(vec, 1) - 1 AS i, unnest(vec)::DOUBLE AS x FROM d), p AS (SELECT i FROM u GROUP BY i ORDER BY sum(x) DESC, i LIMIT 8), l AS (SELECT list(i ORDER BY i) AS l FROM p) SELECT id, array_to_string(list_transform(l, lambda i: round(vec[i + 1], 5)::DECIMAL(9, 5)), ',') AS reduced FROM d, l")
def reduce_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the 8 positions with the largest sums, in the order of the positions."""
    df = _dense(spark, sf_dir)
    out = transform.reduce_dims(df, "vec", sorted(transform.largest_columns(df, "vec", 8)))
    return out.select("id", F.array_join(F.transform("vec", lambda x: F.round(x, 5).cast("decimal(9,5)").cast("string")), ",").alias("reduced"))


@query(f"""WITH d AS ({_DOC}), q AS (SELECT vec FROM d WHERE id = {ASKED}), t AS (SELECT id, {_score('l2')} AS score FROM d, q ORDER BY score DESC, id LIMIT 5),
n AS (SELECT 1000000 + id AS id, vec FROM d WHERE id BETWEEN 10 AND 19 UNION ALL SELECT id, vec FROM d WHERE id NOT IN (SELECT id FROM t) AND id % 11 <> 5
      UNION ALL SELECT d.id, list_transform(d.vec, lambda x: (-x)::FLOAT) FROM d WHERE id NOT IN (SELECT id FROM t) AND id % 11 = 5),
s AS (SELECT d.id, {_score('l2')} AS score FROM n AS d, q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {K}""")
def upsert_delete_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On an index: delete the five nearest rows, replace every eleventh vector, add ten rows, search again."""
    df = _dense(spark, sf_dir)
    asked = _vector(df)
    index = VectorIndex.create(df, scratch_path(spark, "index"), {"vec": DenseFloatMapping(DIMS)})
    ask = Exact("vec", Similarity.L2, asked)
    turned = df.where("id % 11 = 5").withColumn("vec", F.transform("vec", lambda x: -x))
    added = df.where("id BETWEEN 10 AND 19").withColumn("id", F.col("id") + 1000000)
    nearest = [r["id"] for r in search(ask, index, 5).collect()]
    index.upsert(turned.unionByName(added))
    index.delete(spark.createDataFrame([(i,) for i in nearest], "id long"))
    return _rounded(search(ask, index, K))


def _changed_sql(columns: str) -> str:
    """n: all rows, with every eleventh vector turned and ten rows more, and without those whose id is divisible by 13."""
    return f"""WITH d AS ({_DOC}), n AS (SELECT id, CASE WHEN id % 11 = 5 THEN list_transform(vec, lambda x: (-x)::FLOAT) ELSE vec END AS vec, label FROM d WHERE id % 13 <> 0
UNION ALL SELECT 1000000 + id AS id, vec, label FROM d WHERE id BETWEEN 10 AND 19), q AS (SELECT vec FROM d WHERE id = 7){columns}"""


def _changed(df: DataFrame) -> DataFrame:
    """What _changed_sql() adds and turns."""
    turned = df.where("id % 11 = 5 AND id % 13 <> 0").withColumn("vec", F.transform("vec", lambda x: -x))
    return turned.unionByName(df.where("id BETWEEN 10 AND 19").withColumn("id", F.col("id") + 1000000))


@query(_changed_sql(f", s AS (SELECT d.id, {_score('cosine')} AS score FROM n AS d, q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {K}"))
def compacted_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On an index: deletes and upserts, merged into one base, after which what was merged is dropped."""
    df = _dense(spark, sf_dir)
    index = VectorIndex.create(df, scratch_path(spark, "index"), {"vec": DenseFloatMapping(DIMS)})
    asked = index.get(7, "vec")
    index.delete(df.where("id % 13 = 0").select("id"))
    index.upsert(_changed(df))
    index.compact()
    index.drop_unused()
    return _rounded(search(Exact("vec", Similarity.COSINE, asked), index, K))


@query(_changed_sql(f", s AS (SELECT d.id, {_score('l1')} AS score FROM n AS d, q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {K}"))
def streamed_changes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of half the rows takes the rest, with the changes, from a stream; a search follows."""
    from .streaming.ingest import ingest

    df = _dense(spark, sf_dir)
    asked = _vector(df, 7)
    index = VectorIndex.create(df.where("id % 2 = 0"), scratch_path(spark, "index"), {"vec": DenseFloatMapping(DIMS)})
    source = scratch_path(spark, "changes")
    # A change of each id; the rest of the columns of a deletion don't matter.
    changes = df.where("id % 2 = 1 AND id % 11 <> 5 AND id % 13 <> 0").unionByName(_changed(df)).withColumn("gone", F.lit(False))
    changes.unionByName(df.where("id % 13 = 0").withColumn("gone", F.lit(True))).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 4).parquet(source)
    running = ingest(stream, index, deleted_col="gone").option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    running.awaitTermination()
    return _rounded(search(Exact("vec", Similarity.L1, asked), index, K))


@query(f"{_top_sql('l2').replace(' SELECT id,', ' SELECT id, ' + repr('Exact similarity of the query vector and the stored vector.') + ' AS explanation,')}")
def explain_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.planner import plan

    index = _index(spark, sf_dir, DenseFloatMapping(DIMS))
    return _rounded(plan(Exact("vec", Similarity.L2, Indexed(index.path, ASKED, "vec")), index).explained(K))


@query(f"""SELECT id, hits, score, printf('Share [%d] of [%d] hashes. Exact similarity is [%f].', hits, {HAMMING.L}, score) AS explanation FROM ({_lsh_sql(HAMMING, 'hamming')})""")
def explain_lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text has six places of the score, which is a share of 64 and so needs no more."""
    from .plans.planner import plan

    index = _index(spark, sf_dir, HAMMING)
    return _rounded(plan(_lsh_query(HAMMING, "hamming", Indexed(index.path, ASKED, "vec")), index).explained(K))


def _words_sql(column: str) -> str:
    return f"len(list_intersect(string_split_regex(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), {_WORDS}))"


@query(f"SELECT doc_id, greatest(2.0::DOUBLE * {_words_sql('text')}, 3.0::DOUBLE * {_words_sql('source')}, 0.5::DOUBLE * {_words_sql('lang')}) AS score FROM documents")
def multi_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three fields' keyword scores, each with a boost."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", scoring.multi_match({"text": 2.0, "source": 3.0, "lang": 0.5}, _WORDS).alias("score"))


def _facade(name: str, algorithm: str, metric: str, params: dict, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .facade import NearestNeighbors

        df = _dense(spark, sf_dir)
        fitted = NearestNeighbors(spark, algorithm, metric, params, {"candidates": CANDIDATES}).fit(df)
        return _rounded(fitted.kneighbors_frame(df.withColumnRenamed("id", "qid"), K))

    run.__name__ = name
    return query(sql)(run)


_facade("facade_exact_euclidean", "exact", "euclidean", {}, _join_sql("l2"))
_facade("facade_lsh_angular", "lsh", "angular", {"L": COSINE.L, "k": COSINE.k}, f"SELECT qid, id, score, rank FROM ({_lsh_join_sql(COSINE, 'cosine')})")


@query(f"""WITH d AS ({_DOC}), s AS ({_SPARSE_DOC}) SELECT d.id, CASE WHEN id % 7 <> 3 THEN round(list_sum(list_transform(d.vec, lambda x: x::DOUBLE)), 3) END AS total,
CASE WHEN id % 7 <> 4 THEN list_sum(s.vec)::BIGINT END AS places, CASE WHEN id % 7 <> 4 THEN {DIMS} END AS total_indices FROM d JOIN s USING (id)""")
def vectors_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in both JSON forms, short and long, some of them wrong, read from JSON documents."""
    from .sources.readers import read_documents

    df, path = _dense(spark, sf_dir), scratch_path(spark, "json")
    odd, listed = F.col("id") % 2 == 1, F.to_json("vec")
    dense = F.when(F.col("id") % 7 == 3, F.lit("[1, [2]]")).when(odd, listed).otherwise(F.concat(F.lit('{"x": 1, "values": '), listed, F.lit("}")))
    bits = transform.positive_positions(F.col("vec"))
    short = F.concat(F.lit("["), F.to_json(bits["true_indices"]), F.lit(f", {DIMS}]"))
    sparse = F.when(F.col("id") % 7 == 4, F.lit('{"true_indices": 3}')).when(odd, F.to_json(bits)).otherwise(short)
    lines = F.concat(F.lit('{"id": '), "id", F.lit(', "vec": '), dense, F.lit(', "bits": '), sparse, F.lit("}"))
    df.select(lines.alias("value")).write.text(path)
    got = read_documents(spark, path, {"vec": DenseFloatMapping(DIMS), "bits": JACCARD}, "id long")
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")), 3)
    places = F.aggregate("bits.true_indices", F.lit(0).cast("long"), lambda s, i: s + i)
    return got.select("id", total.alias("total"), places.alias("places"), F.col("bits.total_indices").alias("total_indices"))


@query(f"""WITH b AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(l_partkey))) AS vec FROM lineitem GROUP BY l_orderkey),
q AS (SELECT vec FROM b ORDER BY len(vec) DESC, id LIMIT 1), s AS (SELECT d.id, {_score('jaccard')} AS score FROM b AS d, q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT {K}""")
def basket_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose parts are most like those of the largest order."""
    sold = transform.baskets(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", BASKET_DIMS).withColumnRenamed("l_orderkey", "id")
    v = sold.orderBy(F.desc(F.size("vec.true_indices")), "id").select("vec").first()[0]
    return _rounded(exact.exact_topk(sold, SparseBool(tuple(v["true_indices"]), v["total_indices"]), "jaccard", K))


def _token_sql() -> str:
    return "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents), v AS (SELECT w, (dense_rank() OVER (ORDER BY w) - 1)::BIGINT AS i FROM (SELECT DISTINCT w FROM w WHERE w <> '')), d AS (SELECT doc_id AS id, list(i ORDER BY i) AS vec FROM w JOIN v USING (w) GROUP BY doc_id)"


@query(f"""{_token_sql()}, u AS (SELECT id, unnest({_hash_sql(BASKETS)}) AS t FROM d), p AS (SELECT id, t.tbl AS tbl, t.hash AS hash, t.freq AS freq FROM u),
q AS (SELECT * FROM p WHERE id % 20 = 0), h AS (SELECT q.id AS qid, p.id AS id, count(*) AS hits FROM p JOIN q ON p.tbl = q.tbl AND p.hash = q.hash GROUP BY q.id, p.id),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS n FROM h),
s AS (SELECT c.qid, c.id, c.hits, {_score('jaccard', 'e.vec', 'd.vec')} AS score FROM c JOIN d ON d.id = c.id JOIN d AS e ON e.id = c.qid WHERE n <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT qid, id, hits, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def doc_minhash_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whose id is divisible by 20, the documents with the most similar sets of words."""
    df = _word_sets(spark, sf_dir)
    asked = df.where("id % 20 = 0").withColumnRenamed("id", "qid")
    model = model_of(BASKETS)
    return _rounded(approx.approximate_join(asked, df, None, model, "jaccard", 20, 5))


@query(f"""{_token_sql()}, s AS (SELECT e.id AS qid, d.id, {_score('jaccard', 'e.vec', 'd.vec')} AS score FROM d, d AS e WHERE e.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def doc_jaccard_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What doc_minhash_neighbors looks for, from all documents."""
    df = _word_sets(spark, sf_dir)
    return _rounded(exact.knn_join_blocks(df.where("id % 20 = 0").withColumnRenamed("id", "qid"), df, "jaccard", 5))


def _word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec: the numbers of the words of each document."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")
    found = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words).where("w <> ''")
    vocabulary = numbered(found.select("w").distinct(), "w")
    sets = found.join(vocabulary, "w").groupBy("id").agg(F.array_sort(F.collect_set(F.col("i").cast("int"))).alias("of"))
    path = scratch_path(spark, "word-sets")  # joins read them more than once
    sets.select("id", F.struct(F.col("of").alias("true_indices"), F.lit(BASKET_DIMS).alias("total_indices")).alias("vec")).write.parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """column, i: the distinct values numbered from 0 in their order. Ranges are numbered alone and then shifted by
    what comes before them, so no task holds all values. The ranges are written down, as their borders are sampled and
    another run of the same plan has others."""
    from pyspark.sql import Window

    path = scratch_path(df.sparkSession, "numbered")
    df.repartitionByRange(parts or parts_for(df), column).select(column, F.spark_partition_id().alias("part")).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    inside = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(column)))
    before = ranged.groupBy("part").count()
    # A row for each part.
    starts = before.withColumn("start", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "start")
    return inside.join(F.broadcast(starts), "part").select(column, (F.col("start") + F.col("n") - 1).alias("i"))


@query(f"""WITH d AS ({_DOC}), q AS (SELECT vec FROM d WHERE id = {ASKED}),
s AS (SELECT d.id, {_score('cosine')} AS score FROM d, q) SELECT id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= {K}""")
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as SQL: SELECT * FROM nearest(vector, k)."""
    from . import sql

    df = _dense(spark, sf_dir)
    df.createOrReplaceTempView("nearfield_embeddings")
    sql.register(spark)
    sql.register_search(spark, "nearest", "nearfield_embeddings", "cosine")
    asked = ", ".join(f"CAST({x!r} AS FLOAT)" for x in _vector(df).values)
    return _rounded(spark.sql(f"SELECT id, score, rank FROM nearest(array({asked}), {K})"))
