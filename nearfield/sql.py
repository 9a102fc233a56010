"""The similarities as SQL functions, and searches as SQL table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DENSE, _SPARSE = "ARRAY<FLOAT>", "STRUCT<true_indices: ARRAY<INT>, total_indices: INT>"
_DOT = "aggregate(zip_with(a, b, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x)"
_SIZES = "sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x * x AS DOUBLE))) * sqrt(aggregate(b, 0D, (s, x) -> s + CAST(x * x AS DOUBLE)))"
_COMMON = "size(array_intersect(a.true_indices, b.true_indices))"
_BOTH = "size(a.true_indices) + size(b.true_indices)"

BUCKETS = 64

#: Name: (type of both vectors, the expression).
FUNCTIONS = {
    "vec_dot": (_DENSE, _DOT),
    "vec_l1": (_DENSE, "1 / (1 + aggregate(zip_with(a, b, (x, y) -> CAST(abs(x - y) AS DOUBLE)), 0D, (s, x) -> s + x))"),
    "vec_l2": (_DENSE, "1 / (1 + sqrt(aggregate(zip_with(a, b, (x, y) -> CAST(x - y AS DOUBLE) * CAST(x - y AS DOUBLE)), 0D, (s, x) -> s + x)))"),
    "vec_cosine": (_DENSE, f"CASE WHEN {_SIZES} > 0 THEN 1 + {_DOT} / ({_SIZES}) WHEN a = b THEN 2D ELSE 0D END"),
    "vec_jaccard": (_SPARSE, f"CASE WHEN {_BOTH} = 0 THEN 1D ELSE CAST({_COMMON} AS DOUBLE) / ({_BOTH} - {_COMMON}) END"),
    "vec_hamming": (_SPARSE, f"CAST(a.total_indices - ({_BOTH} - 2 * {_COMMON}) AS DOUBLE) / a.total_indices"),
}


def register(spark: SparkSession) -> None:
    """vec_l1(query, stored) and so on, for any SQL of the session."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a {kind}, b {kind}) RETURNS DOUBLE RETURN {body}")


def register_search(spark: SparkSession, name: str, table: str, similarity: str, id_col: str = "id", vec_col: str = "vec") -> None:
    """SELECT * FROM name(query, k): id, score and rank of the k nearest rows of a table or view.

    Rows are cut to the k best of each of BUCKETS groups by the id's hash first, so one task ranks as many rows as that,
    however large the table and k are.
    """
    kind, _ = FUNCTIONS[f"vec_{similarity}"]
    id_type = dict(spark.table(table).dtypes)[id_col]
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query {kind}, k INT) RETURNS TABLE (id {id_type}, score DOUBLE, rank INT)
        RETURN SELECT id, score, rank FROM (
            SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
                SELECT id, score, row_number() OVER (PARTITION BY pmod(xxhash64(id), {BUCKETS}) ORDER BY score DESC, id) AS place
                FROM (SELECT {id_col} AS id, vec_{similarity}(query, {vec_col}) AS score FROM {table} WHERE {vec_col} IS NOT NULL))
            WHERE place <= k)
        WHERE rank <= k""")
