"""Neighbour scores together with other predicates and scores: filtered search, function scores, rescoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import VectorError
from ..functions.hashing import HashModel
from ..functions.similarity import literal, similarity
from ..vectors import DenseFloat, Empty, Indexed, Similarity, SparseBool
from .approximate import presence_counts, term_table


def exists(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """The rows that have a vector."""
    return df.where(F.col(vec_col).isNotNull())


def _literal_only(query) -> None:
    if isinstance(query, Indexed):
        # Fixed value.
        raise VectorError("The score function does not support indexed vectors. Provide a literal vector instead.")
    if isinstance(query, Empty):
        raise VectorError(f"Expected a literal vector but got [{query}]")


def exact_function_score(rows: DataFrame, query: DenseFloat | SparseBool, kind: Similarity | str, vec_col: str = "vec", weight: float = 1.0, into: str = "knn_score", missing: str = "error") -> DataFrame:
    """rows (filtered before) with weight times the exact score. A row without a vector is an error, or with
    missing="skip" has a null score."""
    _literal_only(query)
    score = similarity(kind, literal(query), F.col(vec_col)) * F.lit(float(weight))
    if missing == "error":
        hint = f"A row has no vector in field [{vec_col}]. Filter rows with exists() first."
        score = F.when(F.col(vec_col).isNull(), F.raise_error(F.lit(hint)).cast("double")).otherwise(score)
    else:
        score = F.when(F.col(vec_col).isNotNull(), score)
    return rows.withColumn(into, score)


def hashed_function_score(rows: DataFrame, postings: DataFrame, query: DenseFloat | SparseBool, model: HashModel, kind: Similarity | str, id_col: str = "id", weight: float = 1.0, probes: int = 0, into: str = "knn_score") -> DataFrame:
    """rows with weight times the largest score times the share of the query's terms that they have.

    All rows stay, with 0 where they share none. Only presence counts. Postings are cut to the query's terms before
    they meet the rows.
    """
    _literal_only(query)
    kind = Similarity.of(kind)
    terms = model.hash_literal(query, probes) if probes else model.hash_literal(query)
    hits = presence_counts(postings, term_table(rows.sparkSession, terms)).select(F.col("id").alias("_id"), "hits")
    joined = rows.join(hits, F.col(id_col) == F.col("_id"), "left")
    share = F.coalesce(F.col("hits"), F.lit(0)) / F.lit(float(len(terms)))
    return joined.withColumn(into, F.lit(weight * kind.max_score) * share).drop("_id", "hits")


BOOST_MODES = ("multiply", "replace", "sum", "avg", "max", "min")


def combined(base: Column, function: Column, mode: str = "multiply") -> Column:
    """The score of a row from that of its query and that of the function."""
    of = {
        "multiply": lambda: base * function,
        "replace": lambda: function,
        "sum": lambda: base + function,
        "avg": lambda: (base + function) / 2,
        "max": lambda: F.greatest(base, function),
        "min": lambda: F.least(base, function),
    }
    if mode not in of:
        raise VectorError(f"Expected [boost_mode] to be one of [{','.join(BOOST_MODES)}] but found [{mode}]")
    return of[mode]()


def function_score(scored: DataFrame, base: Column | float = 1.0, mode: str = "multiply", min_score: float | None = None, knn_col: str = "knn_score", into: str = "score") -> DataFrame:
    """scored with the combined score; rows under min_score go."""
    base = F.lit(float(base)) if isinstance(base, (int, float)) else base
    out = scored.withColumn(into, combined(base, F.col(knn_col), mode))
    return out if min_score is None else out.where(F.col(into) >= min_score)


def rescore(rows: DataFrame, base_col: str, knn: Column, window: int, query_weight: float = 1.0, rescore_weight: float = 1.0, id_col: str = "id", into: str = "score") -> DataFrame:
    """The `window` best rows by their base score get query_weight * base + rescore_weight * knn, in that order.

    A row without a neighbour score keeps query_weight * base.
    """
    best = rows.orderBy(F.desc(base_col), id_col).limit(window)
    score = F.lit(float(query_weight)) * F.col(base_col) + F.coalesce(F.lit(float(rescore_weight)) * knn, F.lit(0.0))
    return best.withColumn(into, score).orderBy(F.desc(into), id_col)


def match_score(text: Column, query_words: list[str], boost: float = 1.0) -> Column:
    """A keyword score: boost times the number of distinct query words that the text has, by whole words, any case."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.lit(float(boost)) * F.size(F.array_intersect(found, F.lit([w.lower() for w in query_words]))).cast("double")


def multi_match(fields: dict[str, float], query_words: list[str]) -> Column:
    """The best keyword score of several fields, each with its boost."""
    scores = [match_score(F.col(c), query_words, b) for c, b in fields.items()]
    return scores[0] if len(scores) == 1 else F.greatest(*scores)


def any_word(fields: list[str], query_words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (match_score(F.col(c), query_words) > 0 for c in fields))


def random_score(seed: int | None = None) -> Column:
    return F.rand(seed)
