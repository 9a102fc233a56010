"""Checks and conversions of vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import sorted_sparse, unit
from ..mapping import Mapping


def dims_of(vec: Column, sparse: bool) -> Column:
    return vec["total_indices"] if sparse else F.size(vec)


def fits(vec: Column, mapping: Mapping) -> Column:
    """Whether a vector can be stored: null ones can."""
    ok = dims_of(vec, mapping.sparse) == mapping.dims
    if mapping.sparse:
        indices = vec["true_indices"]
        ok = ok & F.coalesce((F.array_min(indices) >= 0) & (F.array_max(indices) < mapping.dims), F.lit(True)) & ~F.exists(indices, lambda i: i.isNull())
    else:
        ok = ok & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    return vec.isNull() | F.coalesce(ok, F.lit(False))


def replaced(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with another value in a column, or at a path into structs; a struct on the way that is null stays so."""
    top, _, rest = path.partition(".")
    return df.withColumn(top, F.col(top).withField(rest, value)) if rest else df.withColumn(path, value)


def validated(df: DataFrame, vec_col: str, mapping: Mapping) -> DataFrame:
    """df; a vector that doesn't fit fails the job that reads it. vec_col may be a path into structs."""
    vec = F.col(vec_col)
    wrong = F.format_string("Expected dimension %d but got %d", F.lit(mapping.dims), F.coalesce(dims_of(vec, mapping.sparse), F.lit(-1)))
    other = F.lit(f"A vector in field [{vec_col}] has nulls, NaNs or indices out of range")
    message = F.when(F.coalesce(dims_of(vec, mapping.sparse), F.lit(-1)) != mapping.dims, wrong).otherwise(other)
    kind = df.select(vec).schema[0].dataType
    return replaced(df, vec_col, F.when(fits(vec, mapping), vec).otherwise(F.raise_error(message).cast(kind)))


def quarantined(df: DataFrame, vec_col: str, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """(rows that can be stored, rows that can't)."""
    ok = fits(F.col(vec_col), mapping)
    return df.where(ok), df.where(~ok)


def normal_sparse(df: DataFrame, vec_col: str) -> DataFrame:
    """Indices sorted and distinct, as every operator expects stored vectors."""
    return replaced(df, vec_col, sorted_sparse(F.col(vec_col)))


def unit_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    return df.withColumn(vec_col, unit(F.col(vec_col)))


def positive_positions(vec: Column) -> Column:
    """A sparse vector of the positions with a value over 0."""
    positions = F.filter(F.transform(vec, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    return F.when(vec.isNotNull(), F.struct(positions.alias("true_indices"), F.size(vec).alias("total_indices")))


def largest_columns(df: DataFrame, vec_col: str, dims: int, sample_rows: int | None = None) -> list[int]:
    """The positions with the largest sums, at most `dims`, best first; of the first sample_rows rows if given."""
    rows = df.select(vec_col) if sample_rows is None else df.select(vec_col).limit(sample_rows)
    sums = rows.select(F.posexplode(vec_col).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("double")).alias("total"))
    return [r["at"] for r in sums.orderBy(F.desc("total"), "at").limit(dims).collect()]


def reduce_dims(df: DataFrame, vec_col: str, positions: list[int]) -> DataFrame:
    """Vectors of the chosen positions, in that order."""
    chosen = F.lit(positions).cast("array<int>")
    return df.withColumn(vec_col, F.transform(chosen, lambda i: F.get(F.col(vec_col), i)))


def baskets(df: DataFrame, key: str, item: str, total: int) -> DataFrame:
    """key, vec: the distinct items of each key as a sparse vector with `total` indices."""
    grouped = df.where(F.col(item).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.col(item).cast("int"))).alias("_items"))
    return grouped.select(key, F.struct(F.col("_items").alias("true_indices"), F.lit(total).cast("int").alias("total_indices")).alias("vec"))
