"""Exact deduplication by skew-safe combining.

Every stage groups by the digest and by the full text, so two texts are only ever merged after their contents
were compared:

1. each task merges its own equal texts (the map side of the salted aggregate);
2. salted digest groups merge, so that a digest that holds a third of all rows is spread over SALTS tasks;
3. the winners of the salts, at most SALTS rows a text, merge to one row a text.

The winners then go back to the documents by digest. If one digest ever had two contents, those digests are
matched by full text as well. Null texts count as empty. Of the rows of a text one stays: of those with the smallest
doc_id the first in a numbering of the rows, so rows that repeat a doc_id and its text go too, and a text stays whatever
other rows share its doc_id. A null doc_id is larger than all others. Texts of any length are compared whole, each
in its own row. Only the two named columns of docs are read; all of distinct_documents() come back, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Held, Stash, numbered_rows, unhot_join

SALTS = 16


def normal_text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE_CLASS + "+", " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    keyed = docs.select(row.alias("_row"), F.col(id_col).alias("doc_id"), normal_text(F.col(text_col)).alias("_text"))
    return keyed.withColumn("_digest", F.unhex(F.sha2("_text", 256)))


def winners(keyed: DataFrame) -> DataFrame:
    """One row for each text: _digest, _text, keep_id, group_size."""
    salted = keyed.drop("_row").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best, size = F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    local = salted.groupBy("_digest", "_salt", "_text").agg(best, size)
    return local.groupBy("_digest", "_text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """_row, doc_id, _digest, keep_id, group_size, kept: a row for each row of docs."""
    keyed = _keyed(docs, id_col, text_col, row)
    best = winners(keyed)
    # The texts were compared; from here on only digests with two contents need them.
    found = Stash(
        best.groupBy("_digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("_contents")),
        "exact-winners",
    ).df
    total = found.agg(F.sum("group_size")).first()[0] or 0
    rows = Stash(keyed.select("_row", "doc_id", "_digest", F.col("_digest").alias("_group")), "exact-rows").df
    single, clashing = found.where("_contents = 1"), found.where("_contents > 1").select("_digest")
    if clashing.isEmpty():
        groups = single.withColumnRenamed("_digest", "_group")
    else:
        group = F.concat("_digest", F.col("_text").cast("binary"))
        alike = Stash(keyed.join(clashing, "_digest", "left_semi").select("_row", "doc_id", "_digest", group.alias("_group")), "exact-clashing").df
        rows = rows.join(clashing, "_digest", "left_anti").unionByName(alike)
        several = best.join(clashing, "_digest", "left_semi").select(group.alias("_group"), "keep_id", "group_size")
        groups = single.select(F.col("_digest").alias("_group"), "keep_id", "group_size").unionByName(several)
    joined = unhot_join(rows, groups.select("_group", "keep_id", "group_size"), "_group", "group_size", total)
    joined = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Rows that repeat both doc_id and text: the first of them alone is kept.
    repeated = rows.groupBy("_group", "doc_id").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    repeated = Held(repeated.select(F.struct("_group", "doc_id").alias("_twins"), "_first", "_rows")).df
    if not repeated.isEmpty():
        joined = unhot_join(joined.withColumn("_twins", F.struct("_group", "doc_id")), repeated, "_twins", "_rows", total, "left")
        joined = joined.withColumn("kept", F.col("kept") & F.coalesce(F.col("_row") == F.col("_first"), F.lit(True)))
    return joined.select("_row", "doc_id", "_digest", "keep_id", "group_size", "kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    found = _verdicts(docs, id_col, text_col, F.monotonically_increasing_id())
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, with all columns of docs."""
    rows, row = numbered_rows(docs, "exact-numbered")
    copies = _verdicts(rows, id_col, text_col, F.col(row)).where(~F.col("kept")).select(F.col("_row").alias(row))
    return rows.join(copies, row, "left_anti").select(*docs.columns)
