"""Line deduplication on levelled sorted runs of line hashes.

A run is a table of (_key, _docs, _keeper) sorted by key: a line's 128-bit digest, in how many documents of its
batch it was found, and the largest doc_id there. Each new batch is merge-anti-joined with the runs, which drops
the lines that are settled (common already, with a keeper that the batch does not raise; the few that are heavy
in the batch are counted on, as their counts steer the last join), and adds its own run.
When a level holds FANOUT runs they are compacted into one run of the next level. Documents come in batches of
descending doc_id, so most common lines settle in the first batches.

Null and empty texts have one empty line. Rows that share a doc_id are one document when lines are counted, and all of
them keep a line whose keeper they are; rows without a doc_id are one document too, with a smaller id than all others.
doc_ids are whole numbers. Texts of any length are split in their own row, of which the distinct long lines' digests are
held at once; columns of docs other than the two named ones are not read, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, SPACE, Bucketed, Stash, ascii_lower, parts_for, unhot_join

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of one call, and the runs of a level that are compacted.
BATCHES, FANOUT = 4, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _digest(line: Column, min_chars: int) -> Column:
    """The digest of a line's key; null for keys that are too short to count."""
    return F.transform(F.array(line_key(line)), lambda k: F.when(F.char_length(k) >= min_chars, F.unhex(F.md5(k))))[0]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levels. add() takes batches (_key, doc_id) without repeats, and a document's in one batch, in any order."""

    def __init__(self, spark, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]

    def _write(self, run: DataFrame) -> DataFrame:
        """Sorted and bucketed by key, so merges of runs neither shuffle nor sort them again."""
        return Bucketed(run.repartition(self.buckets, "_key"), "line-run", "_key", self.buckets, sort=True).df

    def merged(self) -> DataFrame | None:
        """One row for each line of all runs."""
        runs = [run for level in self.levels for run in level]
        return self._merge(runs) if runs else None

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Pairs of runs are sorted and dealt alike, so a merge join needs no shuffle of what was written."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(F.col("_key").alias("_key2"), F.col("_docs").alias("_docs2"), F.col("_keeper").alias("_keeper2")).hint("merge")
            docs = F.coalesce("_docs", F.lit(0)) + F.coalesce("_docs2", F.lit(0))
            both = a.join(b, F.col("_key") == F.col("_key2"), "full")
            return both.select(F.coalesce("_key", "_key2").alias("_key"), docs.alias("_docs"), F.greatest("_keeper", "_keeper2").alias("_keeper"))

        return reduce(two, runs)

    def add(self, batch: DataFrame) -> None:
        own = batch.groupBy("_key").agg(F.count(F.lit(1)).alias("_docs"), F.max("doc_id").alias("_keeper"))
        if (seen := self.merged()) is not None:
            settled = seen.where(F.col("_docs") >= self.min_docs).select("_key", F.col("_keeper").alias("_best")).hint("merge")
            raised = F.coalesce(F.col("_keeper") > F.col("_best"), F.col("_keeper").isNotNull() & F.col("_best").isNull())
            heavy = F.col("_docs") * HEAVY > batch.count()
            own = own.join(settled, (own["_key"] == settled["_key"]) & ~raised & ~heavy, "left_anti")
        self.levels[0].append(self._write(own))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merge(self.levels[k])))
                self.levels[k] = []

    def common(self) -> DataFrame:
        """_key, _docs, _keeper of the lines found in min_docs documents, after one batch at least.

        A settled line is counted on only in batches where it is heavy, so _docs is short of the documents by at
        most 1/HEAVY of all rows.
        """
        return self.merged().where(F.col("_docs") >= self.min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped: each row of docs without the lines that many documents share."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // batches))
    batch = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / F.lit(width)).cast("int"), F.lit(batches - 1)) if high is not None else F.lit(0)
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("_text")), lambda x: _digest(x, min_chars)), lambda k: k.isNotNull()))
    # Distinct, as rows that share a doc_id are one document; so a key has as many rows here as documents.
    pairs = Stash(docs.select("doc_id", batch.alias("_batch"), F.explode(keys).alias("_key")).distinct(), "line-keys", partition_by="_batch").df
    runs = LineRuns(spark, min_docs, buckets=parts_for(docs))
    for k in range(batches):
        runs.add(pairs.where(F.col("_batch") == k).select("_key", "doc_id"))
    common, total = Stash(runs.common(), "line-common").df, pairs.count()
    lost = unhot_join(pairs.select("_key", "doc_id"), common, "_key", "_docs", total).where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    lost = lost.groupBy("doc_id").agg(F.collect_set("_key").alias("_lost"))
    joined = docs.join(lost.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    lines = _lines(F.col("_text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_lost"), _digest(x, min_chars)), F.lit(False)))
    cut = joined.select("doc_id", "_text", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("_lost").isNotNull(), kept).alias("_kept"))
    return cut.select(
        "doc_id",
        F.coalesce(F.array_join("_kept", "\n"), F.col("_text"), F.lit("")).alias("kept_text"),
        "n_lines",
        F.coalesce(F.col("n_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
