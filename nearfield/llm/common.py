"""What the training-data operators share: scratch tables, text rules, joins that survive hot keys."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import parts_for, scratch_root  # noqa: F401

#: White space of every text contract: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: A key with over 1/HEAVY of all rows is heavy, so there are fewer than HEAVY of them whatever the input.
HEAVY = 1000


#: The folders of applications that name none.
_OWN: dict[str, str] = {}

#: Rows of a few numbers that one file holds, where nothing else says how many files to write.
FILE_ROWS = 500_000

#: What was written in each open scratch(), the innermost last.
_OPEN: list[list] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or our own where that is unset.

    Our own is chosen once an application.
    """
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base and app not in _OWN:
        _OWN[app] = scratch_root(spark)
    return (base or _OWN[app]).rstrip("/")


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside go at its end, so results that read them must be written inside it too."""
    _OPEN.append([])
    try:
        yield
    finally:
        for table in _OPEN.pop():
            table.drop()
        tidy()


def tidy() -> None:
    """Has the driver drop what nothing holds any more. Spark takes broadcasts, shuffles and generated classes back only
    when its JVM collects garbage, which by itself comes late: after dozens of small plans they are most of its memory."""
    if spark := SparkSession.getActiveSession():
        spark._jvm.System.gc()


#: Seconds that a Python worker keeps what it made for one operator without a task of that operator.
LINGER = 2.0

#: What this worker keeps: the value, the tasks that use it, and the timer that lets it go.
_KEPT: dict[tuple, list] = {}
_KEPT_LOCK = threading.Lock()


@contextmanager
def lingering(make: Callable, *how: Any) -> Iterator[Any]:
    """make(*how), which tasks that follow each other in a Python worker share. Workers serve an application to its end,
    so what no task has used for LINGER seconds goes: else its memory stands beside all that other operators need."""
    key = (make, *how)
    with _KEPT_LOCK:
        if key not in _KEPT:
            _KEPT[key] = [make(*how), 0, None]
        kept = _KEPT[key]
        kept[1] += 1
        if kept[2]:
            kept[2].cancel()
    try:
        yield kept[0]
    finally:
        with _KEPT_LOCK:
            kept[1] -= 1
            if not kept[1]:
                kept[2] = threading.Timer(LINGER, _let_go, [key])
                kept[2].daemon = True
                kept[2].start()


def _let_go(key: tuple) -> None:
    import ctypes
    import gc

    import pyarrow as pa

    with _KEPT_LOCK:
        if key not in _KEPT or _KEPT[key][1]:
            return
        del _KEPT[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/nearfield/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: For tables on a local or mounted file system: without the checksum files beside them, for each of which the writer
#: starts processes of its own. Parquet has checksums of its pages. Other file systems take no notice.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Stash:
    """A table written to the shared folder: cuts lineage, and outlives any executor; with keep, an open scratch() too.
    seen has the values of the named aggregates, which are taken of the rows as they are written."""

    def __init__(self, df: DataFrame, label: str, partition_by: str | None = None, codec: str = "zstd", keep: bool = False, **aggregates: Column):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        self._schema = df.schema
        seen = Observation() if aggregates else None
        if seen:
            df = df.observe(seen, *(c.alias(name) for name, c in aggregates.items()))
        writer = df.write.option("compression", codec).options(**_PLAIN_FILES)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path)
        self.seen = seen.get if seen else {}
        if _OPEN and not keep:
            _OPEN[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, which has few columns and about so many rows, in as few parts as that takes."""
    return df.coalesce(1 + rows // FILE_ROWS)


class Held:
    """A narrow result that executors keep on their disks for several uses. What a lost executor held is made again from
    what it was made of, and plans go on from there, so results that number rows or end chains are stashed instead."""

    def __init__(self, df: DataFrame):
        self.df = df.persist(StorageLevel.DISK_ONLY)
        if _OPEN:
            _OPEN[-1].append(self)

    def drop(self) -> None:
        self.df.unpersist()


class Bucketed:
    """A table like a stash whose files are dealt by a key: joins and groups by it don't shuffle it."""

    def __init__(self, df: DataFrame, label: str, key: str, buckets: int, sort: bool = False, codec: str = "zstd"):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, label)
        self.name = "nearfield_" + self.path.rsplit("-", 1)[1]
        writer = df.write.option("compression", codec).options(path=self.path, **_PLAIN_FILES).bucketBy(buckets, key)
        (writer.sortBy(key) if sort else writer).saveAsTable(self.name)
        if _OPEN:
            _OPEN[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    return Stash(df, label).df


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered_rows(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A table of docs with one more column, a number of each row, and that column's name. Numbers are written down, so
    they are the same in all that reads them."""
    row = fresh(docs, "_row")
    return stash(docs.withColumn(row, F.monotonically_increasing_id()), label), row


def hash_place(c: Column) -> Column:
    """Where the hash of a value lies between 0 and 1."""
    return F.xxhash64(c).cast("double") / 2.0**64 + 0.5


def share_for(wanted: int, rows: Column | int) -> Column | float:
    """The share of hashes in which the `wanted` first of so many rows lie: those are then few to sort. As many more as ten
    times the spread of such a count are taken along, so fewer than wanted practically never come."""
    taken = wanted + 10.0 * wanted**0.5 + 10.0
    if isinstance(rows, int):
        return min(1.0, taken / max(1, rows))
    return F.least(F.lit(1.0), taken / rows)


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay. lower() does just that where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def words(c: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS + "+"), "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row even where body reads it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def unhot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for each key and in `weight` the rows of left that hold it.

    Keys with over total/HEAVY rows are fewer than HEAVY, so their rows of right are broadcast and left's rows
    of those keys are never shuffled; every other key is small and meets its row by a plain shuffled join.
    how: inner or left.
    """
    heavy = right.where(F.col(weight) * F.lit(HEAVY) > F.lit(total))
    light = right.where(F.col(weight) * F.lit(HEAVY) <= F.lit(total))
    hot = left.join(F.broadcast(heavy), key, "inner")
    cold = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return hot.unionByName(cold)
