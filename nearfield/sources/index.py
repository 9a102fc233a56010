"""A vector index on disk: rows, postings and manifests.

The base holds most rows. Upserts and deletes add a small part each, whose rows replace or hide those with the same
id; compact() merges all parts into a new base. Rows are sorted by id and postings by a 64-bit key of their term, in
small pages, and each table has a list of its files' least and largest values. So a lookup of some ids or terms opens
only the files that can have them, and reads only their pages.

Each change writes a manifest with the next number, which names the parts in use. It is seen when its manifest is in
place; a failed one leaves what was there before, and one of two that began from the same manifest is refused.
"""

from __future__ import annotations

import re
import struct
import uuid
from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import NotFound, VectorError
from ..functions.hashing import Term, model_of
from ..json_codec import mapping_from_json
from ..mapping import DenseFloatMapping, Mapping, SparseBoolMapping, put_mapping
from ..operators.approximate import postings_of
from ..operators.transform import normal_sparse, validated
from ..vectors import DenseFloat, SparseBool
from .files import Files

MANIFEST = re.compile(r"manifest-(\d+)\.json")
_DELETED = "_deleted"
#: Rows of a page of rows and of a page of postings; pages are what a lookup reads.
ROWS_PAGE, POSTINGS_PAGE = 128, 2048
#: Values that Parquet's IN filter compares one by one; with more, Spark prunes by the least and the largest.
IN_GROUP = 10


def term_key(tbl: Column, hashed: Column) -> Column:
    return F.xxhash64(tbl, hashed)


def key_of(term: Term) -> int:
    """What term_key() gives: each number is hashed with the hash before it as the seed."""
    from xxhash import xxh64_intdigest

    key = 42
    for i in (term[0], *term[1]):
        key = xxh64_intdigest(struct.pack("<i", i), key)
    return key - (1 << 64) if key >> 63 else key


def one_of(c: Column, values: list) -> Column:
    """Whether c is one of the values, as groups that are small enough to be compared with each page's least and
    largest value; the groups are halved into one expression, which stays flat."""
    groups = [c.isin(values[i : i + IN_GROUP]) for i in range(0, len(values), IN_GROUP)]
    while len(groups) > 1:
        groups = [reduce(lambda a, b: a | b, groups[i : i + 2]) for i in range(0, len(groups), 2)]
    return groups[0] if groups else F.lit(False)


class SortedTable:
    """A Parquet table sorted by a column, and what its files hold of it."""

    def __init__(self, spark: SparkSession, path: str, column: str, files: list[list]):
        self.spark, self.path, self.column = spark, path, column
        self.files = files  # [name, least, largest], in the order of both

    @classmethod
    def write(cls, df: DataFrame, path: str, column: str, page: int, *ties: str) -> SortedTable:
        """Rows without a value of the column aren't found by it."""
        df.repartitionByRange(column, *ties).sortWithinPartitions(column, *ties).write.option("compression", "zstd").option("parquet.page.row.count.limit", page).parquet(path)
        spark = df.sparkSession
        found = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(column).alias("least"), F.max(column).alias("largest")).where("least IS NOT NULL")
        return cls(spark, path, column, sorted((list(r) for r in found.collect()), key=lambda r: (r[1], r[2])))

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def names(self, values: list) -> list[str]:
        """The files that can hold one of the values, which are sorted."""
        found: dict[str, None] = {}
        ends = [largest for _, _, largest in self.files]
        for v in values:
            at = bisect_left(ends, v)
            while at < len(self.files) and self.files[at][1] <= v:
                found.setdefault(self.files[at][0])
                at += 1
        return list(found)

    def of(self, values: list, schema) -> DataFrame:
        """The rows with one of the values."""
        values = sorted(set(values))
        names = self.names(values)
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names)).where(one_of(F.col(self.column), values))


class VectorIndex:
    """An index at a path. Fields are other columns than the id, or paths into them; each mapped one is a vector column
    of the rows. Ids are whole numbers or strings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path.rstrip("/"), Files(spark, path)
        self._tables: dict[str, SortedTable] = {}  # by path; a written table never changes
        if self._number() < 0:
            raise NotFound(f"Index [{path}] not found")

    # Writing

    @classmethod
    def create(cls, rows: DataFrame, path: str, mappings: dict[str, Mapping], id_col: str = "id", replace: bool = False) -> VectorIndex:
        """The index of rows, whose ids must be distinct. Vectors that don't fit their mapping fail the call. An index that
        is replaced is read until the new one is in place; its parts stay until drop_unused()."""
        spark, files = rows.sparkSession, Files(rows.sparkSession, path)
        number = _last(files)
        if number >= 0 and not replace:
            raise VectorError(f"Index [{path}] exists")
        before = files.read_json(_manifest(number)) if number >= 0 else None
        base = _write(rows.withColumn(_DELETED, F.lit(False)), path.rstrip("/"), mappings, id_col)
        manifest = {"id": id_col, "mappings": {k: v.to_json() for k, v in mappings.items()}, "schema": rows.schema.json(), "base": base, "deltas": [], "batches": {}, "unused": _parts(before)}
        _commit(files, path, number, manifest, base)
        return cls(spark, path)

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds rows, or replaces those with the same id. A repeated batch (stream, number) does nothing."""
        self._add(rows.select(*self.columns).withColumn(_DELETED, F.lit(False)), batch)

    def delete(self, ids: DataFrame) -> None:
        """ids: a frame with the id column."""
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema().fields if f.name != self.id_col]
        gone = ids.select(F.col(self.id_col)).distinct().select(F.col(self.id_col), *others).select(*self.columns)
        self._add(gone.withColumn(_DELETED, F.lit(True)), None)

    def _add(self, rows: DataFrame, batch: tuple[str, int] | None) -> None:
        number = self._number()
        manifest = self._manifest(number)
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return
        part = _write(rows, self.path, self.mappings, self.id_col)
        manifest["deltas"].append(part)
        if batch:
            manifest["batches"][batch[0]] = batch[1]
        _commit(self._files, self.path, number, manifest, part)

    def compact(self) -> None:
        """One base again; readers that began before keep their parts until drop_unused()."""
        number = self._number()
        manifest = self._manifest(number)
        base = _write(self.rows().withColumn(_DELETED, F.lit(False)), self.path, self.mappings, self.id_col)
        _commit(self._files, self.path, number, manifest | {"base": base, "deltas": [], "unused": _parts(manifest)}, base)

    def drop_unused(self) -> None:
        """What no reader of the last manifest needs goes, old manifests too."""
        number = self._number()
        manifest = self._manifest(number)
        unused = manifest.pop("unused", [])
        _commit(self._files, self.path, number, manifest | {"unused": []})
        for part in unused:
            self._files.delete(part)
        for name in self._files.names():
            if (m := MANIFEST.fullmatch(name)) and int(m[1]) <= number:
                self._files.delete(name)

    def drop(self) -> None:
        self._files.delete()

    # Reading

    def _number(self) -> int:
        return _last(self._files)

    def _manifest(self, number: int | None = None) -> dict:
        return self._files.read_json(_manifest(self._number() if number is None else number))

    @property
    def id_col(self) -> str:
        return self._manifest()["id"]

    @property
    def mappings(self) -> dict[str, Mapping]:
        return {k: mapping_from_json(v) for k, v in self._manifest()["mappings"].items()}

    def mapping(self, field: str) -> Mapping:
        if field not in (found := self.mappings):
            if field in self.columns:
                raise VectorError(f"Expected field [{field}] to be a vector field but it has type [{self._schema()[field].dataType.simpleString()}]")
            raise VectorError(f"Could not find mapped field type for field [{field}]")
        return found[field]

    def _schema(self):
        import json

        from pyspark.sql import types as T

        return T.StructType.fromJson(json.loads(self._manifest()["schema"]))

    @property
    def columns(self) -> list[str]:
        return self._schema().names

    def _table(self, part: str, name: str, column: str) -> SortedTable:
        path = f"{self.path}/{part}/{name}"
        if path not in self._tables:
            self._tables[path] = SortedTable(self.spark, path, column, self._files.read_json(f"{part}/{name}.json"))
        return self._tables[path]

    def _rows(self, part: str) -> SortedTable:
        return self._table(part, "rows", self.id_col)

    def _newest(self, manifest: dict) -> DataFrame | None:
        """id, part: of each id in deltas the last one that has it."""
        if not manifest["deltas"]:
            return None
        ids = [self._rows(d).all().select(F.col(manifest["id"]).alias("_id"), F.lit(n).alias("_part")) for n, d in enumerate(manifest["deltas"])]
        return reduce(DataFrame.unionByName, ids).groupBy("_id").agg(F.max("_part").alias("_part"))

    def _mapped(self, rows: DataFrame) -> DataFrame:
        out = rows.where(~F.col(_DELETED)).select(*self.columns)
        for field, mapping in self.mappings.items():
            if "." not in field:
                out = put_mapping(out, field, mapping)
        return out

    def rows(self) -> DataFrame:
        """The live rows; mapped columns carry their mappings."""
        manifest = self._manifest()
        base, newest = self._rows(manifest["base"]).all(), self._newest(manifest)
        if newest is not None:
            own = manifest["id"]
            added = reduce(DataFrame.unionByName, [self._rows(d).all().withColumn("_part", F.lit(n)) for n, d in enumerate(manifest["deltas"])])
            added = added.join(newest.withColumnRenamed("_id", own), [own, "_part"], "left_semi").drop("_part")
            base = base.join(newest.select(F.col("_id").alias(own)), own, "left_anti").unionByName(added)
        return self._mapped(base)

    def rows_of(self, ids: list) -> DataFrame:
        """The live rows with these ids, a bounded list. Only the pages that can hold them are read."""
        manifest, schema = self._manifest(), self._schema().add(_DELETED, "boolean")
        parts = [manifest["base"], *manifest["deltas"]]
        found = [self._rows(p).of(ids, schema) for p in parts]
        if len(parts) == 1:
            return self._mapped(found[0])
        both = reduce(DataFrame.unionByName, [df.withColumn("_part", F.lit(n)) for n, df in enumerate(found)])
        own = manifest["id"]
        newest = both.groupBy(own).agg(F.max("_part").alias("_part"))
        return self._mapped(both.join(newest, [own, "_part"], "left_semi"))

    def postings(self, field: str, terms: list[Term] | None = None) -> DataFrame:
        """id, tbl, hash, freq of the live rows; with terms, only theirs, of which only the pages that can hold them are
        read."""
        manifest = self._manifest()
        newest = self._newest(manifest)
        id_type = self._schema()[self.id_col].dataType.simpleString()

        def of(part: str) -> DataFrame:
            table = self._table(part, f"postings-{field}", "key")
            return table.all() if terms is None else table.of([key_of(t) for t in terms], f"key long, tbl int, hash array<int>, freq int, id {id_type}")

        out = of(manifest["base"])
        if newest is not None:
            ids = newest.select(F.col("_id").alias("id"), "_part")
            added = reduce(DataFrame.unionByName, [of(d).withColumn("_part", F.lit(n)) for n, d in enumerate(manifest["deltas"])])
            out = out.join(ids, "id", "left_anti").unionByName(added.join(ids, ["id", "_part"], "left_semi").drop("_part"))
        return out.select("id", "tbl", "hash", "freq")

    def get(self, id: object, field: str) -> DenseFloat | SparseBool:
        """The vector of one row; the field may be a path into structs."""
        where = f"with id [{id}] in index [{self.path}]"
        found = self.rows_of([id])
        top, *path = field.split(".")
        if (row := found.first()) is None:
            raise NotFound(f"Document {where} not found")
        value = row[top] if top in found.columns else None
        for name in path:
            value = value[name] if value is not None and name in value else None
        if value is None:
            raise NotFound(f"Document {where} exists, but does not have field [{field}]")
        if isinstance(value, list):
            return DenseFloat(tuple(value))
        if hasattr(value, "asDict") and {"true_indices", "total_indices"} <= value.asDict().keys():
            return SparseBool(tuple(value["true_indices"]), value["total_indices"])
        raise NotFound(f"Document {where} exists, but the field [{field}] has an unexpected type")

    def largest_terms(self, field: str, n: int = 20) -> DataFrame:
        """tbl, hash, rows: the terms that most rows share, which cost most to count."""
        return self.postings(field).groupBy("tbl", "hash").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "tbl", "hash").limit(n)


def _manifest(number: int) -> str:
    return f"manifest-{number}.json"


def _last(files: Files) -> int:
    """The number of the last manifest, or -1."""
    return max((int(m[1]) for n in files.names() if (m := MANIFEST.fullmatch(n))), default=-1)


def _parts(manifest: dict | None) -> list[str]:
    return [manifest["base"], *manifest["deltas"], *manifest.get("unused", [])] if manifest else []


def _commit(files: Files, path: str, before: int, manifest: dict, written: str | None = None) -> None:
    """The next manifest; where there is one by now, the part that was written for it goes."""
    if not files.write_new_json(_manifest(before + 1), manifest):
        if written:
            files.delete(written)
        raise VectorError(f"Index [{path}] was changed by another writer; nothing of this change was kept")


def _write(rows: DataFrame, path: str, mappings: dict[str, Mapping], id_col: str) -> str:
    part, files = f"part-{uuid.uuid4().hex}", Files(rows.sparkSession, path)
    for field, mapping in mappings.items():
        rows = validated(rows, field, mapping)
        rows = normal_sparse(rows, field) if mapping.sparse else rows
    try:
        table = SortedTable.write(rows, f"{path}/{part}/rows", id_col, ROWS_PAGE)
        files.write_new_json(f"{part}/rows.json", table.files)
        stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{part}/rows")
        wrong = stored.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).first()
        if wrong is not None:
            raise VectorError(f"Expected distinct ids but [{wrong[0]}] comes [{wrong[1]}] times")
        for field, mapping in mappings.items():
            if not isinstance(mapping, (DenseFloatMapping, SparseBoolMapping)):
                terms = postings_of(stored.select(F.col(id_col).alias("id"), F.col(field).alias("vec")), model_of(mapping))
                keyed = terms.select(term_key(F.col("tbl"), F.col("hash")).alias("key"), "tbl", "hash", "freq", "id")
                table = SortedTable.write(keyed, f"{path}/{part}/postings-{field}", "key", POSTINGS_PAGE, "id")
                files.write_new_json(f"{part}/postings-{field}.json", table.files)
    except BaseException:
        files.delete(part)
        raise
    return part


def last_of_each(rows: DataFrame, id_col: str, order: Column) -> DataFrame:
    """Of rows with one id the one that comes last."""
    w = Window.partitionBy(id_col).orderBy(order.desc())
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
