"""Vectors from NumPy and SciPy, from fixed-width binary files and from JSON documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import VectorError
from ..json_codec import dense_from_json, sparse_from_json
from ..mapping import Mapping
from ..vectors import DENSE, SPARSE, DenseFloat, SparseBool


def from_numpy(spark: SparkSession, x, first_id: int = 0) -> DataFrame:
    """id, vec: a row for each row of a matrix. Boolean matrices become sparse vectors, others dense ones."""
    import numpy as np

    ids = pa.array(range(first_id, first_id + len(x)), pa.int64())
    if x.dtype == bool:
        true = [np.nonzero(row)[0].astype(np.int32) for row in x]
        vec = pa.StructArray.from_arrays([pa.array(true, pa.list_(pa.int32())), pa.array([x.shape[1]] * len(x), pa.int32())], ["true_indices", "total_indices"])
        kind = SPARSE
    else:
        flat = np.ascontiguousarray(x, np.float32)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        kind = DENSE
    return spark.createDataFrame(pa.table({"id": ids, "vec": vec}), T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", kind)]))


def from_csr(spark: SparkSession, x, first_id: int = 0) -> DataFrame:
    """id, vec: sparse vectors from anything with CSR's indptr, indices and shape."""
    rows = [(first_id + i, (sorted(map(int, x.indices[x.indptr[i] : x.indptr[i + 1]])), int(x.shape[1]))) for i in range(x.shape[0])]
    return spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", SPARSE)]))


def from_vectors(spark: SparkSession, vectors: list, first_id: int = 0) -> DataFrame:
    """id, vec from vector values, which must be of one kind."""
    if all(isinstance(v, DenseFloat) for v in vectors):
        rows, kind = [(first_id + i, list(v.values)) for i, v in enumerate(vectors)], DENSE
    elif all(isinstance(v, SparseBool) for v in vectors):
        rows, kind = [(first_id + i, (list(v.true_indices), v.total_indices)) for i, v in enumerate(vectors)], SPARSE
    else:
        raise VectorError("Expected vectors of one kind, dense or sparse")
    return spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", kind)]))


def any_vectors(spark: SparkSession, x, first_id: int = 0) -> DataFrame:
    if isinstance(x, list):
        return from_vectors(spark, x, first_id)
    if hasattr(x, "indptr"):
        return from_csr(spark, x, first_id)
    if hasattr(x, "dtype"):
        return from_numpy(spark, x, first_id)
    raise TypeError(f"No vectors can be read from a {type(x).__name__}; give a list of vectors, a matrix or a CSR matrix")


def to_numpy(df: DataFrame, vec_col: str = "vec", id_col: str = "id"):
    """A matrix of the dense vectors, in the order of the ids; for frames that fit the driver."""
    import numpy as np

    return np.array([r[0] for r in df.orderBy(id_col).select(vec_col).collect()], np.float32)


def read_fixed_width(spark: SparkSession, path: str, dims: int, id_bytes: int = 10) -> DataFrame:
    """id string, vec: files of records of an id and `dims` little-endian floats.

    Files are split into ranges of whole records, so that one of any size is read by many tasks. A broken last record is
    skipped; a file that has one can't be split so, and is read as one row.
    """
    width = id_bytes + 4 * dims
    files = spark.read.format("binaryFile").load(path)
    # Paths go as one list with commas, so a file whose name has one isn't split either.
    split = (F.col("length") % width == 0) & ~F.contains("path", F.lit(","))
    whole = [r[0] for r in files.where(split & (F.col("length") > 0)).select("path").collect()]
    contents = files.where(~split).select("content")
    if whole:
        records = spark.sparkContext.binaryRecords(",".join(whole), width).map(lambda r: (r,))
        contents = spark.createDataFrame(records, "content binary").unionByName(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            content = b"".join(c[: len(c) // width * width] for c in b.column(0).to_pylist())
            n = len(content) // width
            for lo in range(0, n, 1000):
                some = np.frombuffer(content, np.uint8, (min(n, lo + 1000) - lo) * width, lo * width).reshape(-1, width)
                ids = [bytes(r).decode() for r in some[:, :id_bytes]]
                cells = np.ascontiguousarray(some[:, id_bytes:]).view("<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["id", "vec"])

    return contents.mapInArrow(run, T.StructType([T.StructField("id", T.StringType()), T.StructField("vec", DENSE)]))


def read_documents(spark: SparkSession, path: str, fields: dict[str, Mapping], other: str = "") -> DataFrame:
    """JSON documents, a line each, gzipped or not. Vector fields may have either JSON form; `other` is the schema
    of the other columns."""
    columns = ", ".join(filter(None, [other, *(f"`{f}` string" for f in fields)]))
    df = spark.read.schema(columns).json(path)
    for f, mapping in fields.items():
        df = df.withColumn(f, sparse_from_json(F.col(f)) if mapping.sparse else dense_from_json(F.col(f)))
    return df
