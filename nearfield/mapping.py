"""Mappings: what a vector field holds and how it is indexed."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .errors import VectorError
from .vectors import DENSE, SPARSE, Similarity

#: Of the JSON form.
DENSE_TYPE, SPARSE_TYPE = "dense_float_vector", "sparse_bool_vector"


@dataclass(frozen=True)
class Mapping:
    dims: int

    #: What sets a mapping's JSON form apart; each class has its own.
    type_name = ""
    model = "exact"
    similarity = None

    @property
    def sparse(self) -> bool:
        return self.type_name == SPARSE_TYPE

    @property
    def spark_type(self) -> T.DataType:
        return SPARSE if self.sparse else DENSE

    def to_json(self) -> dict:
        options = {"model": self.model} | ({"similarity": self.similarity.value} if self.similarity else {}) | asdict(self)
        return {"type": self.type_name, "options": options}


@dataclass(frozen=True)
class DenseFloatMapping(Mapping):
    type_name = DENSE_TYPE


@dataclass(frozen=True)
class SparseBoolMapping(Mapping):
    type_name = SPARSE_TYPE


def _positive(**numbers: int) -> None:
    for name, n in numbers.items():
        if n < 1:
            raise VectorError(f"Expected [{name}] to be at least 1 but found [{n}]")


@dataclass(frozen=True)
class _Lsh(Mapping):
    L: int
    k: int

    model = "lsh"

    def __post_init__(self):
        _positive(L=self.L, k=self.k)


class _BitLsh(_Lsh):
    def __post_init__(self):
        super().__post_init__()
        if self.k > 31:
            raise VectorError(f"Expected [k] to be at most 31, the bits of a hash, but found [{self.k}]")


@dataclass(frozen=True)
class JaccardLsh(_Lsh):
    type_name, similarity = SPARSE_TYPE, Similarity.JACCARD


@dataclass(frozen=True)
class HammingLsh(_BitLsh):
    type_name, similarity = SPARSE_TYPE, Similarity.HAMMING


@dataclass(frozen=True)
class CosineLsh(_BitLsh):
    type_name, similarity = DENSE_TYPE, Similarity.COSINE


@dataclass(frozen=True)
class L2Lsh(_Lsh):
    w: int

    type_name, similarity = DENSE_TYPE, Similarity.L2

    def __post_init__(self):
        super().__post_init__()
        _positive(w=self.w)


@dataclass(frozen=True)
class PermutationLsh(Mapping):
    k: int
    repeating: bool

    type_name, model = DENSE_TYPE, "permutation_lsh"

    def __post_init__(self):
        if not 1 <= self.k <= self.dims:
            raise VectorError(f"Expected [k] to be between 1 and the dimension {self.dims} but found [{self.k}]")


#: The key of a field's metadata.
METADATA = "vector_mapping"


def put_mapping(df: DataFrame, field: str, mapping: Mapping) -> DataFrame:
    """df whose column `field` carries the mapping; Parquet keeps it."""
    import json

    column: Column = df[field].alias(field, metadata={METADATA: json.dumps(mapping.to_json())})
    return df.withColumn(field, column)


def get_mapping(df: DataFrame, field: str) -> Mapping:
    """The mapping of a column, which may lie in structs: foo.bar.vec."""
    import json

    from .json_codec import mapping_from_json

    at: T.DataType = df.schema
    found = None
    for name in field.split("."):
        found = next((f for f in at.fields if f.name == name), None) if isinstance(at, T.StructType) else None
        if found is None:
            raise VectorError(f"Could not find mapped field type for field [{field}]")
        at = found.dataType
    if METADATA not in found.metadata:
        raise VectorError(f"Expected field [{field}] to have type [{DENSE_TYPE}] or [{SPARSE_TYPE}] but had [{at.simpleString()}]")
    return mapping_from_json(json.loads(found.metadata[METADATA]))
