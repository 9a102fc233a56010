"""Vectors and similarities as plain values, and the Spark types of vector columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from .errors import VectorError, wrong_dimensions


class Similarity(Enum):
    COSINE = "cosine"
    HAMMING = "hamming"
    JACCARD = "jaccard"
    L1 = "l1"
    L2 = "l2"

    @property
    def sparse(self) -> bool:
        return self in (Similarity.JACCARD, Similarity.HAMMING)

    @property
    def max_score(self) -> float:
        """The score of a vector with itself, and the most there is."""
        return 2.0 if self is Similarity.COSINE else 1.0

    @classmethod
    def of(cls, name: str | Similarity) -> Similarity:
        """Names in any case; angular and euclidean are other names of cosine and l2."""
        if isinstance(name, Similarity):
            return name
        lower = name.lower()
        return cls({"angular": "cosine", "euclidean": "l2"}.get(lower, lower))


DENSE = T.ArrayType(T.FloatType(), True)
SPARSE = T.StructType([T.StructField("true_indices", T.ArrayType(T.IntegerType(), True)), T.StructField("total_indices", T.IntegerType())])


@dataclass(frozen=True)
class DenseFloat:
    values: tuple[float, ...]

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(map(float, self.values)))

    @property
    def dims(self) -> int:
        return len(self.values)

    def unit(self) -> DenseFloat:
        size = sum(x * x for x in self.values) ** 0.5
        return DenseFloat(tuple(x / size for x in self.values)) if size else self

    def to_json(self) -> dict:
        return {"values": list(self.values)}


@dataclass(frozen=True)
class SparseBool:
    """The indices are kept sorted and distinct."""

    true_indices: tuple[int, ...]
    total_indices: int

    def __post_init__(self):
        object.__setattr__(self, "true_indices", tuple(sorted({int(i) for i in self.true_indices})))

    @property
    def dims(self) -> int:
        return self.total_indices

    def check_range(self) -> None:
        if self.true_indices and not 0 <= self.true_indices[0] <= self.true_indices[-1] < self.total_indices:
            raise VectorError(f"Expected indices from 0 to {self.total_indices - 1} but got {self.true_indices[0]} to {self.true_indices[-1]}")

    def to_json(self) -> dict:
        return {"true_indices": list(self.true_indices), "total_indices": self.total_indices}


@dataclass(frozen=True)
class Indexed:
    """A pointer to a stored vector; the field may be a dotted path."""

    index: str
    id: str
    field: str

    def to_json(self) -> dict:
        return {"index": self.index, "id": self.id, "field": self.field}


@dataclass(frozen=True)
class Empty:
    """A placeholder, which no query runs with."""

    def to_json(self) -> dict:
        return {}


Vector = DenseFloat | SparseBool | Indexed | Empty


def check_dims(vector: DenseFloat | SparseBool, dims: int) -> None:
    if vector.dims != dims:
        raise wrong_dimensions(vector.dims, dims)
    if isinstance(vector, SparseBool):
        vector.check_range()
