"""Nearest-neighbour queries, and which mappings they can run on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from . import mapping as m
from .errors import VectorError
from .vectors import DenseFloat, Empty, Indexed, Similarity, SparseBool, Vector


@dataclass(frozen=True)
class Query:
    field: str

    model = "exact"

    def with_vec(self, vec: Vector) -> Query:
        return replace(self, vec=vec)

    def to_json(self) -> dict:
        out = {"field": self.field, "model": self.model, "similarity": self.similarity.value, "vec": self.vec.to_json()}
        return out | {k: getattr(self, k) for k in ("candidates", "probes") if hasattr(self, k)}


@dataclass(frozen=True)
class Exact(Query):
    similarity: Similarity
    vec: Vector = Empty()


@dataclass(frozen=True)
class _Lsh(Query):
    candidates: int
    vec: Vector = Empty()

    model = "lsh"


class JaccardLshQuery(_Lsh):
    similarity = Similarity.JACCARD


class HammingLshQuery(_Lsh):
    similarity = Similarity.HAMMING


class CosineLshQuery(_Lsh):
    similarity = Similarity.COSINE


@dataclass(frozen=True)
class L2LshQuery(Query):
    candidates: int
    probes: int = 0
    vec: Vector = Empty()

    model, similarity = "lsh", Similarity.L2


@dataclass(frozen=True)
class PermutationLshQuery(Query):
    similarity: Similarity
    candidates: int
    vec: Vector = Empty()

    model = "permutation_lsh"


#: Of approximate queries, the mappings that have their hashes; exact ones run on all mappings of their vector type.
_HASHED = {JaccardLshQuery: m.JaccardLsh, HammingLshQuery: m.HammingLsh, CosineLshQuery: m.CosineLsh, L2LshQuery: m.L2Lsh, PermutationLshQuery: m.PermutationLsh}


def check_compatible(query: Query, mapping: m.Mapping) -> None:
    """An error unless the query can run on a field with the mapping."""
    vec = query.vec
    kind = isinstance(vec, SparseBool if mapping.sparse else DenseFloat)
    pointer = isinstance(vec, Indexed)
    fits = type(mapping) is _HASHED[type(query)] if type(query) in _HASHED else True
    if not (fits and query.similarity.sparse == mapping.sparse and (kind or pointer)):
        raise VectorError(f"Query [{query}] is not compatible with mapping [{mapping}]")
    if not pointer:
        from .vectors import check_dims

        check_dims(vec, mapping.dims)
    for name in ("candidates", "probes"):
        if getattr(query, name, 0) < 0:
            raise VectorError(f"Expected [{name}] to be at least 0 but found [{getattr(query, name)}]")
