"""From a query to a DataFrame: resolve pointers, check types, choose the strategy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..errors import VectorError
from ..functions.hashing import model_of
from ..mapping import Mapping
from ..operators import approximate, exact
from ..query import Exact, Query, check_compatible
from ..sources.index import VectorIndex
from ..vectors import Indexed


def resolved(query: Query, indexes: dict[str, VectorIndex]) -> Query:
    """The query with a literal vector in place of a pointer."""
    at = query.vec
    if not isinstance(at, Indexed):
        return query
    if at.index not in indexes:
        raise VectorError(f"Index [{at.index}] of the query vector is not known")
    return query.with_vec(indexes[at.index].get(at.id, at.field))


@dataclass(frozen=True)
class Plan:
    """A checked query on an index."""

    index: VectorIndex
    query: Query
    mapping: Mapping

    @property
    def strategy(self) -> str:
        return "exact" if isinstance(self.query, Exact) else "approximate"

    def hits(self, size: int = 10, fetch: tuple[str, ...] = (), where: Column | None = None, segment: Column | None = None) -> DataFrame:
        """id, score (and hits, if approximate) of the best `size` rows. Rows that fail `where` are not scored."""
        q, own = self.query, self.index.id_col
        rows = self.index.rows()
        rows = rows if where is None else rows.where(where)
        if self.strategy == "exact":
            return exact.exact_topk(rows, q.vec, q.similarity, size, own, q.field, fetch)
        model, probes = model_of(self.mapping), getattr(q, "probes", 0)
        terms = model.hash_literal(q.vec, probes) if probes else model.hash_literal(q.vec)
        postings = self.index.postings(q.field, terms)
        if segment is not None or q.candidates > approximate.FETCHED:
            return approximate.approximate_topk(rows, postings, q.vec, model, q.similarity, q.candidates, size, own, q.field, probes, segment, fetch)

        def rows_of(ids: list) -> DataFrame:
            found = self.index.rows_of(ids)
            return found if where is None else found.where(where)

        return approximate.lookup_topk(rows_of, postings, q.vec, terms, q.similarity, q.candidates, size, own, q.field, fetch)

    def explained(self, size: int = 10) -> DataFrame:
        found = self.hits(size)
        if self.strategy == "exact":
            return exact.explain_exact(found)
        probes = getattr(self.query, "probes", 0)
        model = model_of(self.mapping)
        return approximate.explain_approximate(found, len(model.hash_literal(self.query.vec, probes) if probes else model.hash_literal(self.query.vec)))


def plan(query: Query, index: VectorIndex, indexes: dict[str, VectorIndex] | None = None) -> Plan:
    mapping = index.mapping(query.field)
    query = resolved(query, {index.path: index} | (indexes or {}))
    check_compatible(query, mapping)
    return Plan(index, query, mapping)


def search(query: Query, index: VectorIndex, size: int = 10, indexes: dict[str, VectorIndex] | None = None, fetch: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    return plan(query, index, indexes).hits(size, fetch, where)
