"""Nearest neighbours in the manner of scikit-learn: fit(), then kneighbors()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import VectorError
from .functions.hashing import model_of
from .mapping import CosineLsh, DenseFloatMapping, HammingLsh, JaccardLsh, L2Lsh, Mapping, PermutationLsh, SparseBoolMapping
from .operators.approximate import approximate_join
from .operators.exact import _dims, knn_join_blocks
from .sources.index import VectorIndex
from .sources.readers import any_vectors
from .sources.scratch import scratch_path
from .vectors import Similarity

#: The pairs of algorithm and metric that there are.
ALGORITHMS = {
    "exact": ("l1", "l2", "cosine", "hamming", "jaccard"),
    "lsh": ("l2", "cosine", "jaccard", "hamming"),
    "permutation_lsh": ("cosine", "l2", "l1"),
}
_LSH = {"l2": L2Lsh, "cosine": CosineLsh, "jaccard": JaccardLsh, "hamming": HammingLsh}


class NearestNeighbors:
    """euclidean and angular are other names of the metrics l2 and cosine.

    mapping_params: of lsh L and k (and w for l2), of permutation_lsh k and repeating. query_params: candidates, and
    probes for l2.
    """

    def __init__(self, spark: SparkSession, algorithm: str, metric: str, mapping_params: dict | None = None, query_params: dict | None = None):
        try:
            self.similarity = Similarity.of(metric)
        except ValueError:
            self.similarity = None
        if self.similarity is None or self.similarity.value not in ALGORITHMS.get(algorithm, ()):
            pairs = [(a, m) for a, ms in ALGORITHMS.items() for m in ms]
            raise VectorError(f"No algorithm [{algorithm}] for metric [{metric}]; there are {pairs}")
        self.spark, self.algorithm, self.mapping_params = spark, algorithm, dict(mapping_params or {})
        self.set_query_params(query_params)
        self.index: VectorIndex | None = None

    def set_query_params(self, query_params: dict | None = None) -> NearestNeighbors:
        self.query_params = {"candidates": 100} | dict(query_params or {})
        return self

    def mapping(self, dims: int) -> Mapping:
        if self.algorithm == "exact":
            return (SparseBoolMapping if self.similarity.sparse else DenseFloatMapping)(dims)
        if self.algorithm == "lsh":
            return _LSH[self.similarity.value](dims, **self.mapping_params)
        return PermutationLsh(dims, **self.mapping_params)

    def fit(self, x, shards: int = 1, path: str | None = None) -> NearestNeighbors:
        """x: a matrix, a CSR matrix, a list of vectors, or a DataFrame of id and vec, which are written to an index at the
        path, or in the session's shared folder. Any earlier fit is replaced; close() deletes the index."""
        df = x if isinstance(x, DataFrame) else any_vectors(self.spark, x).repartition(max(1, shards))
        mapping = self.mapping(_dims(df, "vec") or 0)
        index = VectorIndex.create(df, path or scratch_path(self.spark, "fitted"), {"vec": mapping}, replace=True)
        if self.index is not None and self.index.path != index.path:
            self.close()
        self.index, self.fitted = index, mapping
        return self

    def close(self) -> None:
        if self.index is not None:
            self.index.drop()
            self.index = None

    def kneighbors_frame(self, queries: DataFrame, n_neighbors: int) -> DataFrame:
        """qid, id, score, rank for a frame of qid and vec, all queries in one job."""
        if self.index is None:
            raise VectorError("Call fit() first")
        if self.algorithm == "exact":
            return knn_join_blocks(queries, self.index.rows(), self.similarity, n_neighbors)
        return approximate_join(queries, self.index.rows(), None, model_of(self.fitted), self.similarity, self.query_params["candidates"], n_neighbors, probes=self.query_params.get("probes", 0)).drop("hits")

    def kneighbors(self, x, n_neighbors: int, return_similarity: bool = False):
        """Positions in the fitted data, a row for each query; missing ones are -1, with a similarity of NaN."""
        import numpy as np

        queries = any_vectors(self.spark, x).withColumnRenamed("id", "qid")
        n = x.shape[0] if hasattr(x, "shape") else len(x)
        inds, sims = np.full((n, n_neighbors), -1, np.int32), np.full((n, n_neighbors), np.nan)
        for r in self.kneighbors_frame(queries, n_neighbors).collect():
            inds[r["qid"], r["rank"] - 1], sims[r["qid"], r["rank"] - 1] = r["id"], r["score"]
        return (inds, sims) if return_similarity else inds
