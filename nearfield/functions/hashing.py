"""Hash models: a vector becomes terms (tbl, hash, freq), and near vectors share terms.

Each model has the same terms in three forms: hash_column() for DataFrames, in the JVM; hash_block() for many vectors in
NumPy, as flat arrays; and hash_literal() for one query vector. Parameters follow from the mapping alone.
"""

from __future__ import annotations

import heapq
from abc import ABC, abstractmethod
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import VectorError
from ..mapping import CosineLsh, HammingLsh, JaccardLsh, L2Lsh, Mapping, PermutationLsh
from ..vectors import DenseFloat, SparseBool
from .codecs import int_from_bytes, int_to_bytes, ints_from_bytes, ints_to_bytes
from .java_random import JavaRandom
from .similarity import dot

#: The type of a vector's terms.
TERMS = "array<struct<tbl:int,hash:array<int>,freq:int>>"
#: The modulus of minimum hashes, which is also the hash of a sparse vector without indices, in no table.
PRIME = 2038074743
NO_TABLE = -1

Term = tuple[int, tuple[int, ...], int]


def _term(tbl: Column, hashed: Column, freq: Column | None = None) -> Column:
    freq = F.lit(1) if freq is None else freq
    return F.struct(tbl.cast("int").alias("tbl"), hashed.cast("array<int>").alias("hash"), freq.cast("int").alias("freq"))


class Terms(NamedTuple):
    """The terms of many vectors, in flat arrays: how many each vector has; of each term the table, how many numbers its
    hash has, and its frequency; and all those numbers."""

    counts: object
    tbl: object
    sizes: object
    freq: object
    numbers: object

    @classmethod
    def regular(cls, hashes, tbl=None, freq=None) -> Terms:
        """hashes: vectors by terms by numbers. tbl and freq: vectors by terms, or the term's place and 1."""
        import numpy as np

        n, terms, k = hashes.shape
        tbl = np.tile(np.arange(terms), n) if tbl is None else tbl.ravel()
        freq = np.ones(n * terms, int) if freq is None else freq.ravel()
        return cls(np.full(n, terms), tbl, np.full(n * terms, k), freq, hashes.ravel())

    def lists(self) -> list[list[Term]]:
        import numpy as np

        ends, flat = np.cumsum(self.sizes).tolist(), self.numbers.tolist()
        found = [(t, tuple(flat[a:b]), f) for t, f, a, b in zip(self.tbl.tolist(), self.freq.tolist(), [0, *ends], ends)]
        ends = np.cumsum(self.counts).tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends)]

    def arrow(self):
        """A list of structs for each vector."""
        import numpy as np
        import pyarrow as pa

        ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        hashes = pa.ListArray.from_arrays(ends(self.sizes), pa.array(self.numbers, pa.int32()))
        structs = pa.StructArray.from_arrays([pa.array(self.tbl, pa.int32()), hashes, pa.array(self.freq, pa.int32())], ["tbl", "hash", "freq"])
        return pa.ListArray.from_arrays(ends(self.counts), structs)


class HashModel(ABC):
    sparse = False
    #: About how often hashing a vector runs a lambda in the Column form.
    steps = 0

    @abstractmethod
    def hash_column(self, vec: Column) -> Column:
        """A column of TERMS; null for null vectors."""

    @abstractmethod
    def hash_block(self, vectors, probes: int = 0) -> Terms:
        """The terms of each vector: of dense ones the rows of a matrix; of sparse ones (all indices, how many each has)."""

    def term_bytes(self, tbl: int, hashed: tuple[int, ...]) -> bytes:
        """The bytes of a term in indexes that store terms as bytes: the table and the numbers, four bytes each."""
        return int_to_bytes(*hashed) if tbl == NO_TABLE else ints_to_bytes(hashed, tbl)

    def terms_of(self, term: bytes) -> list[tuple[int, tuple[int, ...]]]:
        """The terms that have these bytes: one at most, or for numbers of fewer bytes one for each way to part them."""
        if term == self.term_bytes(NO_TABLE, (PRIME,)):
            return [(NO_TABLE, (PRIME,))]
        tbl, *hashed = ints_from_bytes(term) if len(term) % 4 == 0 and len(term) > 4 else (0,)
        return [(tbl, tuple(hashed))] if hashed else []

    def hash_literal(self, vec: DenseFloat | SparseBool, probes: int = 0) -> list[Term]:
        import numpy as np

        one = (np.array(vec.true_indices, np.int64), np.array([len(vec.true_indices)])) if self.sparse else np.array([vec.values], np.float32)
        return self.hash_block(one, probes).lists()[0]


def _wrapped(c: Column) -> Column:
    """A bigint as what 32-bit arithmetic would leave of it."""
    return (c + (1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)


class MinHash(HashModel):
    """A table's hash has k minima of (1 + index) * a + b, wrapped to 32 bits, then by the truncated remainder."""

    sparse = True

    def __init__(self, L: int, k: int):
        r = JavaRandom(0)
        a = [r.next_int(PRIME - 1) for _ in range(L * k)]
        b = [r.next_int(PRIME - 1) for _ in range(L * k)]
        self.L, self.tables = L, [[(a[t * k + j], b[t * k + j]) for j in range(k)] for t in range(L)]
        self.steps = L * k * 32  # for each index of the vector, of which there may be many

    def hash_column(self, vec: Column) -> Column:
        indices = vec["true_indices"]
        tables = F.array(*(F.struct(F.lit(t).alias("t"), F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in fs)).alias("fs")) for t, fs in enumerate(self.tables)))

        def least(f: Column, of: Column) -> Column:
            return F.array_min(F.transform(of, lambda i: _wrapped((1 + i) * f["a"] + f["b"]) % PRIME))

        # A row's indices are read once, as what a lambda takes.
        hashed = F.transform(F.array(indices), lambda of: F.transform(tables, lambda x: _term(x["t"], F.transform(x["fs"], lambda f: least(f, of)))))[0]
        nothing = F.array_repeat(_term(F.lit(NO_TABLE), F.array(F.lit(PRIME))), self.L)
        return F.when(F.size(indices) == 0, nothing).when(indices.isNotNull(), hashed)

    def hash_block(self, vectors, probes: int = 0) -> Terms:
        import numpy as np

        indices, lengths = vectors
        k, some = len(self.tables[0]), np.flatnonzero(lengths)
        a, b = (np.array([f[i] for fs in self.tables for f in fs], np.int64) for i in (0, 1))
        hashes = np.full((len(lengths), self.L, k), PRIME, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths[some])])
        indices, lo = np.asarray(indices, np.int64), 0
        while lo < len(some):  # some vectors at a time, one of any length at least
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20) // len(a), "right")) - 1)
            x = (1 + indices[ends[lo] : ends[hi]])[:, None] * a + b
            x = ((x + (1 << 31)) & ((1 << 32) - 1)) - (1 << 31)
            hashes[some[lo:hi]] = np.minimum.reduceat(np.fmod(x, PRIME), ends[lo:hi] - ends[lo], axis=0).reshape(-1, self.L, k)
            lo = hi
        tbl = np.where(np.asarray(lengths)[:, None] > 0, np.arange(self.L), NO_TABLE)
        sizes = np.where(tbl == NO_TABLE, 1, k)
        return Terms(np.full(len(lengths), self.L), tbl.ravel(), sizes.ravel(), np.ones(tbl.size, int), hashes[np.arange(k) < sizes[:, :, None]])


class BitHashes(HashModel):
    """Models whose hash is one number of bits."""

    def term_bytes(self, tbl: int, hashed: tuple[int, ...]) -> bytes:
        """The table and the bits, each in as few bytes as it needs."""
        return int_to_bytes(tbl) + int_to_bytes(hashed[0])

    def terms_of(self, term: bytes) -> list[tuple[int, tuple[int, ...]]]:
        parted = [(term[:n], term[n:]) for n in (1, 2, 4) if len(term) - n in (1, 2, 4)]
        found = [(int_from_bytes(a), (int_from_bytes(b),)) for a, b in parted]
        return [x for x in found if self.term_bytes(*x) == term]


class BitSampling(BitHashes):
    """A table's hash has the bits at k sampled positions, the least position in the lowest bit."""

    sparse = True

    def __init__(self, dims: int, L: int, k: int):
        r = JavaRandom(0)

        def sample(n: int) -> list[int]:
            found: dict[int, None] = {}
            while len(found) < min(n, dims):
                found.setdefault(r.next_int(dims))
            return list(found)

        if L * k <= dims:
            drawn = sample(L * k)
            tables = [drawn[t::L] for t in range(L)]
        else:
            if k > dims:
                raise VectorError(f"Expected [k] to be at most the dimension {dims} but found [{k}]")
            tables = [sample(k) for _ in range(L)]
        self.tables = [sorted(t) for t in tables]
        self.steps = L * k

    def hash_column(self, vec: Column) -> Column:
        indices = vec["true_indices"]

        def bits(of: Column, positions: list[int]) -> Column:
            terms = [F.when(F.array_contains(of, p), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(positions)]
            return F.array(sum(terms[1:], terms[0]))

        hashed = F.transform(F.array(indices), lambda of: F.array(*(_term(F.lit(t), bits(of, ps)) for t, ps in enumerate(self.tables))))[0]
        return F.when(indices.isNotNull(), hashed)

    def hash_block(self, vectors, probes: int = 0) -> Terms:
        import numpy as np

        indices, lengths = vectors
        asked, place = np.unique(np.array(self.tables), return_inverse=True)
        at = np.searchsorted(asked, indices)
        real = at < len(asked)
        real[real] = asked[at[real]] == np.asarray(indices)[real]
        on = np.zeros((len(lengths), len(asked)), bool)
        on[np.repeat(np.arange(len(lengths)), lengths)[real], at[real]] = True
        place = place.reshape(len(self.tables), -1)
        return Terms.regular((on[:, place] @ (1 << np.arange(place.shape[1])))[:, :, None])


class Hyperplanes(BitHashes):
    """A table's hash has a bit for each of k random planes: on which side the vector lies."""

    def __init__(self, dims: int, L: int, k: int):
        import numpy as np

        r = JavaRandom(0)
        self.planes = np.array([[r.next_gaussian() for _ in range(dims)] for _ in range(L * k)], np.float32).reshape(L, k, dims)
        self.steps = self.planes.size

    def hash_column(self, vec: Column) -> Column:
        planes = F.array(*(F.struct(F.lit(t).alias("t"), F.lit([[float(x) for x in p] for p in ps]).cast("array<array<float>>").alias("ps")) for t, ps in enumerate(self.planes)))

        def bits(of: Column, ps: Column) -> Column:
            on = F.transform(ps, lambda p, i: F.when(dot(p, of) > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(F.lit(0)))
            return F.array(F.aggregate(on, F.lit(0), lambda a, b: a + b))

        hashed = F.transform(F.array(vec), lambda of: F.transform(planes, lambda x: _term(x["t"], bits(of, x["ps"]))))[0]
        return F.when(vec.isNotNull(), hashed)

    def hash_block(self, vectors, probes: int = 0) -> Terms:
        import numpy as np

        L, k, dims = self.planes.shape
        sides = (np.asarray(vectors, np.float64) @ self.planes.reshape(-1, dims).T.astype(np.float64) > 0).reshape(-1, L, k)
        return Terms.regular((sides @ (1 << np.arange(k)))[:, :, None])


class StableDistributions(HashModel):
    """A table's hash has k projections cut into buckets of width w; queries can also probe buckets nearby."""

    def __init__(self, dims: int, L: int, k: int, w: int):
        import numpy as np

        r = JavaRandom(0)
        self.w = w
        self.lines = np.array([[r.next_gaussian() for _ in range(dims)] for _ in range(L * k)], np.float32).reshape(L, k, dims)
        self.steps = self.lines.size
        self.shifts = np.array([np.float32(r.next_float()) * np.float32(w) for _ in range(L * k)], np.float32).reshape(L, k)

    def hash_column(self, vec: Column) -> Column:
        lines = F.array(*(
            F.struct(F.lit(t).alias("t"), F.array(*(F.struct(F.lit([float(x) for x in a]).cast("array<float>").alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(ls, bs))).alias("fs"))
            for t, (ls, bs) in enumerate(zip(self.lines, self.shifts))
        ))
        cut = lambda f, of: F.floor((dot(f["a"], of) + f["b"]) / F.lit(float(self.w))).cast("int")
        hashed = F.transform(F.array(vec), lambda of: F.transform(lines, lambda x: _term(x["t"], F.transform(x["fs"], lambda f: cut(f, of)))))[0]
        return F.when(vec.isNotNull(), hashed)

    def _projections(self, vectors):
        import numpy as np

        L, k, dims = self.lines.shape
        return (np.asarray(vectors, np.float64) @ self.lines.reshape(-1, dims).T.astype(np.float64)).reshape(-1, L, k) + self.shifts

    def hash_block(self, vectors, probes: int = 0) -> Terms:
        import numpy as np

        at = self._projections(vectors) / self.w
        cells = np.floor(at).astype(np.int64)
        if not probes:
            return Terms.regular(cells)
        more = [self._probes(c, x - c, probes) for c, x in zip(cells, at)]
        tables = [np.concatenate([np.arange(len(cells[0])), [t for t, _, _ in m]]) for m in more]
        hashes = [np.concatenate([c, np.array([h for _, h, _ in m], np.int64).reshape(-1, c.shape[1])]) for c, m in zip(cells, more)]
        n, k = sum(map(len, tables)), self.lines.shape[1]
        flat = np.concatenate([np.zeros((0, k), np.int64), *hashes]).ravel()
        return Terms(np.array([len(t) for t in tables], int), np.concatenate([np.zeros(0, int), *tables]), np.full(n, k), np.ones(n, int), flat)

    def _probes(self, cells, inside, probes: int) -> list[Term]:
        """Other buckets over all tables: L times as many as `probes`, or as 3^k - 1.

        A step moves one coordinate of a table by one, and is as long as the vector lies away from the border that it
        crosses. A table's steps are sorted by length. What is visited is a set of steps, shortest sum first: its
        successors put the next step in place of the last, or add it. A coordinate takes one step only. Where a new step
        meets an older one of its coordinate, the older is given up, and the set goes on to the step after that at once;
        the sum keeps the length of the one given up, so such sets come later than their buckets lie, and a bucket may
        come twice. Ties go by table, then by the place of the last step.
        """
        L, k = cells.shape
        steps = [sorted([(float(x), j, -1) for j, x in enumerate(row)] + [(float(1 - x), j, 1) for j, x in enumerate(row)]) for row in inside]

        def onward(t: int, far: float, last: int, taken: dict[int, int], instead: bool):
            """The set with the next step, instead of the last or beside it; None where there is none."""
            while last + 1 < 2 * k:
                (length, old, _), (more, j, way) = steps[t][last], steps[t][last + 1]
                met = j in taken and not (instead and j == old)
                taken = {c: w for c, w in taken.items() if not (instead and c == old)} | {j: way}
                far, last = far + more - (length if instead else 0.0), last + 1
                if not met:
                    return far, t, last, taken
                instead = True
            return None

        heap = [(steps[t][0][0], t, 0, n, {steps[t][0][1]: steps[t][0][2]}) for n, t in enumerate(range(L))]
        heapq.heapify(heap)
        out: list[Term] = []
        wanted, n = L * min(probes, 3**k - 1), L
        while heap and len(out) < wanted:
            far, t, last, _, taken = heapq.heappop(heap)
            for instead in (True, False):
                if (after := onward(t, far, last, taken, instead)) is not None:
                    n += 1
                    heapq.heappush(heap, (*after[:3], n, after[3]))
            h = cells[t].tolist()
            for j, way in taken.items():
                h[j] += way
            out.append((t, tuple(h), 1))
        return out


class Permutation(HashModel):
    """The places of the k largest absolute values, from 1, negative for negative values; ties go by place.

    Repeating, a term counts k for the largest value and one less for each larger one, ties alike.
    """

    def __init__(self, k: int, repeating: bool):
        self.k, self.repeating = k, repeating

    def term_bytes(self, tbl: int, hashed: tuple[int, ...]) -> bytes:
        return int_to_bytes(hashed[0])

    def terms_of(self, term: bytes) -> list[tuple[int, tuple[int, ...]]]:
        return [(0, (int_from_bytes(term),))] if len(term) in (1, 2, 4) and self.term_bytes(0, (int_from_bytes(term),)) == term else []

    def hash_column(self, vec: Column) -> Column:
        """Sorted once; the count of larger values is where the first equal one stands."""
        pairs = F.transform(vec, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"), F.when(x >= 0, i + 1).otherwise(-1 - i).alias("h")))
        top = F.slice(F.sort_array(pairs), 1, self.k)

        def terms(ordered: Column) -> Column:
            sizes = F.transform(ordered, lambda p: p["m"])
            freq = lambda p: self.k + 1 - F.array_position(sizes, p["m"]) if self.repeating else F.lit(1)
            return F.transform(ordered, lambda p: _term(F.lit(0), F.array(p["h"]), freq(p)))

        return F.when(vec.isNotNull(), F.transform(F.array(top), terms)[0])

    def hash_block(self, vectors, probes: int = 0) -> Terms:
        import numpy as np

        v = np.asarray(vectors, np.float32)
        size = np.abs(v)
        order = np.argsort(-size, axis=1, kind="stable")[:, : self.k]
        rows = np.arange(len(v))[:, None]
        places = np.where(v[rows, order] >= 0, order + 1, -1 - order)
        freq = None
        if self.repeating:  # larger ones stand before the first that is equal
            top = size[rows, order]
            starts = np.concatenate([np.ones((len(v), 1), bool), top[:, 1:] < top[:, :-1]], axis=1)
            freq = self.k - np.maximum.accumulate(np.where(starts, np.arange(top.shape[1]), 0), axis=1)
        return Terms.regular(places[:, :, None], np.zeros(places.shape, int), freq)


@lru_cache(maxsize=64)
def model_of(mapping: Mapping) -> HashModel:
    """The model of a mapping; exact mappings have none."""
    if isinstance(mapping, JaccardLsh):
        return MinHash(mapping.L, mapping.k)
    if isinstance(mapping, HammingLsh):
        return BitSampling(mapping.dims, mapping.L, mapping.k)
    if isinstance(mapping, CosineLsh):
        return Hyperplanes(mapping.dims, mapping.L, mapping.k)
    if isinstance(mapping, L2Lsh):
        return StableDistributions(mapping.dims, mapping.L, mapping.k, mapping.w)
    if isinstance(mapping, PermutationLsh):
        return Permutation(mapping.k, mapping.repeating)
    raise VectorError(f"Mapping [{mapping}] has no hashes")
