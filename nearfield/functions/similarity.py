"""Similarity scores of two vector columns, as Column expressions and, for blocks of vectors, in NumPy.

All are at least 0, and larger means closer. Elements of dense vectors are subtracted and multiplied as floats and
summed as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import VectorError
from ..vectors import DenseFloat, Similarity, SparseBool


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda total, x: total + x)


def _once(*values: Column, body) -> Column:
    """body(*values), each evaluated once a row."""
    packed = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.transform(packed, lambda s: body(*(s[f"v{i}"] for i in range(len(values)))))[0]


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x * y).cast("double"))


def l1(a: Column, b: Column) -> Column:
    return 1 / (1 + _sum(a, b, lambda x, y: F.abs(x - y).cast("double")))


def l2(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(_sum(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))))


def size_of(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, sizes: Column | None = None) -> Column:
    """1 + the cosine; of zero vectors, 2 for two that are equal, else 0. sizes: the product of both sizes, if known."""
    sizes = size_of(a) * size_of(b) if sizes is None else sizes
    return _once(sizes, a, b, body=lambda s, x, y: F.when(s > 0, 1 + dot(x, y) / s).when(x == y, 2.0).otherwise(0.0))


def common_indices(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["true_indices"], b["true_indices"]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two empty vectors 1."""
    n = F.size(a["true_indices"]) + F.size(b["true_indices"])
    return _once(common_indices(a, b), n, body=lambda i, n: F.when(n == 0, 1.0).otherwise(i.cast("double") / (n - i)))


def hamming(a: Column, b: Column) -> Column:
    """a is the query: the share of its total indices at which both agree."""
    total = a["total_indices"]
    differ = F.size(a["true_indices"]) + F.size(b["true_indices"]) - 2 * common_indices(a, b)
    return (total - differ).cast("double") / total


_OF = {Similarity.L1: l1, Similarity.L2: l2, Similarity.COSINE: cosine, Similarity.JACCARD: jaccard, Similarity.HAMMING: hamming}


def similarity(kind: Similarity | str, query: Column, stored: Column, normal: bool = False) -> Column:
    """normal: the indices of sparse queries are sorted and distinct already, as those of stored vectors are."""
    kind = Similarity.of(kind)
    return _OF[kind](sorted_sparse(query) if kind.sparse and not normal else query, stored)


def sorted_sparse(v: Column) -> Column:
    """The vector with sorted, distinct indices."""
    return F.when(v.isNotNull(), F.struct(F.array_sort(F.array_distinct(v["true_indices"])).alias("true_indices"), v["total_indices"].alias("total_indices")))


def unit(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    return _once(F.sqrt(dot(v, v)), v, body=lambda s, x: F.when(s > 0, F.transform(x, lambda e: (e / s).cast("float"))).otherwise(x))


def literal(v: DenseFloat | SparseBool) -> Column:
    """The vector as a constant."""
    if isinstance(v, DenseFloat):
        return F.lit(list(v.values)).cast("array<float>") if v.values else F.array().cast("array<float>")
    if isinstance(v, SparseBool):
        indices = F.lit(list(v.true_indices)).cast("array<int>") if v.true_indices else F.array().cast("array<int>")
        return F.struct(indices.alias("true_indices"), F.lit(v.total_indices).alias("total_indices"))
    raise VectorError(f"Expected a literal vector but got [{v}]")


def block_scores(kind: Similarity, queries, stored):
    """Scores of all queries (rows) with all stored vectors (columns), for matrices with a row for each vector.

    Dense ones are float matrices; sparse ones 0/1 matrices as wide as the total indices.
    """
    import numpy as np

    q, s = np.asarray(queries, np.float64), np.asarray(stored, np.float64)
    if kind is Similarity.L1:
        return 1 / (1 + np.stack([np.abs(s - x).sum(axis=1) for x in q])) if len(q) else np.zeros((0, len(s)))
    products = q @ s.T
    if kind is Similarity.L2:
        squares = (q * q).sum(axis=1)[:, None] + (s * s).sum(axis=1)[None] - 2 * products
        return 1 / (1 + np.sqrt(np.maximum(squares, 0)))
    if kind is Similarity.COSINE:
        sizes = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((s * s).sum(axis=1))[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1 + products / sizes
        zero = sizes == 0
        if zero.any():
            both = ~q.any(axis=1)[:, None] & ~s.any(axis=1)[None]
            out = np.where(zero, np.where(both, 2.0, 0.0), out)
        return out
    counts = q.sum(axis=1)[:, None] + s.sum(axis=1)[None]
    if kind is Similarity.JACCARD:
        either = counts - products
        return np.where(either == 0, 1.0, products / np.maximum(either, 1))
    return (q.shape[1] - counts + 2 * products) / q.shape[1]


def row_scores(kind: Similarity, query, stored):
    """Scores of one query, or of a dense query for each row, with the rows of a matrix, with the arithmetic of the
    Column expressions."""
    import numpy as np

    q, s = np.asarray(query, np.float32), np.asarray(stored, np.float32)
    total = lambda x: x.astype(np.float64).sum(axis=-1)
    if kind is Similarity.L1:
        return 1 / (1 + total(np.abs(s - q)))
    if kind is Similarity.L2:
        return 1 / (1 + np.sqrt(((s - q).astype(np.float64) ** 2).sum(axis=-1)))
    if kind is Similarity.COSINE:
        sizes = np.sqrt(total(q * q)) * np.sqrt(total(s * s))
        equal = (s == q).all(axis=-1)
        return np.where(sizes == 0, np.where(equal, 2.0, 0.0), 1 + total(s * q) / np.where(sizes == 0, 1, sizes))
    return block_scores(kind, q[None], s)[0]


#: What a float is off by at most, as a share.
FLOAT = 2.0**-24


class DenseScan:
    """A block of stored vectors, prepared to find for many queries the rows that may score at least a cut."""

    #: Steps that coordinates are rounded to for l1, so that four differences fit in a byte.
    LEVELS = 63

    def __init__(self, kind: Similarity, stored):
        import numpy as np

        self.kind, self.rows, self.odd = kind, stored, None
        x = stored.astype(np.float64)
        with np.errstate(all="ignore"):
            if kind is Similarity.L2:
                self.centre = x.mean(axis=0)
                x -= self.centre
                sizes = (x * x).sum(axis=1)
                self.most, self.right = sizes.max(initial=0), np.concatenate([x, -sizes[:, None] / 2], axis=1).T.astype(np.float32, order="C")
            elif kind is Similarity.COSINE:
                x, self.zero, odd = self._units(x)
                self.right = x.T.astype(np.float32, order="C")
                self.odd = odd if odd.any() else None
            else:
                self._levels(x)

    @staticmethod
    def _units(x):
        """(rows of length 1; those that are zero; those whose products as floats are not to be relied on)"""
        import numpy as np

        most = np.abs(x).max(axis=1, initial=0)
        odd = ~((most == 0) | (most > 1e-15) & (most < 1e15))
        size = np.sqrt((x * x).sum(axis=1))
        return np.where(odd[:, None], 0, x) / np.where((size > 0) & ~odd, size, 1)[:, None], most == 0, odd

    def _levels(self, x):
        import numpy as np

        n, dims = x.shape
        odd = ~np.isfinite(x).all(axis=1)
        self.odd = odd if odd.any() else None
        x = np.where(odd[:, None], 0, x)
        self.centre = x.mean(axis=0) if n else np.zeros(dims)
        away = np.abs(x - self.centre)
        self.half = min(away.max(initial=0), 4.5 * np.sqrt((away**2).mean())) if x.size else 0.0
        self.levels = min(self.LEVELS, 65535 // max(1, dims))
        self.step = 2 * self.half / self.levels if self.half > 0 and self.levels and np.isfinite(self.half) else 0.0
        if self.step > 0:
            codes, wrong = self._codes(x)
            self.wrong = wrong.max(initial=0)
            self.codes = np.zeros((-(-dims // 4) * 4, n + n % 2), np.int8)
            self.codes[:dims, :n] = codes.T

    def _codes(self, x):
        """(numbers of steps; the sum of what each row, cut to the range of the steps, differs from those)"""
        import numpy as np

        x = np.clip(x - self.centre, -self.half, self.half) + self.half
        codes = np.rint(x / self.step)
        return codes.astype(np.int8), np.abs(x - codes * self.step).sum(axis=1)

    def near(self, queries, cut):
        """Whether each stored row (columns) may score at least the query's cut (rows), as row_scores() counts."""
        import numpy as np

        q, dims = queries.astype(np.float64), queries.shape[1]
        with np.errstate(all="ignore"):
            if self.kind is Similarity.COSINE:
                units, zero, odd = self._units(q)
                scores = units.astype(np.float32) @ self.right
                if self.zero.any():
                    scores[:, self.zero] = -1
                if zero.any():
                    scores[zero] = np.where(self.zero, 1.0, -1.0)
                out = ~(scores < (cut - 1 - 1e-6 - (dims + 8) * FLOAT).astype(np.float32)[:, None])
            else:
                far = (1 / cut - 1) * (1 + 1e-6) + 1e-15
                if self.kind is Similarity.L2:
                    q -= self.centre
                    sizes = (q * q).sum(axis=1)
                    products = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(np.float32) @ self.right
                    least = (sizes - far * far) / 2 - 2 * (dims + 16) * FLOAT * (sizes + self.most)
                    return ~(products < (least - FLOAT * np.abs(least)).astype(np.float32)[:, None])
                odd = ~np.isfinite(q).all(axis=1)
                out = self._near_l1(np.where(odd[:, None], 0, q), far)
        if odd.any():
            out[odd] = True
        if self.odd is not None:
            out[:, self.odd] = True
        return out

    def _near_l1(self, q, far):
        """A sum of differences of steps is at most the distance, but for what the rounding of both sides may add."""
        import numpy as np

        n = len(self.rows)
        if not self.step > 0:
            return np.ones((len(q), n), bool)
        codes, wrong = self._codes(q)
        most = np.minimum((far + wrong + self.wrong) * (1 + 1e-9) / self.step + 1e-6, 65535).astype(np.uint16)
        wide = np.zeros((len(q), len(self.codes)), np.int8)
        wide[:, : codes.shape[1]] = codes
        cells = np.empty(self.codes.shape, np.int8)
        fours = cells.view(np.uint8).reshape(4, -1, self.codes.shape[1])
        sums, out = np.empty(fours.shape[1:], np.uint8), np.empty((len(q), self.codes.shape[1]), bool)
        twos = sums.view("<u2")
        low = np.empty_like(twos)
        for i in range(len(q)):
            np.subtract(self.codes, wide[i][:, None], out=cells)
            np.abs(cells, out=cells)
            np.add(fours[0], fours[1], out=sums)
            np.add(sums, fours[2], out=sums)
            np.add(sums, fours[3], out=sums)
            np.bitwise_and(twos, 255, out=low)
            np.less_equal(low.sum(axis=0, dtype=np.uint16), most[i], out=out[i, ::2])
            np.right_shift(twos, 8, out=low)
            np.less_equal(low.sum(axis=0, dtype=np.uint16), most[i], out=out[i, 1::2])
        return out[:, :n]

    def scores(self, queries, which, some, many: bool = False):
        """row_scores() of the pairs."""
        import numpy as np

        parts = (row_scores(self.kind, queries[which[i : i + 1024]], self.rows[some[i : i + 1024]]) for i in range(0, len(which), 1024))
        return np.concatenate([np.zeros(0), *parts])


class SparseScan:
    """What DenseScan does, for sparse blocks. Those up to a width are multiplied as matrices; of wider ones the indices
    that most rows have are, and the others' equal pairs are counted."""

    #: Indices of a wide block that are multiplied at most, and the share of rows that have one of those at least.
    HEAVY, SHARE = 512, 1 / 64

    def __init__(self, kind: Similarity, stored, narrow: int):
        import numpy as np

        self.kind, self.rows = kind, stored
        self.lengths, self.asked = stored.lengths.astype(np.float32), (None, None)
        self.width = 1 + int(stored.indices.max(initial=-1))
        self.bits = stored.matrix(self.width) if self.width <= narrow else None
        if self.bits is not None:
            self.right = np.ascontiguousarray(np.concatenate([self.bits, self.lengths[:, None]], axis=1).T)
        else:
            found, times = np.unique(stored.indices, return_counts=True)
            most = np.argsort(-times, kind="stable")[: self.HEAVY]
            self.heavy = np.sort(found[most[times[most] >= self.SHARE * len(self.lengths)]])
            at, heavy = self._heavy(stored)
            self.right = np.zeros((len(self.heavy), len(self.lengths)), np.float32)
            self.right[at[heavy], stored.owners()[heavy]] = 1
            order = np.argsort(stored.indices[~heavy], kind="stable")
            self.keys, self.owners = stored.indices[~heavy][order], stored.owners()[~heavy][order]

    def _heavy(self, block):
        """(of each index the place among the heavy ones; whether it is one)"""
        import numpy as np

        at = np.searchsorted(self.heavy, block.indices)
        some = np.zeros(len(at), bool)
        some[at < len(self.heavy)] = self.heavy[at[at < len(self.heavy)]] == block.indices[at < len(self.heavy)]
        return at, some

    def _common(self, queries):
        """How many indices each query shares with each stored row of a wide block; kept until other queries come."""
        import numpy as np

        from ..operators.blocks import equal_pairs

        if self.asked[0] is queries:
            return self.asked[1]
        at, heavy = self._heavy(queries)
        n, m, owners = len(queries.lengths), len(self.lengths), queries.owners()
        bits = np.zeros((n, len(self.heavy)), np.float32)
        bits[owners[heavy], at[heavy]] = 1
        out, asked, mine = bits @ self.right, queries.indices[~heavy], owners[~heavy]
        first = np.searchsorted(self.keys, asked, "left")
        for i, at in equal_pairs(first, np.searchsorted(self.keys, asked, "right") - first):
            out += np.bincount(mine[i] * m + self.owners[at], minlength=n * m).reshape(n, m)
        self.asked = queries, out
        return out

    def _bits(self, queries, more: int = 0):
        import numpy as np

        ok = queries.indices < self.width
        out = np.zeros((len(queries.lengths), self.width + more), np.float32)
        out[queries.owners()[ok], queries.indices[ok]] = 1
        return out

    def near(self, queries, cut):
        import numpy as np

        lengths = queries.lengths.astype(np.float64)
        # Rows may do whose common indices, less each times their length, are at least these.
        if self.kind is Similarity.JACCARD:
            each = cut / (1 + cut) * (1 - 1e-9)
            least = each * lengths
        else:
            totals = queries.totals.astype(np.float64)
            each, least = np.full(len(lengths), 0.5), (cut * totals - totals + lengths) / 2
        each, most = each.astype(np.float32), self.lengths.max(initial=0)
        least = (least - 0.01 - 1e-6 * (np.abs(least) + most)).astype(np.float32)[:, None]
        if self.bits is None:
            return ~(self._common(queries) - each[:, None] * self.lengths < least)
        wide = self._bits(queries, 1)
        wide[:, -1] = -each
        return ~(wide @ self.right < least)

    def scores(self, queries, which, some, many: bool = False):
        """many: all pairs of these queries are about to be looked at."""
        import numpy as np

        if self.bits is None and (many or self.asked[0] is queries):
            common = self._common(queries)[which, some].astype(np.float64)
        elif self.bits is None:
            common = queries.pair_common(self.rows, which, some).astype(np.float64)
        else:
            bits, size = self._bits(queries), max(1, (1 << 18) // max(1, self.width))
            common = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", bits[which[i : i + size]], self.bits[some[i : i + size]]) for i in range(0, len(which), size))])
        counts = queries.lengths[which].astype(np.float64) + self.rows.lengths[some]
        if self.kind is Similarity.JACCARD:
            either = counts - common
            return np.where(either == 0, 1.0, common / np.maximum(either, 1))
        total = queries.totals[which].astype(np.float64)
        return (total - (counts - 2 * common)) / total
