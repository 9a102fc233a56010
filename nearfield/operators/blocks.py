"""Vectors packed into blocks: one row holds a matrix, so that NumPy scores or hashes many vectors at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.hashing import TERMS, HashModel
from ..functions.similarity import row_scores, similarity
from ..vectors import Similarity

#: Steps of hashing a vector from which NumPy takes over from expressions, which run a lambda for each step. Both multiply
#: floats and add them up as doubles, in expressions each product as a float first; a vector that lies on a border to the
#: last digit can have another bucket by the one than by the other.
STEPS = 256
#: Widths up to which sparse blocks are multiplied as matrices, and equal pairs of indices that are counted at a time.
NARROW, PAIRS = 4096, 1 << 22


def dense_matrix(column: pa.Array):
    """The rows of a list column without nulls, all of one length, as a float matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


class SparseBlock:
    """Sparse vectors as their total indices, how many true ones each has, and all of those in order."""

    def __init__(self, totals, lengths, indices):
        self.totals, self.lengths, self.indices = totals, lengths, indices

    @classmethod
    def of(cls, column: pa.Array) -> SparseBlock:
        """The rows of a struct column without nulls; indices that a row repeats count once."""
        import numpy as np

        lists = column.field("true_indices")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        keys = (np.repeat(np.arange(len(lengths)), lengths) << 32) | lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(keys) > 1 and not (keys[1:] > keys[:-1]).all():
            keys = np.unique(keys)
        counts = np.bincount(keys >> 32, minlength=len(lengths))
        return cls(column.field("total_indices").to_numpy(zero_copy_only=False).astype(np.int32), counts.astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32))

    def tobytes(self) -> bytes:
        return self.totals.tobytes() + self.lengths.tobytes() + self.indices.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes, rows: int) -> SparseBlock:
        import numpy as np

        x = np.frombuffer(raw, np.int32)
        return cls(x[:rows], x[rows : 2 * rows], x[2 * rows :])

    def owners(self):
        import numpy as np

        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def matrix(self, width: int):
        import numpy as np

        out = np.zeros((len(self.lengths), width), np.float32)
        out[self.owners(), self.indices] = 1
        return out

    def common(self, other: SparseBlock):
        """How many indices each row shares with each row of the other block: by a product of narrow matrices, or else by
        the pairs of equal indices, some rows at a time."""
        import numpy as np

        n, m = len(self.lengths), len(other.lengths)
        width = 1 + int(max(self.indices.max(initial=-1), other.indices.max(initial=-1)))
        if width <= NARROW:
            return self.matrix(width) @ other.matrix(width).T
        order = np.argsort(other.indices, kind="stable")
        keys, owners = other.indices[order], other.owners()[order]
        first = np.searchsorted(keys, self.indices, "left")
        times = np.searchsorted(keys, self.indices, "right") - first
        out, mine = np.zeros((n, m), np.float32), self.owners()
        for i, at in equal_pairs(first, times):
            out += np.bincount(mine[i] * m + owners[at], minlength=n * m).reshape(n, m)
        return out

    def part(self, lo: int, hi: int) -> SparseBlock:
        import numpy as np

        a, b = (int(self.lengths[:x].sum(dtype=np.int64)) for x in (lo, hi))
        return SparseBlock(self.totals[lo:hi], self.lengths[lo:hi], self.indices[a:b])

    def pair_common(self, other: SparseBlock, mine, theirs):
        """How many indices row mine[i] shares with the other block's row theirs[i]."""
        import numpy as np

        keys = (self.owners() << 32) | self.indices
        first = (np.cumsum(other.lengths, dtype=np.int64) - other.lengths)[theirs]
        out = np.zeros(len(mine), np.int64)
        if len(keys):
            for i, at in equal_pairs(first, other.lengths[theirs].astype(np.int64)):
                asked = (mine[i].astype(np.int64) << 32) | other.indices[at]
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                out += np.bincount(i[keys[place] == asked], minlength=len(mine))
        return out


def unpack(cells: bytes, rows: int, sparse: bool):
    import numpy as np

    return SparseBlock.frombytes(cells, rows) if sparse else np.frombuffer(cells, np.float32).reshape(rows, -1)


def pack(df: DataFrame, id_col: str, vec_col: str, size: int, sparse: bool, terms_col: str | None = None) -> DataFrame:
    """no long, ids array, rows int, cells binary: blocks of at most `size` vectors that aren't null, numbered; unpack()
    reads the cells. With terms_col also terms binary, for TermBlock.frombytes()."""
    terms = [F.col(terms_col).alias("terms")] if terms_col else []
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *terms)
    kind = T.ArrayType(rows.schema["id"].dataType)
    block, has_terms = SparseBlock.of if sparse else dense_matrix, bool(terms)
    schema = T.StructType([T.StructField("ids", kind), T.StructField("rows", T.IntegerType()), T.StructField("cells", T.BinaryType()), *(T.StructField("terms", T.BinaryType()) for _ in terms)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            even = -(-b.num_rows // max(1, -(-b.num_rows // size)))  # no block is a small rest
            for lo in range(0, b.num_rows, even or 1):
                some = b.slice(lo, even)
                columns = [pa.array([some.column(0).to_pylist()], to_arrow_type(kind)), pa.array([some.num_rows], pa.int32()), pa.array([block(some.column(1)).tobytes()], pa.binary())]
                if has_terms:
                    columns.append(pa.array([TermBlock.of(some.column(2)).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema).withColumn("no", F.monotonically_increasing_id())


def ids_of(cell: pa.ListScalar):
    """The ids of a block: integers as such, others as objects."""
    import numpy as np

    if pa.types.is_integer(cell.values.type) and not cell.values.null_count:
        return cell.values.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(cell.values), object)
    out[:] = cell.values.to_pylist()
    return out


def _order(ids):
    """Numbers in the order of the ids; nulls are first."""
    import numpy as np

    if ids.dtype != object:
        return ids
    place = {x: n for n, x in enumerate(sorted({x for x in ids if x is not None}))}
    return np.array([-1 if x is None else place[x] for x in ids], np.int64)


class Best:
    """Of each of n queries the k rows with the largest values, ties by id, in arrays: value (-inf where there is none; a
    value that isn't a number is larger than all), ids, and one more number of each."""

    def __init__(self, n: int, k: int, id_type):
        import numpy as np

        self.k = max(1, k)
        self.value, self.more = np.full((n, self.k), -np.inf), np.zeros((n, self.k))
        self.ids = np.full((n, self.k), None if np.dtype(id_type) == object else 0, id_type)

    def cut(self, lo: int, hi: int):
        """The last value of queries lo to hi; -inf of those that have fewer than k rows."""
        return self.value[lo:hi, -1]

    def add(self, which, value, ids, more=None) -> None:
        """Rows for queries, which needn't be in order. more: a function that gives the second number of those of the rows
        whose positions it gets; it is asked for rows that are kept."""
        import numpy as np

        value = np.where(np.isnan(value), np.inf, value)
        last = self.value[which, -1]
        able = value >= last
        if self.ids.dtype != object:
            able &= (value > last) | (ids < self.ids[which, -1])
        at = np.flatnonzero(able)
        if not len(at):
            return
        touched, old = np.unique(which[at], return_inverse=True)
        n = len(touched) * self.k
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), old])
        values = np.concatenate([self.value[touched].ravel(), value[at]])
        names = np.concatenate([self.ids[touched].ravel(), ids[at]])
        order = np.lexsort((_order(names), -values, row))
        starts = np.searchsorted(row[order], np.arange(len(touched)))
        place = np.arange(len(order)) - starts[row[order]]
        order, place = order[place < self.k], place[place < self.k]
        to, new = touched[row[order]], order >= n
        kept = np.empty(len(order))
        kept[~new] = self.more[touched].ravel()[order[~new]]
        if more is not None and new.any():
            kept[new] = more(at[order[new] - n])
        self.value[to, place], self.ids[to, place], self.more[to, place] = values[order], names[order], kept

    def found(self):
        """(queries, ids, values, second numbers), flat."""
        import numpy as np

        which, place = np.nonzero(self.value > -np.inf)
        value = self.value[which, place]
        return which, self.ids[which, place], np.where(value == np.inf, np.nan, value), self.more[which, place]


class TermBlock:
    """The terms of a block's vectors: how many each has; of each term its table, frequency, and how many numbers its hash
    has; and those numbers. A row is regular if it has one term of each table in order, once each, of equal lengths."""

    def __init__(self, counts, tbl, freq, sizes, numbers):
        import numpy as np

        self.parts = counts, tbl, freq, sizes, numbers
        self.counts, self.tbl, self.freq, self.sizes, self.numbers = self.parts
        self.L, self.k = int(counts.max(initial=0)), int(sizes.max(initial=0))
        ok = (self.freq == 1) & (self.sizes == self.k)
        first = np.cumsum(counts) - counts
        ok &= self.tbl == np.arange(len(tbl)) - np.repeat(first, counts)
        bad = np.bincount(self.owners()[~ok], minlength=len(counts))
        self.regular = (counts == self.L) & (bad == 0) & (self.L > 0)

    @classmethod
    def of(cls, column: pa.Array) -> TermBlock:
        import numpy as np

        flat = column.flatten()
        to = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int32)
        hashes = flat.field("hash")
        return cls(to(column.value_lengths()), to(flat.field("tbl")), to(flat.field("freq")), to(hashes.value_lengths()), to(hashes.flatten()))

    def tobytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.parts)

    @classmethod
    def frombytes(cls, raw: bytes, rows: int) -> TermBlock:
        import numpy as np

        x = np.frombuffer(raw, np.int32)
        n = int(x[:rows].sum())
        return cls(x[:rows], *(x[rows + i * n : rows + (i + 1) * n] for i in range(3)), x[rows + 3 * n :])

    def owners(self):
        import numpy as np

        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self):
        """Of the regular rows, in order: rows by tables by numbers."""
        import numpy as np

        of = np.repeat(np.repeat(self.regular, self.counts), self.sizes)
        return self.numbers[of].astype(np.int64).reshape(-1, self.L, self.k)

    def columns(self):
        """Of each term the table, the length and the numbers, as columns of equal width."""
        import numpy as np

        out = np.zeros((len(self.tbl), self.k + 2), np.int64)
        out[:, 0], out[:, 1] = self.tbl, self.sizes
        out[:, 2:][np.arange(self.k) < self.sizes[:, None]] = self.numbers
        return out


class Codes:
    """Short codes for the hashes of a stored block's regular rows, table by table, and for queries' equal hashes."""

    def __init__(self, stored: TermBlock):
        import numpy as np

        self.stored, self.steps, self.codes = stored, [], []
        hashes = stored.hashes()
        for t in range(stored.L if len(hashes) else 0):
            steps, key = [], hashes[:, t, 0]
            for i in range(1, stored.k):
                key, u = self._joined(key, hashes[:, t, i], None if i > 1 else ())
                steps.append(u)
            u, code = np.unique(key, return_inverse=True)
            kind = np.uint8 if len(u) < 254 else np.uint16
            all_codes = np.full(len(stored.counts), np.iinfo(kind).max - 1, kind)  # what irregular rows have
            all_codes[stored.regular] = code
            self.steps.append((steps, u, kind))
            self.codes.append(all_codes)

    @staticmethod
    def _joined(key, numbers, u):
        """A key and the next number as one key. u: the values of the key that get codes; () for what fits as it is."""
        import numpy as np

        u = np.unique(key) if u is None else u
        if len(u):
            at = np.minimum(np.searchsorted(u, key), len(u) - 1)
            key = np.where(u[at] == key, at, -1 - (1 << 31))  # no number of 32 bits
        return np.where(key < -(1 << 31), np.int64(-(1 << 62)), (key << 32) | (numbers & 0xFFFFFFFF)), u

    def of(self, asked: TermBlock) -> list:
        """The codes of another block's rows, table by table."""
        import numpy as np

        hashes = asked.hashes()
        if not self.codes or not len(hashes) or (asked.L, asked.k) != (self.stored.L, self.stored.k):
            return []
        out = []
        for t, (steps, u, kind) in enumerate(self.steps):
            key = hashes[:, t, 0]
            for i, of in enumerate(steps, 1):
                key, _ = self._joined(key, hashes[:, t, i], of)
            at = np.minimum(np.searchsorted(u, key), len(u) - 1)
            codes = np.full(len(asked.counts), np.iinfo(kind).max, kind)
            codes[asked.regular] = np.where(u[at] == key, at, np.iinfo(kind).max)
            out.append(codes)
        return out


class Hits:
    """How many terms the rows of a block of queries share with those of a stored block: each occurrence in the query
    counts the smaller of both frequencies. Regular rows are compared table by table, others by the pairs of equal terms."""

    def __init__(self, codes: Codes, asked: TermBlock):
        stored = codes.stored
        self.rows, self.stored_codes, self.asked_codes = len(stored.counts), codes.codes, codes.of(asked)
        both = bool(self.asked_codes)
        self.loose_q = ~asked.regular if both else asked.regular | True
        self.loose_s = ~stored.regular
        self.pairs = None
        if self.loose_q.any() or self.loose_s.any():
            self.pairs = self._equal(asked, stored)

    @staticmethod
    def _equal(asked: TermBlock, stored: TermBlock):
        """The codes, owners and frequencies of both sides' terms, equal terms having equal codes."""
        import numpy as np

        q, s = asked.columns(), stored.columns()
        width = max(q.shape[1], s.shape[1])
        both = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, s)])
        code = np.zeros(len(both), np.int64)
        for c in both.T:
            u, x = np.unique(c, return_inverse=True)
            code = np.unique(code * len(u) + x, return_inverse=True)[1]
        return (code[: len(q)], asked.owners(), asked.freq), (code[len(q) :], stored.owners(), stored.freq)

    def of(self, lo: int, hi: int):
        """Of queries lo to hi (rows) with all stored rows (columns)."""
        import numpy as np

        out = np.zeros((hi - lo, self.rows), np.uint8 if len(self.stored_codes) < 255 else np.int32)
        same = np.empty(out.shape, bool)
        for q, s in zip(self.asked_codes, self.stored_codes):
            np.equal(q[lo:hi, None], s, out=same)
            np.add(out, same.view(np.uint8), out=out)
        if self.pairs is not None:
            out = out.astype(np.int64)
            (q_code, q_owner, q_freq), s_terms = self.pairs
            here = (q_owner >= lo) & (q_owner < hi)
            loose = self.loose_q[q_owner]
            self._add(out, [x[here & loose] for x in (q_code, q_owner, q_freq)], s_terms, lo)
            of = self.loose_s[s_terms[1]]
            self._add(out, [x[here & ~loose] for x in (q_code, q_owner, q_freq)], [x[of] for x in s_terms], lo)
        return out

    @staticmethod
    def _add(out, asked, stored, lo: int) -> None:
        import numpy as np

        (q_code, q_owner, q_freq), (s_code, s_owner, s_freq) = asked, stored
        if not len(q_code) or not len(s_code):
            return
        order = np.argsort(s_code, kind="stable")
        s_code, s_owner, s_freq = s_code[order], s_owner[order], s_freq[order]
        first = np.searchsorted(s_code, q_code, "left")
        for mine, theirs in equal_pairs(first, np.searchsorted(s_code, q_code, "right") - first):
            at = (q_owner[mine] - lo) * out.shape[1] + s_owner[theirs]
            out += np.bincount(at, np.minimum(q_freq[mine], s_freq[theirs]), out.size).astype(np.int64).reshape(out.shape)


def equal_pairs(first, times) -> Iterator[tuple]:
    """(i, first[i] + j) for each i and each j under times[i], as two arrays, about PAIRS at a time."""
    import numpy as np

    upto, lo = np.concatenate([[0], np.cumsum(times)]), 0
    while lo < len(times):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        some = times[lo:hi]
        yield np.repeat(np.arange(lo, hi), some), np.arange(int(some.sum())) + np.repeat(first[lo:hi] - (upto[lo:hi] - upto[lo]), some)
        lo = hi


def with_terms(df: DataFrame, vec_col: str, model: HashModel, into: str = "terms", probes: int = 0) -> DataFrame:
    """df with one more column: the terms of each vector. Small models hash in the JVM, large ones and probes in NumPy."""
    import numpy as np

    if not probes and model.steps <= STEPS:
        return df.withColumn(into, model.hash_column(F.col(vec_col)))
    at = df.columns.index(vec_col)
    schema = T.StructType([*df.schema, T.StructField(into, T._parse_datatype_string(TERMS))])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            real = column.filter(column.is_valid())
            lists = real.field("true_indices") if model.sparse else None
            vectors = (lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)) if model.sparse else dense_matrix(real)
            terms = model.hash_block(vectors, probes).arrow()
            if len(real) < len(column):
                ok = column.is_valid().to_numpy(zero_copy_only=False)
                terms = terms.take(pa.array(np.cumsum(ok) - 1, pa.int64(), mask=~ok))
            yield pa.RecordBatch.from_arrays([*b.columns, terms.cast(arrow.field(into).type)], schema=arrow)

    return df.mapInArrow(run, schema)


def with_pair_scores(df: DataFrame, kind: Similarity, query_col: str, vec_col: str, into: str = "score") -> DataFrame:
    """df with the score of each row's two vectors, which aren't null; sparse ones, whose indices are sorted and distinct,
    by an expression."""
    if kind.sparse:
        return df.withColumn(into, similarity(kind, F.col(query_col), F.col(vec_col), normal=True))
    q_at, v_at = df.columns.index(query_col), df.columns.index(vec_col)
    schema = T.StructType([*df.schema, T.StructField(into, T.DoubleType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = row_scores(kind, dense_matrix(b.column(q_at)), dense_matrix(b.column(v_at))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema=arrow)

    return df.mapInArrow(run, schema)
