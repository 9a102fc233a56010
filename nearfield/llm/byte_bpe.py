"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are split into pre-tokens with their positions. A block of documents keeps its texts as sequences of word
   numbers, so what is shuffled is each distinct word of a block, with the block that it goes back to.
2. Words meet by hash bucket. A task encodes each distinct word of its bucket once, as long as it remembers it.
3. The ids go back to the blocks, where they take the words' positions again.

Blocks stand for the rows that an explode would make, one for each pre-token with its document and position: as rows
those take several times the input on disk, where blocks take about once the entropy of the words (README has figures).
A block is BLOCK_BYTES of text or one longer text; a bucket has about as many distinct words as others, since a word
counts once a block however frequent it is. There are as many buckets as the input's size asks for, and a task remembers
at most twice REMEMBERED words; one that comes again after that is encoded again. Decoding looks ids up in the token-byte
table of the rank file, which is as large as the vocabulary, whatever the input, and so is broadcast.

Null texts encode like empty ones, to no ids. Texts of any length are encoded whole, each in one worker. Rows are encoded
one by one, so repeated doc_ids are fine. Only the two named columns of docs are read, whatever the names of others. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Bucketed, parts_for

BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 5000
#: Words that a task remembers the ids of, twice.
REMEMBERED = 400_000


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def _squeeze(numbers) -> bytes:
    """Whole numbers below 2^32, of which most are small: all lowest bytes, then all second ones and so on."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unsqueeze(packed: bytes):
    import numpy as np
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(parts: list[bytes]) -> bytes:
    """The size of the lengths, the lengths, and the bytes."""
    import numpy as np
    import zstandard

    lengths = _squeeze(np.fromiter(map(len, parts), "<u4", len(parts)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(parts), 1)


def _unpack(packed: bytes) -> list[bytes]:
    import numpy as np
    import zstandard

    at = 4 + int.from_bytes(packed[:4], "little")
    ends = np.cumsum(_unsqueeze(packed[4:at]), dtype=np.int64).tolist()
    raw = zstandard.decompress(packed[at:])
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _pack_ids(ids: list[bytes]) -> bytes:
    """Ids of 4 bytes each: their numbers as _pack() has lengths, then all ids."""
    import numpy as np

    lengths = _squeeze([len(x) // 4 for x in ids])
    return len(lengths).to_bytes(4, "little") + lengths + _squeeze(np.frombuffer(b"".join(ids), "<u4"))


def _unpack_ids(packed: bytes) -> list[bytes]:
    """Each array as 4 bytes an id."""
    import numpy as np

    at = 4 + int.from_bytes(packed[:4], "little")
    ends = (4 * np.cumsum(_unsqueeze(packed[4:at]), dtype=np.int64)).tolist()
    raw = _unsqueeze(packed[at:]).tobytes()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _blocks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """A row for each block, whose words are the buckets of its words in order, and one for each bucket that it has."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(docs.schema[0].dataType)), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType()),
    ])
    kind = pa.list_(to_arrow_type(docs.schema[0].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        import numpy as np
        from pyspark import TaskContext

        split, base, n = _splitter(pattern).findall, TaskContext.get().partitionId() << 32, 0
        out = {k: pa.field(k, t) for k, t in (("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("doc_ids", kind), ("counts", pa.list_(pa.int32())), ("places", pa.binary()))}

        def block(ids: list, texts: list[str]) -> pa.RecordBatch:
            number: dict[str, int] = {}
            places = [np.fromiter((number.setdefault(w, len(number)) for w in split(t)), np.uint32) for t in texts]
            flat = np.concatenate(places)
            # Words are numbered by how often they come; a bucket's list has its words in that order.
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            rank = np.empty(len(number), np.uint32)
            rank[order] = np.arange(len(number), dtype=np.uint32)
            names = [w.encode() for w in number]
            lists: dict[int, list[bytes]] = {}
            for k in order.tolist():
                lists.setdefault(crc32(names[k]) % buckets, []).append(names[k])
            owner = [crc32(names[k]) % buckets for k in order.tolist()]
            rows = [(base + n, None, _squeeze(owner), ids, [len(p) for p in places], _squeeze(rank[flat]))]
            rows += [(base + n, k, _pack(found), None, None, None) for k, found in lists.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out.values())], list(out))

        ids: list = []
        texts: list[str] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block(ids, texts)
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield block(ids, texts)

    return docs.mapInArrow(run, schema)


def _encode_buckets(words: DataFrame, ranks: str, pattern: str, buckets: int, remembered: int = REMEMBERED) -> DataFrame:
    """block, bucket, ids: for the words of the row, in order, each word's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = _encoding(ranks, pattern).encode_ordinary
        known: dict[bytes, bytes] = {}
        older: dict[bytes, bytes] = {}
        for b in batches:
            packed = []
            for blob in b.column(2).to_pylist():
                ids = []
                for w in _unpack(blob):
                    if (found := known.get(w)) is None:
                        if len(known) >= remembered:
                            known, older = {}, known
                        found = known[w] = older.get(w) or np.array(encode(w.decode()), "<u4").tobytes()
                    ids.append(found)
                packed.append(_pack_ids(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["block", "bucket", "ids"])

    met = words.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return met.mapInArrow(run, "block long, bucket int, ids binary")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids as 4 bytes each, little-endian, as array_of_ids() reads them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    buckets = parts_for(rows)
    # Bucketed by block, so what goes back to the blocks is shuffled, not the blocks. All large fields are compressed.
    parts = Bucketed(_blocks(rows, pattern, buckets), "bpe-blocks", "block", buckets, codec="uncompressed").df
    words = parts.where("bucket IS NOT NULL").select("block", "bucket", "words")
    encoded = _encode_buckets(words, ranks, pattern, buckets)
    texts = parts.where("bucket IS NULL").select("block", "words", "doc_ids", "counts", "places")

    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def rebuild(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        lists = {k: iter(_unpack_ids(blob)) for k, blob in zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist())}
        ids, texts = [], []
        for owner, some, counts, places in zip(*(left.column(c).to_pylist() for c in ("words", "doc_ids", "counts", "places"))):
            known = [next(lists[k]) for k in _unsqueeze(owner).tolist()]
            flat, at = _unsqueeze(places).tolist(), 0
            for n in counts:
                texts.append(b"".join([known[p] for p in flat[at : at + n]]))
                at += n
            ids += some
        return pa.table({"doc_id": pa.array(ids, kind), "ids": pa.array(texts, pa.binary())})

    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    return texts.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(rebuild, schema)


def array_of_ids(packed: bytes):
    import numpy as np

    return np.frombuffer(packed, "<u4")


class _Decoder:
    """Ids to bytes by the token-byte table, which is as large as the vocabulary and broadcast."""

    def __init__(self, spark, ranks: str):
        self._table = spark.sparkContext.broadcast({i: b for b, i in load_ranks(ranks).items()})

    def __call__(self, packed: bytes) -> bytes:
        return b"".join(map(self._table.value.__getitem__, array_of_ids(packed).tolist()))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids stand for. An id that the table lacks is an error."""
    one = _Decoder(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(one, b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the ids as decimals joined by commas, decoded_sha256 of what they decode to."""
    one = _Decoder(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        decimal = [str(i) for i in range(max(load_ranks(ranks).values()) + 1)]
        for b in batches:
            n, hashed, whole = [], [], []
            for x in b.column(1).to_pylist():
                ids = array_of_ids(x).tolist()
                n.append(len(ids))
                hashed.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                whole.append(sha256(one(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(whole, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([encoded.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return encoded.mapInArrow(run, schema)
