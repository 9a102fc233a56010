"""Packing along a space-filling curve.

1. Documents are tokenised; the hashed counts of their ids are projected to DIMENSIONS numbers, and those are a cell
   of a grid whose place on the Hilbert curve is the document's key.
2. The curve is cut into 2^CELL_BITS cells, whose sums of tokens give ranges of cells with about as many tokens each:
   the parts. A cell that alone holds more is cut by FINER more bits of the key, down to whole keys; rows of one key lie in
   the order of doc_id's hash, and a key that alone holds more is split by it. Each part is sorted in one task, and
   the parts' sums give where each begins. So the order doesn't depend on how many parts there are.
3. Tokens are cut wherever a sequence ends, so the sequences hold neighbours on the curve and are full. What is left
   at the end is cut into sequences of powers of two, which need no padding.

Null texts are empty: they hold the end token alone. Texts of any length are tokenised whole, each in one worker, and cut
into as many pieces as sequences they reach into. Rows are packed one by one, so repeated doc_ids are fine; rows of one
key and one doc_id lie in one part. Only the two named columns of docs are read, whatever the names of others. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stash, hash_place, let, lingering, parts_for

SEQUENCE, END_ID = 4096, 2
DIMENSIONS, BITS, BUCKETS = 4, 10, 256
#: Of the key's bits, those of a cell and those that each cut of a heavy cell adds; and the parts that a task of the
#: shuffle gets, so that tasks are even.
CELL_BITS, FINER, PARTS_A_TASK = 16, 8, 4
#: Texts that are tokenised at a time.
SLICE_ROWS, SLICE_BYTES = 2500, 8 << 20
#: Words that a worker remembers the ids of, twice.
REMEMBERED = 400_000


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A character that makes a token of its own, to tell joined words apart.
MARK = b"\x01"
#: A word of Latin letters, each one character in every normal form that composes, and marks after it.
PLAIN = r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([^\s\w'\x00-\x20\x7f-\U0010ffff]*)"
#: The normalizers and the pattern of tokenizers in which such a word is one piece and its marks another.
LETTERS_APART = ({"NFC", "Replace", "Lowercase"}, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Texts to ids, each id as a fixed number of bytes.

    Tokenizers of the form LETTERS_APART drop white space, so the ids of a text are those of its words in order. Only
    ASCII white space splits words here, as it never is part of a token. Words are remembered in two generations of about
    `remembered` each; when the younger is full, the older goes. A plain word's letters go straight to the model,
    lower-cased, and its marks are another piece. Other new words are encoded many at a time, as one text with marks
    between them.

    Other tokenizers get whole texts.
    """

    def __init__(self, path: str, kind: str, remembered: int = REMEMBERED):
        import json
        import re

        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.kind, self.remembered = _tokenizer(path), kind, remembered
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 2 if kind == "<u2" else 4
        self.mark = self._ids(MARK)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        normal, split = (form.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
        steps = [x.get("pattern", {}).get("Regex") for x in split.get("pretokenizers", []) if x["type"] == "Split"]
        self.plain = None
        if {x["type"] for x in normal.get("normalizers", [])} == LETTERS_APART[0] and steps == [LETTERS_APART[1]]:
            self.plain, self.model = re.compile(PLAIN).fullmatch, self.tokenizer.model.tokenize
            spelt = ByteLevel(add_prefix_space=False, use_regex=False)
            self.spelling = {c: spelt.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}

    def _ids(self, text: bytes):
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.kind)

    def _learn_plain(self, new: list[bytes]) -> list[bytes]:
        """The words that aren't plain; the others are known after this."""
        import sys
        from array import array

        known, older, plain, model, spelling, code = self.known, self.older, self.plain, self.model, self.spelling, "H" if self.size == 2 else "I"
        rest = []
        for w in new:
            if (m := plain(w.decode())) is None:
                rest.append(w)
                continue
            letters, marks = m.groups()
            lower = letters.lower()
            ids = known.get(stem := lower.encode()) or older.get(stem)
            if ids is None:
                found = array(code, [t.id for t in model(lower if lower.isascii() else lower.translate(spelling))])
                if sys.byteorder == "big":
                    found.byteswap()
                ids = known[stem] = found.tobytes()
            if marks:
                tail = known.get(key := marks.encode()) or older.get(key)
                if tail is None:
                    tail = known[key] = self._ids(key).tobytes()
                ids += tail
            known[w] = ids
        return rest

    def _learn(self, new: list[bytes]) -> None:
        import numpy as np

        new = self._learn_plain(new)
        joined = [w for w in new if MARK not in w] if len(self.mark) == 1 else []
        size = self.size
        for i in range(0, len(joined), 2000):
            some = joined[i : i + 2000]
            ids = self._ids((b" " + MARK + b" ").join(some))
            cuts = (np.flatnonzero(ids == self.mark[0]) * size).tolist()
            raw = ids.tobytes()
            self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *(c + size for c in cuts)], [*cuts, len(raw)]))))
        if len(joined) < len(new):
            self.known.update((w, self._ids(w).tobytes()) for w in new if w not in self.known)

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            if len(self.known) + len(missing) > self.remembered:
                self.older, self.known = self.known, {}
            again = {w: self.older[w] for w in (words[i] for i in missing) if w in self.older}
            self.known |= again | {b"": b""}
            self._learn([w for w in (words[i] for i in missing) if w and w not in again])
            for i in missing:
                found[i] = self.known[words[i]]
        return found

    def __call__(self, texts: pa.Array):
        """(all ids of the texts in order, how many each text has)."""
        import numpy as np
        import pyarrow.compute as pc

        if self.plain is None:
            found = [self._ids(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
            return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(x) for x in found], np.int64)
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy(zero_copy_only=False)
        ids = self._ids_of(words.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.size
        first, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), self.kind)
        # Of each word in turn the run of its ids.
        many = sizes[which]
        upto = np.concatenate([[0], np.cumsum(many)])
        ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        return flat[np.arange(upto[-1]) + np.repeat(first[which] - upto[:-1], many)], np.diff(upto[ends])


def hilbert(cells, bits: int = BITS):
    """The place on the Hilbert curve of each row of cells, whose columns are the axes (Skilling's transform)."""
    import numpy as np

    x = np.array(cells, np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most SLICE_ROWS rows and SLICE_BYTES bytes, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        most = (ends[lo - 1] if lo else 0) + SLICE_BYTES
        hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(ends, most, "right"))))
        yield lo, hi
        lo = hi


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, key, n_tokens, ids (4 bytes each, little-endian; 2 where the vocabulary allows)."""
    kind = _width(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One of a worker: tasks that follow in it know the words of those before.
        with lingering(WordEncoder, tokenizer, kind) as encode:
            yield from encoded(batches, encode)

    def encoded(batches: Iterator[pa.RecordBatch], encode: WordEncoder) -> Iterator[pa.RecordBatch]:
        import numpy as np

        axes = np.random.default_rng(0).standard_normal((BUCKETS, DIMENSIONS))
        for b in batches:
            texts = b.column(1)
            for lo, hi in _slices(texts):
                ids, lengths = encode(texts.slice(lo, hi - lo))
                n = hi - lo
                places = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
                hashed = np.bincount(np.repeat(np.arange(n) * BUCKETS, lengths) + places, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(float)
                length = np.linalg.norm(hashed, axis=1, keepdims=True)
                spread = (hashed / np.maximum(length, 1)) @ axes
                cells = np.clip((1 << BITS) * (0.5 + np.arctan(spread) / np.pi), 0, (1 << BITS) - 1).astype(np.int64)
                ends = np.cumsum(lengths + 1)
                full = np.full(len(ids) + n, end_id, kind)
                inside = np.ones(len(full), bool)
                inside[ends - 1] = False
                full[inside] = ids
                offsets = np.concatenate([[0], ends * full.itemsize]).astype(np.int32)
                whole = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(hilbert(cells)), pa.array(lengths + 1), whole], ["doc_id", "key", "n_tokens", "ids"])

    schema = T.StructType([docs.schema[0], T.StructField("key", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _ranges(cells: list[tuple], target: int) -> list[tuple]:
    """(cell, first part, its parts) for (cell, tokens) in the order of the curve."""
    out, part, held = [], 0, 0
    for cell, tokens in cells:
        if held and held + tokens > target:
            part, held = part + 1, 0
        parts = max(1, -(-tokens // target))
        out.append((cell, part, parts))
        part, held = (part + parts, 0) if parts > 1 else (part, held + tokens)
    return out


def _parted(table: DataFrame, wanted: int) -> DataFrame:
    """table with part: parts follow each other in the order of key, and of doc_id's hash within a key."""
    spark, all_bits = table.sparkSession, DIMENSIONS * BITS

    def cell(bits: int) -> Column:
        return F.shiftright("key", all_bits - bits)

    leaves, heavy, target, bits = [], None, 0, CELL_BITS
    while True:
        rows = table.select("key", "n_tokens")
        if heavy is not None:
            rows = rows.join(F.broadcast(spark.createDataFrame(heavy, "_cell long")), cell(bits - FINER) == F.col("_cell"), "left_semi")
        # At most 2^CELL_BITS rows at first, and then 2^FINER for each of fewer than `wanted` heavy cells.
        found = list(map(tuple, rows.groupBy(cell(bits).alias("_cell")).agg(F.sum("n_tokens")).collect()))
        target = target or max(1, -(-sum(t for _, t in found) // wanted))
        more = {c for c, t in found if t > target and bits < all_bits}
        leaves += [((c << (all_bits - bits), bits, c), t) for c, t in found if c not in more]
        if not more:
            break
        heavy, bits = [(c,) for c in more], bits + FINER
    # Of each cell, where its ranges begin; leaves that follow each other in a part are one range.
    cells: dict[int, list[tuple]] = {}
    for (start, _, _), first, parts in _ranges(sorted(leaves), target):
        ranges = cells.setdefault(start >> (all_bits - CELL_BITS), [])
        if not ranges or parts > 1 or ranges[-1][1:] != (first, 1):
            ranges.append((start, first, parts))
    known = spark.createDataFrame(list(cells.items()), "_cell long, _ranges array<struct<start: long, first: int, parts: int>>")
    mine = F.element_at(F.filter("_ranges", lambda r: r["start"] <= F.col("key")), -1)
    inside = let(mine, lambda r: r["first"] + F.least(F.floor(hash_place(F.col("doc_id")) * r["parts"]), r["parts"] - 1).cast("int"))
    return table.join(F.broadcast(known), cell(CELL_BITS) == F.col("_cell")).select(*table.columns, inside.alias("part"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, checksums: bool = False) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: a row for each piece.

    ids is an array of ints. With checksums there is ids_crc32 instead, of the ids as little-endian 32-bit numbers.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    n = parts_for(rows)
    table = Stash(tokenised(rows, tokenizer, end_id), "pack-ids").df
    parted = _parted(table, PARTS_A_TASK * n)
    starts, total = {}, 0
    for k, tokens in sorted(map(tuple, parted.groupBy("part").agg(F.sum("n_tokens")).collect())):
        starts[k], total = total, total + tokens
    whole = total - total % sequence
    tail = [whole]  # where the sequences of powers of two begin
    for bit in range(sequence.bit_length() - 1, -1, -1):
        if (total - whole) >> bit & 1:
            tail.append(tail[-1] + (1 << bit))
    wide = _width(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right
        from zlib import crc32

        import numpy as np

        now, at = None, 0
        for b in batches:
            out: list[tuple] = []
            for k, (tokens, raw, part) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n_tokens", "ids", "part")))):
                if part != now:
                    now, at = part, starts[part]
                done, ids = 0, np.frombuffer(raw, wide)
                while done < tokens:
                    g = at + done
                    if g < whole:
                        seq, begin, end = g // sequence, g - g % sequence, g - g % sequence + sequence
                    else:
                        j = bisect_right(tail, g) - 1
                        seq, begin, end = whole // sequence + j, tail[j], tail[j + 1]
                    length = min(tokens - done, end - g)
                    piece = ids[done : done + length].astype("<i4")
                    out.append((k, done, length, crc32(piece) if checksums else piece, tokens, seq, g - begin))
                    done += length
                at += tokens
            if out:
                k, start, length, ids, tokens, seq, offset = zip(*out)
                if checksums:
                    what = pa.array(ids, pa.int64())
                else:
                    what = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), what, *(pa.array(x, pa.int64()) for x in (tokens, seq, offset))], schema.names)

    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    what = T.StructField("ids_crc32", T.LongType()) if checksums else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([rows.schema["doc_id"], *longs[:2], what, *longs[2:]])
    # Rows that are equal in all of these are the same, whichever comes first.
    order = ["part", "key", F.xxhash64("doc_id"), "doc_id", F.crc32("ids")]
    return parted.repartition(n, "part").sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids", "part").mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _width(tokenizer: str, end_id: int) -> str:
    return "<u2" if max(_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
