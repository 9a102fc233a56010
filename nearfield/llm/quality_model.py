"""A quality classifier from weak labels.

1. Overlapping heuristic labellers vote on every document: junk, clean, or no vote.
2. Expectation-maximisation over the counts of all vote patterns (at most 3 to the number of labellers, however many
   documents there are) estimates how often each labeller votes which way on clean and on junk documents, and from
   that the probability that a pattern's documents are clean.
3. Those probabilities of SAMPLE rows, the first by the hash of doc_id, train a linear scorer over hashed features: byte
   trigrams by their frequency, and the document's statistics by steps. It scores every document by its whole text.

The sample is taken and trained on in an order that its rows alone decide, so neither partitions nor retries change a
score. Null texts count as empty; an empty text has no trigrams and gets what its statistics say. Texts of any length
are read whole, each in one worker. Rows are scored one by one, so repeated doc_ids are fine. Only the two named columns
reach Python; all columns of docs come back from clean_documents(), whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hash_place, share_for

JUNK, NONE, CLEAN = -1, 0, 1
SAMPLE = 4000
FEATURES, TRIGRAMS = 4096, 3072
THRESHOLD = 0.5
#: Labellers that cry junk on more clean documents than this are not believed to do so.
MOST_WRONG = 0.02
SYMBOLS, LETTERS = b"#*$%&|<>{}[]~^=\\", bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
CAPITALS, MARKS, ENDS = bytes(range(65, 91)), b"!?", b".!?"

#: A labeller: a statistic, below what it votes one way, from what another, and the words that it needs for a vote.
LABELLERS = (
    ("symbols", 0.03, CLEAN, 0.2, JUNK, 4),
    ("marks", 0.05, CLEAN, 0.3, JUNK, 4),
    ("letters", 0.75, JUNK, 0.93, CLEAN, 8),
    ("capitals", 0.2, CLEAN, 0.5, JUNK, 8),
    ("repeats", 0.05, CLEAN, 0.25, JUNK, 8),
    ("phrases", 0.1, CLEAN, 0.4, JUNK, 12),
    ("lines", 0.2, CLEAN, 0.4, JUNK, 12),
    ("short_words", 0.2, CLEAN, 0.35, JUNK, 8),
)


def statistics(text: bytes) -> tuple[int, dict[str, float]]:
    """The words, and shares: of marks and symbols by word, of others by what they count."""
    from operator import eq

    found = text.lower().split()
    n, solid = max(1, len(found)), max(1, sum(map(len, found)))
    of = lambda chars: len(text) - len(text.translate(None, chars))
    letters = of(LETTERS)
    grams = list(zip(found, found[1:], found[2:], found[3:]))
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    long_lines = [x for x in lines if len(x) >= 20]
    return len(found), {
        "symbols": of(SYMBOLS) / n,
        "marks": of(MARKS) / n,
        "letters": letters / solid,
        "capitals": of(CAPITALS) / max(1, letters),
        "repeats": sum(map(eq, found, found[1:])) / n,
        "phrases": 1 - len(set(grams)) / max(1, len(grams)) if grams else 0.0,
        "lines": 1 - len(set(long_lines)) / max(1, len(long_lines)) if long_lines else 0.0,
        "short_words": sum(len(x) == 1 for x in found) / n,
    }


def vote(n: int, stats: dict[str, float]) -> tuple[int, ...]:
    return tuple(NONE if n < least else low if stats[k] < a else high if stats[k] >= b else NONE for k, a, low, b, high, least in LABELLERS)


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """The probability that a pattern's documents are clean.

    Labellers vote independently, given the class. Of those that vote, how many vote which way has a prior for each class: a vote for the class is more
    likely than one against it. So the classes keep their meaning, also where all documents are of one. On clean documents
    a labeller's votes for junk are at most MOST_WRONG of all; a round takes the likeliest rates within that, which are
    the bound and the rest where the bound is exceeded. No vote says nothing: a document that no labeller votes on is as
    likely clean as any.
    """
    import numpy as np

    if not patterns:
        return {}
    keys = sorted(patterns)
    seen, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    votes = np.stack([seen == v for v in (JUNK, CLEAN)], axis=-1).astype(float)
    prior = {1: np.array([0.5, 40.0]), 0: np.array([20.0, 12.0])}
    clean = np.where((seen == JUNK).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        log = []
        for c, p in ((1, clean), (0, 1 - clean)):
            counts = np.einsum("p,plv->lv", n * p, votes) + prior[c]
            rate = counts / counts.sum(axis=1, keepdims=True)
            if c:
                wrong = np.minimum(rate[:, 0], MOST_WRONG)
                rate = np.stack([wrong, 1 - wrong], axis=1)
            log.append(np.log(((n * p).sum() + 1 + 8 * c) / (n.sum() + 10)) + np.einsum("plv,lv->p", votes, np.log(rate)))
        before, clean = clean, 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        if np.abs(clean - before).max() < 1e-6:
            break
    return dict(zip(keys, clean.tolist()))


def statistic_features(n: int, stats: dict[str, float]) -> list[int]:
    """The hashed places of the statistics' steps."""
    from zlib import crc32

    steps = [f"{k}:{min(20, int(20 * v + 0.5))}" for k, v in stats.items()] + [f"words:{n.bit_length()}"]
    return [TRIGRAMS + crc32(s.encode()) % (FEATURES - TRIGRAMS) for s in steps]


def trigram_places(text: bytes):
    import numpy as np

    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    return ((b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA77 ^ b[2:] * 0xC2B2AE3D) >> 15) % TRIGRAMS


def features(text: bytes):
    """(places, values): of trigrams their frequencies, of statistics ones."""
    import numpy as np

    steps = np.bincount(statistic_features(*statistics(text)), minlength=FEATURES).astype(np.float32)
    if len(text) > 2:
        steps[:TRIGRAMS] = TRIGRAM_SCALE * np.bincount(trigram_places(text), minlength=TRIGRAMS) / (len(text) - 2)
    places = np.flatnonzero(steps)
    return places.astype("<u2"), steps[places].astype("<f4")


TRIGRAM_SCALE = 30.0


def train(x, y, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4):
    """Logistic regression by Adam on all rows of a matrix whose last column is ones; y is the probability of clean."""
    import numpy as np

    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    balance = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(np.float32)
    balance /= balance.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (balance * (p - y)) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float32)


def _texts(batch: pa.RecordBatch, column: int | str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """(the scorer's weights, the probability of clean by vote pattern)."""
    import numpy as np

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([list(vote(*statistics(t))) for t in _texts(b, 0)], pa.list_(pa.int8()))], ["votes"])

    counts = rows.select("_text").mapInArrow(votes, "votes array<tinyint>").groupBy("votes").count().collect()
    clean = expectation_maximisation({tuple(r["votes"]): r["count"] for r in counts})
    near = rows.where(hash_place(F.col("doc_id")) <= share_for(sample, sum(r["count"] for r in counts)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, 1)
            places, values = zip(*map(features, texts)) if texts else ((), ())
            columns = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (places, values)]
            y = pa.array([clean[vote(*statistics(t))] for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, y], ["place", "places", "features", "y"])

    # Few rows have these hashes; what is sorted and cut are their features, whatever the texts' lengths.
    hashed = near.select(F.xxhash64("doc_id").alias("place"), "_text").mapInArrow(vectors, "place long, places binary, features binary, y double")
    found = hashed.orderBy("place", "places", "features", "y").limit(sample).collect()
    if not found:
        return np.zeros(FEATURES + 1, np.float32), clean
    x, y = np.zeros((len(found), FEATURES + 1), np.float32), np.array([r["y"] for r in found], np.float32)
    for row, r in zip(x, found):
        row[np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["features"], "<f4")
        row[FEATURES] = 1
    del found
    return train(x, y), clean


def with_scores(docs: DataFrame, weights, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with one more column: the probability that the text is clean."""
    w = docs.sparkSession.sparkContext.broadcast(weights)  # FEATURES + 1 numbers

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        of = w.value
        return pa.array([score_of(t or b"", of) for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return docs.withColumn(into, score(F.col(text_col)))


def score_of(text: bytes, weights) -> float:
    import numpy as np

    s = float(weights[FEATURES]) + float(weights[statistic_features(*statistics(text))].sum())
    if len(text) > 2:
        s += TRIGRAM_SCALE * float(weights[:TRIGRAMS][trigram_places(text)].mean(dtype=np.float64))
    return 1 / (1 + float(np.exp(-np.clip(s, -50, 50))))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, kept."""
    weights, _ = fit(docs, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_scores(rows, weights).select("doc_id", "score", (F.col("score") >= threshold).alias("kept"))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the scorer rejects, with all columns of docs."""
    weights, _ = fit(docs, id_col, text_col, sample)
    into = fresh(docs, "_score")
    return with_scores(docs, weights, text_col, into).where(F.col(into) >= threshold).select(*docs.columns)
