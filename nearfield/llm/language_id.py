"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of WINDOW bytes, which one network reads from both ends; every position gets probabilities
of the languages, and a document's are the mean over all its positions. The state starts anew in each window.

The network is trained here, in numpy, by backpropagation through time, on a bounded sample of rows with a language:
DOCS_PER_LANGUAGE a language, the first by the hash of doc_id, and at most DOCS_IN_ALL. Of these the whole texts are
learned from: each of STEPS steps draws BATCH of all their windows. The bounds hold at every size of input, and the
sample's rows alone decide the model, whatever the partitions. Predictions read whole texts.

Documents with crc32(doc_id as text) mod FOLDS equal to HELD_OUT are never learned from. Null texts and texts without
a letter are `und` with score 0, and so is all where nothing can be learned. A text of any length is read AT_ONCE windows
at a time in one worker. Rows are judged one by one, so repeated doc_ids are fine. Only the three named columns of docs
are read, whatever the names of others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_place, share_for, unhot_join

FOLDS, HELD_OUT = 4, 2
DOCS_PER_LANGUAGE, DOCS_IN_ALL = 400, 4000
WINDOW, HIDDEN = 64, 8
STEPS, BATCH = 450, 256
#: Windows that are read at a time, which bounds a worker's memory.
AT_ONCE = 1024
#: The byte that fills a text's last window. Its positions do not count.
FILL = 256


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def windows_of(text: bytes):
    """A matrix of byte values, a row for each window."""
    import numpy as np

    n = -(-len(text) // WINDOW)
    out = np.full(n * WINDOW, FILL, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Two gated recurrent layers, one for each direction, and a linear layer over both.

    Of a layer, e holds what a byte adds to the update gate, the reset gate and the candidate (3H by 257), u what the
    state adds, and b the candidate's bias inside the reset gate. Arrays have a column for each window.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        import numpy as np

        r = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {"v": r.normal(0, 0.3, (len(languages), 2 * hidden)), "c": np.zeros((len(languages), 1))}
        for d in "fb":
            self.p |= {f"e{d}": r.normal(0, 0.3, (3 * hidden, FILL + 1)), f"u{d}": r.normal(0, hidden**-0.5, (3 * hidden, hidden)), f"b{d}": np.zeros((hidden, 1))}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def states(self, x, d: str, keep: list | None = None):
        """The state after each position (WINDOW, H, N), in the order of the text. keep gets what training needs."""
        import numpy as np

        e, u, b, n = self.p[f"e{d}"], self.p[f"u{d}"], self.p[f"b{d}"], self.hidden
        h = np.zeros((n, x.shape[0]), np.float32)
        out = np.empty((x.shape[1], n, x.shape[0]), np.float32)
        at = np.ascontiguousarray(x.T, np.intp)
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        for t in steps:
            a, s = e.take(at[t], axis=1), u @ h
            g = a[: 2 * n]
            g += s[: 2 * n]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5  # the logistic function
            z, r = g[:n], g[n:]
            q = s[2 * n :]
            q += b
            c = r * q
            c += a[2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, h, z, r, q, c))
            c = c - h if keep is not None else np.subtract(c, h, out=c)
            c *= z
            c += h
            h = c
            out[t] = h
        return out

    def probabilities(self, x, both=None):
        """(WINDOW, languages, N)."""
        import numpy as np

        f, b = both or (self.states(x, "f"), self.states(x, "b"))
        n, v = self.hidden, self.p["v"]
        y = np.matmul(v[:, :n], f)
        y += np.matmul(v[:, n:], b)
        y += self.p["c"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, x, label):
        """Of the mean loss over all positions: (gradients, loss)."""
        import numpy as np

        kept: dict = {"f": [], "b": []}
        both = [self.states(x, d, kept[d]) for d in "fb"]
        y = self.probabilities(x, both)
        real = (x != FILL).T[:, None, :]
        count = max(1, int(real.sum()))
        target = (np.arange(len(self.languages))[:, None] == label)[None]
        loss = -float((np.log(np.maximum((y * target).sum(axis=1), 1e-9)) * real[:, 0]).sum()) / count
        dy = (y - target) * real / count
        n, g = self.hidden, {k: np.zeros_like(a) for k, a in self.p.items()}
        g["c"] = dy.sum(axis=(0, 2))[:, None]
        for k, d in enumerate("fb"):
            g["v"][:, k * n : k * n + n] = np.einsum("tln,thn->lh", dy, both[k], optimize=True)
            back = np.matmul(self.p["v"][:, k * n : k * n + n].T, dy)
            dh, u = np.zeros_like(back[0]), self.p[f"u{d}"]
            for t, h, z, r, q, c in reversed(kept[d]):
                dh = dh + back[t]
                dc = dh * z * (1 - c * c)
                dz, dr = dh * (c - h) * z * (1 - z), dc * q * r * (1 - r)
                da, ds = np.concatenate([dz, dr, dc]), np.concatenate([dz, dr, dc * r])
                # Bytes repeat in a column's step, so their gradients add up by a product with their indicator.
                g[f"e{d}"] += da @ (x[:, t][:, None] == np.arange(FILL + 1)).astype(np.float32)
                g[f"u{d}"] += ds @ h.T
                g[f"b{d}"] += ds[2 * n :].sum(axis=1, keepdims=True)
                dh = dh * (1 - z) + u.T @ ds
        return g, loss

    def train(self, x, label, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam, with languages in equal shares of each step's windows; returns the loss of each step."""
        import numpy as np

        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        of = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        losses: list[float] = []
        for t in range(1, steps + 1):
            now = rate * 0.5 * (1 + np.cos(np.pi * (t - 1) / steps))
            some = np.array([of[k][r.integers(len(of[k]))] for k in r.integers(len(of), size=batch)])
            g, loss = self.gradients(x[some].astype(np.int16), label[some])
            losses.append(loss)
            size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / max(size, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return losses

    def predict(self, texts: list[bytes]):
        """Mean probabilities over all positions, a row for each text; a text without bytes has equal ones."""
        import numpy as np

        out = np.zeros((len(texts), len(self.languages)))
        waiting, owners, n = [], [], 0

        def run() -> None:
            x, own = np.concatenate(waiting), np.concatenate(owners)
            y = self.probabilities(x)
            y *= (x != FILL).T[:, None, :]
            sums = y.sum(axis=0)
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(own, sums[k], len(texts))

        for i, t in enumerate(texts):
            for lo in range(0, len(t), WINDOW * AT_ONCE):
                w = windows_of(t[lo : lo + WINDOW * AT_ONCE])
                waiting.append(w)
                owners.append(np.full(len(w), i))
                n += len(w)
                if n >= AT_ONCE:
                    run()
                    waiting, owners, n = [], [], 0
        if n:
            run()
        total = out.sum(axis=1, keepdims=True)
        return np.where(total > 0, out / np.maximum(total, 1e-9), 1 / len(self.languages))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    import numpy as np

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    usable = rows.where(F.col("_lang").isNotNull() & (F.length("_text") > 0) & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # The first of a language by hash are looked for among few, so no task sorts all of a large one.
    near = unhot_join(usable, counts, "_lang", "_n", total).where(hash_place(F.col("doc_id")) <= share_for(DOCS_PER_LANGUAGE, F.col("_n")))
    by_hash = Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_text")
    first = near.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= DOCS_PER_LANGUAGE)
    # At most DOCS_IN_ALL rows, whole texts, as the sample that they are.
    found = sorted((r["_lang"], r["_text"].encode()) for r in first.orderBy("_rank", "_lang").limit(DOCS_IN_ALL).select("_lang", "_text").collect())
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    net = Network(languages)
    x = [windows_of(t) for _, t in found]
    net.train(np.concatenate(x), np.repeat([languages.index(lang) for lang, _ in found], [len(w) for w in x]))
    return net


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        net, letter = shared.value, regex.compile(r"\p{L}").search
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if t and letter(t.decode("utf-8", "replace"))] if net else []
            if some:
                y = net.predict([texts[i] for i in some])
                for i, k, p in zip(some, y.argmax(axis=1).tolist(), y.max(axis=1).tolist()):
                    lang[i], score[i] = net.languages[k], min(1.0, p)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
