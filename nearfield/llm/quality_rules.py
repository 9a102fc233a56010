"""Quality rules with host verdicts.

Every text is measured in its own row with array functions; nothing is exploded. A document fails a rule of its own
(too few words, too much repetition) or a soft one (symbols, repeated lines, odd word lengths). Failures are summed
by host, with the map side combining, so a host with a third of all documents is one row a task. The rate of each
host is shrunk by a beta prior that is fitted by moments to the rates of all hosts, weighted by their documents, and
a host whose shrunk rate is over MAX_RATE loses all its documents.

Host verdicts go back without shuffling hot hosts: those are few by definition and broadcast.

Null texts have no words and fail. A null host is a host of its own. Rows are judged one by one, so repeated doc_ids are
fine. A text of any length is measured whole, and its words and windows are held in its row meanwhile. Only the three
named columns of docs are read; all come back from kept_documents(), whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Stash, let, unhot_join, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
MAX_SYMBOLS_PERCENT, MAX_DUP_LINES_PERCENT, MEAN_CHARS = 10, 30, (2, 15)
MAX_RATE = 0.5
#: The prior's documents where host rates do not vary or are one host's.
WEAK_PRIOR = 2.0


def window_hash(window: Column) -> Column:
    return F.xxhash64(window)


def repeated_words(found: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows which the array holds twice or more.

    Windows are hashed, and texts whose hashes all differ are done then. The others sort (hash, place). If neighbours of one
    hash have the same words, as they nearly always do, places that have such a neighbour are kept; else the windows
    themselves are sorted. From each kept place to the next, at most a window, words are counted.
    """
    none = F.lit(0).cast("long")

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(gaps, none, lambda a, b: a + b)

    def twins(ordered: Column, of: str) -> Column:
        """What is counted of places that have a neighbour with the same value."""
        same = lambda x, i: F.coalesce(F.get(ordered, i)[of] == x[of], F.lit(False))
        kept = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(kept, lambda x: x["i"])), covered)

    def counted(w: Column) -> Column:
        n = F.greatest(F.size(w) - (window - 1), F.lit(0))
        at = lambda i: F.slice(w, i + 1, window)

        def by_words() -> Column:
            return let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i).alias("w"), i.alias("i")))), lambda x: twins(x, "w"))

        def by_hash(ordered: Column) -> Column:
            before = lambda i: F.get(ordered, i - 1)
            unlike = F.filter(ordered, lambda x, i: F.coalesce((before(i)["h"] == x["h"]) & (at(before(i)["i"]) != at(x["i"])), F.lit(False)))
            return F.when(F.size(unlike) == 0, twins(ordered, "h")).otherwise(by_words())

        def hashed(h: Column) -> Column:
            placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(F.sort_array(placed), by_hash))

        windows = F.arrays_zip(*(F.slice(w, k + 1, n) for k in range(window)))
        return F.when(n == 0, none).otherwise(let(F.transform(windows, window_hash), hashed))

    return let(found, counted)


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    found = F.col("_words")
    full = lambda lines: F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.char_length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(full(F.split(text, "\n", -1)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(found).cast("long"),
    }


def host_rates(judged: DataFrame, host: str = "_host") -> DataFrame:
    """_host, n, failed, rate: the shrunk rate of each host."""
    hosts = Stash(judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_fails").cast("long")).alias("failed")), "host-counts").df
    raw = F.col("failed") / F.col("n")
    n, mean, square, hosts_n, n2 = hosts.agg(F.sum("n"), F.sum("failed") / F.sum("n"), F.sum(F.col("n") * raw * raw) / F.sum("n"), F.count(F.lit(1)), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    strength = WEAK_PRIOR
    if n and hosts_n > 1 and 0 < mean < 1:
        # Of the variance between hosts, what drawing n documents from one rate makes goes off first.
        between = (square - mean * mean - mean * (1 - mean) * (hosts_n - 1) / n) / (1 - n2 / n / n)
        strength = max(WEAK_PRIOR, mean * (1 - mean) / between - 1) if between > 0 else float(n)
    a = strength * (mean or 0.0)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(strength)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", marked: bool = False) -> DataFrame:
    """doc_id, the measures, base_failed, host, host_rate (the shrunk one), kept; with marked, _mark too."""
    text = F.col("_text")
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("_source"), F.col(text_col).alias("_text")).withColumn("_words", words(text))
    measured = split.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")).alias("_host"), *(c.alias(k) for k, c in measures(text).items()), *([row_mark(text, F.col("_source")).alias("_mark")] if marked else []))
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * n)
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * n) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * n) | ~mean.between(*MEAN_CHARS)
    judged = Stash(measured.withColumn("base_failed", base).withColumn("_fails", base | soft), "quality-measures").df
    rates = host_rates(judged)
    rated = unhot_join(judged, rates.select("_host", "rate", "n"), "_host", "n", judged.count())
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("_host") != "", F.substr("_host", F.lit(2))).alias("host"), F.col("rate").alias("host_rate"), (~F.col("base_failed") & (F.col("rate") <= MAX_RATE)).alias("kept"), *(["_mark"] if marked else []))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without those that the rules reject, with all columns of docs; each row by its own verdict."""
    # A row's verdict follows from its measures and its host, so the row's text and host tell it from others of its doc_id.
    mark = row_mark(F.col(text_col), F.col(host_col))
    rejected = quality_rules(docs, id_col, text_col, host_col, marked=True).where(~F.col("kept")).select(F.col("doc_id").alias("_rejected"), F.col("_mark").alias("_rejected_mark")).distinct()
    return docs.join(rejected, docs[id_col].eqNullSafe(rejected["_rejected"]) & (mark == rejected["_rejected_mark"]), "left_anti")


def row_mark(text: Column, host: Column) -> Column:
    """A digest of a row's text and host; a null text counts as empty, a null host doesn't."""
    return F.unhex(F.md5(F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), F.coalesce(F.concat(F.lit("="), host), F.lit("")))))
