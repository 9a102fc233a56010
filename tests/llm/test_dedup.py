import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from nearfield.llm import exact_dedup, line_dedup, simhash

WS = r"[\x20\x09-\x0D]"


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(WS + "+", " ", t or "")].append(i)
    out = Counter()
    for t, ids in groups.items():
        kept = ids.index(least(ids))
        out.update((i, least(ids), len(ids), n == kept, sha256(t.encode()).hexdigest()) for n, i in enumerate(ids))
    return out


def test_exact_dedup_of_odd_rows(documents, odd):
    got = exact_dedup.exact_dedup(documents(odd))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_exact(odd)


def test_exact_dedup_of_a_large_group(documents):
    rows = [(i, "the same\ttext" if i % 3 else f"other {i % 50}") for i in range(3000)]
    assert Counter(map(tuple, exact_dedup.exact_dedup(documents(rows)).collect())) == brute_exact(rows)


def test_exact_dedup_compares_contents(documents, monkeypatch):
    """With a digest that is the same for all texts, texts still differ."""
    from pyspark.sql import functions as F

    keyed = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda *a: keyed(*a).withColumn("_digest", F.unhex(F.lit("00"))))
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(3, "text 3"), (3, "text 4")]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(documents(rows)).collect())
    assert got == Counter((i, k, n, kept) for (i, k, n, kept, _), times in brute_exact(rows).items() for _ in range(times))
    kept = Counter(i for (i, _, _, kept, _), times in brute_exact(rows).items() for _ in range(times) if kept)
    assert Counter(r["doc_id"] for r in exact_dedup.distinct_documents(documents(rows)).collect()) == kept


@pytest.mark.parametrize("times", [1, 2])
def test_distinct_documents_loses_no_text(documents, odd, times):
    """One row of each text stays, with all columns, whatever doc_ids rows share."""
    rows = (odd + [(5, "a b"), (7, "nobody else has this"), (9, "zz"), (9, "zz")]) * times
    df = documents(rows)
    out = exact_dedup.distinct_documents(df)
    assert out.columns == df.columns
    normal = lambda t: re.sub(WS + "+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    assert Counter((r["doc_id"], normal(r["text"])) for r in out.collect()) == Counter((least(ids), t) for t, ids in groups.items())


def test_a_row_that_is_repeated_very_often(documents):
    rows = [(5, "the same row")] * 3000 + [(i, f"row {i}") for i in range(500)] + [(4, "the  same row")]
    assert Counter(map(tuple, exact_dedup.exact_dedup(documents(rows)).collect())) == brute_exact(rows)


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, line_dedup.line_dedup, simhash.simhash_dedup])
def test_empty_table(documents, run):
    assert run(documents([])).count() == 0


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: re.sub(f"^{WS}+|{WS}+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    docs, keeper = defaultdict(set), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                docs[k].add(i)
                keeper[k] = i if keeper.get(k) is None else max(keeper[k], i if i is not None else keeper[k])
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs[key(x)]) < min_docs or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_line_dedup(documents, odd):
    r = random.Random(1)
    shared = [f"Shared line number {n} is \u00e9 long enough to count here" for n in range(30)]
    rows = [(i, "\n".join([r.choice([x, x.upper().replace("\u00c9", "\u00e9"), f"  {x}\t"]) for x in r.sample(shared, r.randint(0, 4))] + [f"line of {i} that nobody else has in the table"])) for i in r.sample(range(10_000), 200)]
    rows += [(20_000 + i, shared[0] + "\n" + shared[0] + "\n\n") for i in range(100)] + odd
    got = line_dedup.line_dedup(documents(rows))
    assert got.columns == ["doc_id", "kept_text", "n_lines", "n_dropped"]
    assert Counter(map(tuple, got.collect())) == brute_lines(rows)


@pytest.mark.parametrize("ids, dropped", [([1, 1, 1, 2, 3], 0), ([1, 1, 2, 3, 4, None], 5), ([None] * 4 + [1, 2, 3], 0), ([5, 4, 3, 2, 1, 1], 5)])
def test_lines_of_rows_that_share_a_doc_id(documents, ids, dropped):
    """Documents count, not rows."""
    rows = [(i, "one line that is long enough to be counted as one") for i in ids]
    got = line_dedup.line_dedup(documents(rows)).collect()
    assert Counter(map(tuple, got)) == brute_lines(rows) and sum(r["n_dropped"] for r in got) == dropped


def test_line_runs_take_batches_in_any_order(spark):
    pairs = [(n % 11, i) for i in range(60) for n in {i, i * 7, 3}]
    keys = {(b"%016d" % k, i) for k, i in pairs}
    runs = line_dedup.LineRuns(spark, min_docs=5, fanout=2)
    for b in (2, 0, 3, 1, 4):
        some = [(bytearray(k), i) for k, i in keys if i % 5 == b]
        runs.add(spark.createDataFrame(some, "_key binary, doc_id long"))
    docs = Counter(k for k, _ in keys)
    best = {k: max(i for x, i in keys if x == k) for k in docs}
    got = {bytes(r["_key"]): r["_keeper"] for r in runs.common().collect()}
    assert got == {k: best[k] for k, n in docs.items() if n >= 5}
    assert len(runs.levels) == 3 and [len(x) for x in runs.levels] == [1, 0, 1]


def fingerprint(text, shingle=3):
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    if not w:
        return 0
    parts = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    h = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=2):
    """The least print that each reaches."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    some = sorted(root)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in root}


def test_simhash_dedup(documents, odd):
    r = random.Random(2)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for i in range(0, 300, 3):
        text = r.choices(words, k=r.choice([1, 2, 3, 40, 600]))
        rows += [(i, " ".join(text)), (i + 1, " ".join(text).upper()), (i + 2, " ".join(text[:-1] + ["changed"]))]
    rows += odd
    got = simhash.simhash_dedup(documents(rows))
    prints = [fingerprint(t) for _, t in rows]
    roots = brute_components(set(prints))
    members = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        members[roots[p]].append(i)
    want = Counter((i, f"{p:016x}", least(members[roots[p]]), len(members[roots[p]])) for (i, _), p in zip(rows, prints))
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_links_of_crowded_keys(spark, bucket):
    """All ways give the same components: pairs, stars by common neighbours, and both."""
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 1 << 63, 6)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for bit in r.integers(0, 64, r.integers(1, 5)):
                x ^= 1 << int(bit)
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "_print long")
    edges = simhash.links(df, bucket=bucket)
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    assert {frozenset(p for p in prints if got.get(p, p) == got.get(q, q)) for q in prints} == {frozenset(p for p in prints if want[p] == want[q]) for q in prints}


def test_components_of_a_chain(spark):
    n = 60
    order = random.Random(4).sample(range(1000), n)
    edges = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(order, order[1:])], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == dict.fromkeys(order, min(order))


def test_components_of_a_star(spark):
    """One node that 100 000 others are linked to, and a chain that hangs on it."""
    n = 100_000
    edges = spark.range(1, n + 1).selectExpr("id + 10 AS u", "7L AS v").unionByName(spark.range(n, n + 20).selectExpr("id + 11 AS u", "id + 10 AS v"))
    got = simhash.components(edges)
    assert got.count() == n + 21 and [r["root"] for r in got.select("root").distinct().collect()] == [7]


def test_one_row_of_each_group_stays(documents, odd):
    long = " ".join(f"w{n}" for n in range(500))
    rows = odd * 2 + [(5, long), (3, long + " more"), (3, long + " less"), (None, long), (9, "one that stands alone here"), (9, long)]
    prints = [fingerprint(t) for _, t in rows]
    roots = brute_components(set(prints))
    groups = defaultdict(list)
    for (i, t), p in zip(rows, prints):
        groups[roots[p]].append(i)
    got = Counter(r["doc_id"] for r in simhash.one_of_each_group(documents(rows)).collect())
    assert got == Counter(map(least, groups.values()))


def test_one_of_each_group_keeps_columns(documents):
    text = " ".join(f"w{n}" for n in range(500))
    df = documents([(5, text), (3, text + " more"), (9, "something else that stands alone")])
    out = simhash.one_of_each_group(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {3, 9}


def test_verdicts_of_rows_that_share_a_doc_id(documents):
    rows = [(1, "a copy"), (9, "a copy"), (9, "alone"), (None, "a  copy"), (None, "alone too"), (None, None)]
    got = exact_dedup.distinct_documents(documents(rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], rows[2], rows[4], rows[5]])
