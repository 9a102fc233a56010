import random

import pytest

import corpus_pipeline
from nearfield.llm import near_dedup, simhash


def near(a, b):
    x, y = (set(zip(*(t.split()[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def brute(rows):
    """The ids that stay."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if find(i) != find(j) and near(a, b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in root if root[i] == i}


def copies(seed, groups, each, words=300, changes=4):
    r, rows = random.Random(seed), []
    for _ in range(groups):
        text = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
        for _ in range(each):
            some = list(text)
            for i in r.sample(range(words), r.randint(1, changes)):
                some[i] = "changed"
            rows.append((len(rows), " ".join(some)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("stars", [0, 1, 2])
def test_near_copies_of_planted_groups(documents, stars):
    """Whichever pairs are compared, the groups are those of all pairs; some of a large group aren't near its pivots."""
    rows = copies(1, 20, 6) + [(1000 + i, t) for i, t in copies(2, 1, 60, changes=9)] + [(2000 + i, t) for i, t in copies(4, 1, 80, words=120, changes=6)]
    want = brute(rows)
    assert len(want) < len(rows) / 2
    out = near_dedup.one_of_each_group(documents(rows), stars=stars)
    assert {r["doc_id"] for r in out.collect()} == want


def test_large_groups_make_few_pairs(documents, monkeypatch):
    asked, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, sets: asked.append(pairs.seen["rows"]) or verified(pairs, sets))
    rows = copies(5, 1, 1500, words=200, changes=2)
    out = near_dedup.one_of_each_group(documents(rows))
    assert [r["doc_id"] for r in out.collect()] == [0] and sum(asked) <= 2 * len(rows)


def scattered(seed, many, words=150, most=9):
    """Copies of one text: the first half are near it, the others mostly near no other."""
    r = random.Random(seed)
    text = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    rows = []
    for i in range(many):
        some = list(text)
        for at in r.sample(range(words), r.randint(0, 3) if 2 * i < many else r.randint(3, most)):
            some[at] = r.choice(("and", "the", "of", f"n{r.randint(0, 10**6)}"))
        rows.append((i, " ".join(some)))
    return rows


@pytest.mark.parametrize("bucket", [0, 8])
@pytest.mark.parametrize("stars", [0, 2])
def test_crowded_groups_are_those_of_all_pairs(documents, monkeypatch, stars, bucket):
    """Where nodes are compared by differences, whichever set they are differences of, and by pairs beside it."""
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "SAMPLE", 1 if bucket else 16)
    short = [(3000 + i, t) for i, t in scattered(9, 60, words=30, most=4)]
    rows = scattered(7, 120) + [(1000 + i, t) for i, t in copies(8, 1, 50, changes=9)] + [(2000 + i, t) for i, t in copies(4, 12, 5)] + short
    want = brute(rows)
    assert 60 < len(want) < len(rows)
    out = near_dedup.one_of_each_group(documents(rows), stars=stars)
    assert {r["doc_id"] for r in out.collect()} == want


def test_rows_around_a_large_group_make_few_pairs(documents, monkeypatch):
    """Pairs grow with the rows, not with those of a group times those near it that aren't in it."""
    asked, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, sets: asked.append(pairs.seen["rows"]) or verified(pairs, sets))
    rows = scattered(6, 1500)
    kept = near_dedup.one_of_each_group(documents(rows)).count()
    assert 400 < kept < 1000 and sum(asked) <= 20 * len(rows)


def test_pipeline_drops_copies_whose_prints_differ(spark, documents):
    rows = copies(3, 15, 2, words=200, changes=3)
    docs = documents(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()} == brute(rows)


def test_pipeline_drops_what_simhash_links(spark, documents):
    """Texts that repeat themselves have one fingerprint, though few of their shingles are in common. Links of both kinds
    make one component."""
    r = random.Random(11)
    new = lambda n: [f"x{r.randint(0, 10**9)}" for _ in range(n)]
    once, end = "one two three four five six seven ".split(), new(40)
    texts = {3: once * 40 + new(40), 4: once * 40 + new(30), 5: once * 40 + end, 9: once * 2 + end, 20: new(200), 30: new(200)}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(7, None), (8, " ")]
    docs, text = documents(rows), dict(rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.simhash_dedup(docs).collect()}
    assert found[3] == found[4] == found[5] != found[9] and near(text[5], text[9])
    assert not any(near(text[i], text[j]) for i, j in ((3, 4), (3, 5), (3, 9), (4, 5), (4, 9)))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == [3, 7, 20, 30]


def test_rows_without_enough_words_or_with_one_id(documents):
    rows = [(1, None), (2, " "), (3, "a b"), (4, "A  b"), (5, "b a"), (9, "one text of five words or more"), (9, "a b"), (None, "nobody else has this text here"), (None, "")]
    got = near_dedup.one_of_each_group(documents(rows)).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[5], rows[7]]))


def test_near_rows_of_one_doc_id(documents):
    """One row stays of a group whose rows share the smallest doc_id."""
    text = [f"word{n}" for n in range(100)]
    rows = [(7, " ".join(text)), (7, " ".join(text[:-1])), (7, " ".join(text)), (8, " ".join(text[1:])), (7, "another one that is like none of them")]
    got = near_dedup.one_of_each_group(documents(rows)).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in got) == [7, 7] and sum("word5 " in r["text"] for r in got) == 1
