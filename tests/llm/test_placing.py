import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import byte_bpe, packing, sharding, url_filter
from nearfield.llm.queries import URL_RULES, tokenizer_path

RANKS = tokenizer_path("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizer_path("word_bpe_49k.json")


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "https://a.b.example.net/en/x?q#f", "http://example.net/enx/", "http://xnet/", "http://a.net?x=/",
    "http://example.com/de/1", "http://www.EXAMPLE.com/de", "http://example.org/fr/2", "http://org/fr/", "http://a.b.c.d.e.f.net/" + "x/" * 5000, "ftp://u@h.net:80/", "http://net./", "http://\u00c9.NET/\u00e9", "a://b://c.net/",
]


def test_url_filter_against_brute_force(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = [tuple(r)[1:] for r in url_filter.judge_urls(pages(spark, URLS), rules).orderBy("page_id").collect()]
    assert got == [brute_verdict(u, URL_RULES) for u in URLS]


def test_url_filter_with_many_rules(spark):
    r = random.Random(7)
    hosts = ["a", "b.a", "c.b.a", "x", "y.x", "z.y.x", "com"]
    rules = sorted({(r.choice(hosts), r.choice(["", "/", "/p", "/p/", "/p/q", "/longer/path"]), r.choice(["allow", "block"])) for _ in range(40)})
    urls = [f"http://{r.choice(['', 'www.'])}{r.choice(hosts)}{r.choice(['', '/', '/p', '/p/q/r', '/longer/pathway', '/pp?x'])}" for _ in range(300)]
    df = spark.createDataFrame(rules, "host string, path string, action string")
    got = [tuple(x)[1:] for x in url_filter.judge_urls(pages(spark, urls), df).orderBy("page_id").collect()]
    assert got == [brute_verdict(u, rules) for u in urls]


def test_url_filter_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r["verdict"] for r in url_filter.judge_urls(pages(spark, URLS), none).collect()} == {"allow"}
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    assert url_filter.judge_urls(pages(spark, URLS).limit(0), rules).count() == 0


def test_rules_whose_prefixes_clash(spark, monkeypatch):
    """With one prefix for all digests, whole digests still decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(url_filter, "prefix_of", lambda digest: F.length(digest).cast("long"))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = [tuple(r)[1:] for r in url_filter.judge_urls(pages(spark, URLS), rules).orderBy("page_id").collect()]
    assert got == [brute_verdict(u, URL_RULES) for u in URLS]


def test_urls_are_joined_on_the_prefix_alone(spark, monkeypatch):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    kind = type(rules)
    seen, join = [], kind.join

    def spy(self, other, *how, **more):
        out = join(self, other, *how, **more)
        if "_rules" in other.columns:
            seen.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(kind, "join", spy)
    url_filter.judge_urls(pages(spark, URLS), rules)
    keys = [line for line in seen[0].split("\n") if "Join " in line]
    assert len(seen) == 1 and len(keys) == 1 and "_digest" not in keys[0] and keys[0].count("_prefix") == 2


def test_sharding_law(documents, odd):
    rows = odd + [(i, "t" * (i % 50)) for i in range(100, 4000)]
    got = sharding.assign_shards(documents(rows), sharding.Tree.of(8)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in rows)
    assert all(r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(0.8 < 8 * len(s) / len(rows) < 1.2 for s in by.values())
    assert 0.8 < 9 * sum(r["grown_shard"] == 8 for r in got) / len(rows) < 1.2
    one = defaultdict(set)
    for r in got:
        one[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in one.values())


def test_weights_move_documents_only_in_their_subtrees(spark):
    from pyspark.sql import functions as F

    tree = sharding.Tree((({0: 1.0, 1: 1.0}, {2: 1.0}), ({3: 2.0}, {4: 1.0, 5: 1.0})))
    more = sharding.Tree((({0: 1.0, 1: 1.0}, {2: 1.0}), ({3: 2.0}, {4: 1.0, 5: 3.0})))
    key = F.col("id").cast("string")
    both = spark.range(6000).select(tree.place(key).alias("a"), more.place(key).alias("b")).collect()
    assert all(a == b or b in (4, 5) or a in (3, 4) and b in (3, 4, 5) or b == 3 and a in (0, 1, 2) for a, b in both)
    assert not any(a != b and b in (0, 1, 2) for a, b in both)
    shares = Counter(b for _, b in both)
    assert abs(shares[5] / 6000 - 3 / 9) < 0.03


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_byte_bpe_round_trip(documents, odd):
    import public_tokenizers

    r = random.Random(8)
    rows = odd + [(100 + i, "".join(r.choice("ab \n\t'\u00e9\u0301\u4f60!1\u2003s") for _ in range(r.randint(0, 60)))) for i in range(300)] + [(999, "<|endoftext|> x")]
    encoded = byte_bpe.encode(documents(rows), RANKS, public_tokenizers.PATTERN)
    enc = tiktoken_encoding()
    want = Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    got = byte_bpe.decode(encoded, RANKS).collect()
    assert Counter((x["doc_id"], tuple(byte_bpe.array_of_ids(x["ids"]).tolist()), bytes(x["decoded"])) for x in got) == want
    digests = {tuple(x) for x in byte_bpe.digests(encoded, RANKS).collect()}
    assert digests == {(i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(b).hexdigest()) for i, ids, b in want}


def test_byte_bpe_of_many_blocks(documents, monkeypatch):
    import public_tokenizers

    r = random.Random(9)
    rows = [(i, " ".join(f"w{r.randint(0, 500)}" for _ in range(r.randint(0, 60)))) for i in range(400)]
    enc = tiktoken_encoding()
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 2000)
    got = byte_bpe.encode(documents(rows), RANKS, public_tokenizers.PATTERN).collect()
    assert {x["doc_id"]: byte_bpe.array_of_ids(x["ids"]).tolist() for x in got} == {i: enc.encode_ordinary(t) for i, t in rows}


def test_words_that_a_bucket_forgets(documents, monkeypatch):
    import public_tokenizers

    r = random.Random(13)
    rows = [(i, " ".join(f"w{r.randint(0, 50)}" for _ in range(40))) for i in range(50)]
    enc = tiktoken_encoding()
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 300)
    monkeypatch.setattr(byte_bpe._encode_buckets, "__defaults__", (3,))
    got = byte_bpe.encode(documents(rows), RANKS, public_tokenizers.PATTERN).collect()
    assert {x["doc_id"]: byte_bpe.array_of_ids(x["ids"]).tolist() for x in got} == {i: enc.encode_ordinary(t) for i, t in rows}


@pytest.mark.parametrize("numbers", [[], [0], [1, 255, 256, 65536, 2**32 - 1]])
def test_squeezed_numbers(numbers):
    assert byte_bpe._unsqueeze(byte_bpe._squeeze(numbers)).tolist() == numbers
    parts = [bytes([n % 256]) * (n % 7) for n in numbers]
    assert byte_bpe._unpack(byte_bpe._pack(parts)) == parts


def brute_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]


@pytest.mark.parametrize("many", [0, 150])
def test_packing(documents, odd, many):
    r = random.Random(10)
    rows = odd + [(100 + i, " ".join(r.choice(["the", "Cat", "sat,", "\u00e9\u00df", "d'accord", "x1y2", "<|endoftext|>", "\x01", "a\x01b"]) for _ in range(r.randint(0, 900)))) for i in range(many)]
    pieces = packing.pack(documents(rows), WORDS).collect()
    texts = defaultdict(list)
    for i, ids in brute_ids(rows):
        texts[i].append(ids)
    found = defaultdict(dict)
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0
        found[p["sequence_id"], p["offset"]] = p
    # Pieces of a document follow each other in sequence order, so rows with the same doc_id can be told apart.
    got, open_ = defaultdict(list), {}
    for key in sorted(found):
        p = found[key]
        if p["start"] == 0:
            open_[p["doc_id"]] = []
        assert len(open_[p["doc_id"]]) == p["start"]
        open_[p["doc_id"]] += p["ids"]
        if len(open_[p["doc_id"]]) == p["doc_tokens"]:
            got[p["doc_id"]].append(open_.pop(p["doc_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()} and not open_
    ends = defaultdict(list)
    for (s, o), p in found.items():
        ends[s].append((o, p["length"]))
    assert sorted(ends) == list(range(len(ends)))
    for parts in ends.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.SEQUENCE and at & (at - 1) == 0


def test_packed_checksums(documents, odd):
    ids = {(p["doc_id"], p["sequence_id"], p["offset"]): p["ids"] for p in packing.pack(documents(odd), WORDS).collect()}
    for p in packing.pack(documents(odd), WORDS, checksums=True).collect():
        assert p["ids_crc32"] == crc32(np.array(ids[p["doc_id"], p["sequence_id"], p["offset"]], "<u4").tobytes())


def test_packing_keeps_the_order_of_the_curve(spark, documents):
    """Documents whose keys begin alike, some of them equal, lie in order, however many parts there are."""
    r = random.Random(12)
    common = " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat"]) for _ in range(400))
    rows = [(i, common + " " + " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 20)))) for i in range(300)]
    rows += [(1000 + i, common) for i in range(200)] + [(2000 + i, f"{i} others") for i in range(50)]
    df = documents(rows)
    keys = {x["doc_id"]: x["key"] for x in packing.tokenised(df.select("doc_id", "text"), WORDS).collect()}
    cells = Counter(k >> 24 for k in keys.values())
    assert max(cells.values()) > 200 and len(set(keys.values())) > 100
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            pieces = sorted((p["sequence_id"], p["offset"], p["doc_id"], p["start"]) for p in packing.pack(df, WORDS).collect())
            order = [keys[i] for _, _, i, start in pieces if start == 0]
            assert len(order) == len(rows) and order == sorted(order)
            found.append(pieces)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_nothing_to_pack_encode_or_place(documents):
    import public_tokenizers

    none = documents([])
    assert packing.pack(none, WORDS).count() == 0
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert sharding.assign_shards(none, sharding.Tree.of(8)).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_ids_of_words_of_all_kinds():
    """Plain words and others, alone and with marks, as the tokenizer itself has them."""
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS, "<u2"), random.Random(11)
    letters = [chr(c) for c in range(0x21, 0x250)] + list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ.,!?'\u2019") * 8
    letters += ["\u0301", "\u0308", "\u0130", "\u017f", "\u212a", "\u212b", "\ufb01", "\u4f60", "\u00ad", "\x01", "<|endoftext|>", "\u03a3"]
    for _ in range(4000):
        text = " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(2))
        assert encoded(e, [text]) == [t.encode(text, add_special_tokens=False).ids], text


def encoded(encoder, texts):
    ids, lengths = encoder(pa.array(texts, pa.string()))
    ends = np.cumsum(lengths).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_slices_of_texts():
    texts = pa.array(["a" * n for n in (1, 0, 5, packing.SLICE_BYTES + 1, 3)] + [None] + ["b"] * 3 * packing.SLICE_ROWS)
    got, n = list(packing._slices(texts)), packing.SLICE_ROWS
    assert got == [(0, 3), (3, 4), (4, 4 + n), (4 + n, 4 + 2 * n), (4 + 2 * n, 4 + 3 * n), (4 + 3 * n, 6 + 3 * n)]
    assert list(packing._slices(texts.slice(0, 0))) == []


def test_tokenizers_that_keep_white_space_get_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["ab cd", "", "  two  spaces\n", "don't \u00e9\u4f60"]
    assert encoded(packing.WordEncoder(path, "<u2"), texts) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_forgotten_and_learned_again():
    e = packing.WordEncoder(WORDS, "<u2", remembered=10)
    texts = [" ".join(f"w{(i * 7 + j) % 40}" for j in range(6)) for i in range(30)]
    assert [encoded(e, [t])[0] for t in texts] == [ids[:-1] for _, ids in brute_ids([(0, t) for t in texts])]
    mixed = ["", None, "  leading and trailing\t\n", "a\x0bb\x0cc\rd", "\u00a0a\u2003b"]
    assert encoded(e, mixed) == [ids[:-1] for _, ids in brute_ids([(0, t) for t in mixed])] and encoded(e, []) == []
    assert len(e.known) <= 16


def test_an_idle_worker_forgets_the_words_of_packing(spark, documents):
    """Workers go on to serve other operators, beside whose memory the words stood."""
    from time import sleep

    def held(batches):
        import gc

        n = sum(isinstance(x, packing.WordEncoder) for x in gc.get_objects())
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    assert packing.pack(documents([(i, f"some words {i}") for i in range(50)]), WORDS).count() >= 50
    for _ in range(10):
        sleep(2)
        left = sum(r["n"] for r in spark.range(8, numPartitions=8).mapInArrow(held, "n long").collect())
        if not left:
            break
    assert left == 0
