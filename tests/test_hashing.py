"""Hash models: fixed results, properties, and the three forms against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.errors import VectorError
from nearfield.functions import codecs
from nearfield.functions import hashing as h
from nearfield.functions.java_random import JavaRandom
from nearfield.mapping import CosineLsh, DenseFloatMapping, HammingLsh, JaccardLsh, L2Lsh, PermutationLsh
from nearfield.operators.blocks import with_terms
from nearfield.sources.readers import from_numpy
from nearfield.vectors import DenseFloat, SparseBool

DENSE = [CosineLsh(12, 5, 3), L2Lsh(12, 4, 2, 1), PermutationLsh(12, 4, False), PermutationLsh(12, 4, True)]
SPARSE = [JaccardLsh(40, 6, 2), HammingLsh(40, 5, 3), HammingLsh(40, 30, 4)]


def test_generator_agrees_with_the_jvm(spark):
    java = spark._jvm.java.util.Random(0)
    ours = JavaRandom(0)
    for n in (2038074742, 10, 1 << 20, 7):
        assert [ours.next_int(n) for _ in range(50)] == [java.nextInt(n) for _ in range(50)]
    assert [ours.next_float() for _ in range(50)] == pytest.approx([java.nextFloat() for _ in range(50)], rel=1e-7)
    assert [np.float32(ours.next_gaussian()) for _ in range(99)] == [np.float32(java.nextGaussian()) for _ in range(99)]


def rows_of(spark, mapping, n=40):
    r = np.random.default_rng(5)
    if mapping.sparse:
        x = r.random((n, mapping.dims)) < 0.3
        x[0] = False
    else:
        x = r.standard_normal((n, mapping.dims)).astype(np.float32)
        x[0], x[1] = 0, np.repeat([1, -1, 2, 0], 3)
    return x, from_numpy(spark, x).withColumn("vec", F.when(F.col("id") != 5, F.col("vec")))


@pytest.mark.parametrize("mapping", DENSE + SPARSE, ids=str)
def test_three_forms_agree(spark, mapping, monkeypatch):
    x, df = rows_of(spark, mapping)
    model = h.model_of(mapping)
    terms = lambda d: {r["id"]: None if r["terms"] is None else [(t["tbl"], tuple(t["hash"]), t["freq"]) for t in r["terms"]] for r in d.collect()}
    in_jvm = terms(df.withColumn("terms", model.hash_column(F.col("vec"))))
    monkeypatch.setattr("nearfield.operators.blocks.STEPS", -1)
    assert terms(with_terms(df, "vec", model)) == in_jvm and in_jvm[5] is None
    for i, row in enumerate(x):
        if i != 5:
            v = SparseBool(tuple(np.flatnonzero(row)), mapping.dims) if mapping.sparse else DenseFloat(tuple(row))
            assert model.hash_literal(v) == in_jvm[i]


def test_minimum_hash_of_an_empty_vector():
    assert h.model_of(JaccardLsh(40, 6, 2)).hash_literal(SparseBool((), 40)) == [(-1, (2038074743,), 1)] * 6


def test_minimum_hashes_may_be_negative():
    found = h.model_of(JaccardLsh(10**6, 30, 2)).hash_literal(SparseBool((3, 999_999), 10**6))
    assert any(x < 0 for _, t, _ in found for x in t)


@pytest.mark.parametrize("L, k", [(10, 3), (30, 4)])
def test_bit_sampling_takes_distinct_positions(L, k):
    model = h.model_of(HammingLsh(40, L, k))
    assert len(model.tables) == L and all(len(set(t)) == k and t == sorted(t) for t in model.tables)
    if L * k <= 40:
        assert len({p for t in model.tables for p in t}) == L * k


def test_hyperplanes_ignore_scale():
    model, v = h.model_of(CosineLsh(12, 5, 3)), np.random.default_rng(6).standard_normal(12)
    assert model.hash_literal(DenseFloat(tuple(v))) == model.hash_literal(DenseFloat(tuple(7 * v)))


def ranked(values, k):
    """Places from 1 with their sign, by absolute value and then by place, and k less the number of larger ones."""
    order = sorted(range(len(values)), key=lambda i: (-abs(values[i]), i))[:k]
    return [(i + 1 if values[i] >= 0 else -i - 1, k - sum(abs(x) > abs(values[i]) for x in values)) for i in order]


@pytest.mark.parametrize("k", [1, 3, 6])
def test_permutations_against_a_ranking(k):
    r = np.random.default_rng(9)
    vectors = [r.integers(-4, 5, 6).astype(float) for _ in range(20)] + [np.zeros(6), np.array([3.0, -3, 3, -3, 0, 0])]
    for v in vectors:
        want = ranked(v.tolist(), k)
        assert [(t[0], f) for _, t, f in h.model_of(PermutationLsh(6, k, True)).hash_literal(DenseFloat(tuple(v)))] == want
        assert [(t[0], f) for _, t, f in h.model_of(PermutationLsh(6, k, False)).hash_literal(DenseFloat(tuple(v)))] == [(x, 1) for x, _ in want]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("L", [1, 4])
def test_probes(k, L):
    """As many as asked or as there are, the plain terms first, each a step of one away, the nearest border first."""
    model, v = h.model_of(L2Lsh(20, L, k, 2)), DenseFloat(tuple(np.random.default_rng(k).standard_normal(20)))
    plain = model.hash_literal(v)
    before = plain
    for probes in range(3**k + 3):
        found = model.hash_literal(v, probes)
        assert len(found) == L * (1 + min(probes, 3**k - 1)) and found[:L] == plain and found[: len(before)] == before
        assert all(max(abs(a - b) for a, b in zip(x, plain[t][1])) == 1 for t, x, _ in found[L:])
        before = found
    if k == 1:
        assert set(before) == {(t, (x[0] + s,), 1) for t, x, _ in plain for s in (-1, 0, 1)}
    at = model._projections(np.array([v.values], np.float32))[0] / 2 - np.array([x for _, x, _ in plain])
    t, x, _ = before[L]
    assert [j for j in range(k) if x[j] != plain[t][1][j]] == [int(np.minimum(at, 1 - at)[t].argmin())] and t == int(np.minimum(at, 1 - at).min(axis=1).argmin())


@pytest.mark.parametrize("inside, want", [
    # One coordinate: both sides, nearest first.
    ([[0.3]], [(0, (-1,)), (0, (1,))]),
    # The steps are a- 0.2, b- 0.4, b+ 0.65, a+ 0.8. The set a- b- meets b+ beside b-, then a+: both end. The set b- meets
    # b+, gives b- up and goes on to a+, with a sum of 1.2; a+ came before by itself, and a+ b- comes never.
    ([[0.2, 0.35]], [(0, (-1, 0)), (0, (0, -1)), (0, (-1, -1)), (0, (0, 1)), (0, (0 + 1, 0)), (0, (-1, 1)), (0, (1, 0)), (0, (1, 1))]),
    # Two tables share one order.
    ([[0.1], [0.3]], [(0, (-1,)), (1, (-1,)), (1, (1,)), (0, (1,))]),
])
def test_probes_followed_by_hand(inside, want):
    inside = np.array(inside)
    model = h.StableDistributions(3, *inside.shape, 1)
    got = model._probes(np.zeros(inside.shape, np.int64), inside, 99)
    assert [(t, x) for t, x, _ in got] == want


@pytest.mark.parametrize("mapping", [*DENSE, *SPARSE, CosineLsh(12, 300, 9), HammingLsh(40, 200, 16)], ids=str)
def test_terms_by_their_bytes(spark, mapping):
    from nearfield.operators.approximate import lookup_bytes, postings_of

    x, df = rows_of(spark, mapping, 12)
    model, postings = h.model_of(mapping), postings_of(df, h.model_of(mapping)).persist()
    rows = postings.collect()
    for term in sorted({(r["tbl"], tuple(r["hash"])) for r in rows})[::7]:
        raw = model.term_bytes(*term)
        assert term in model.terms_of(raw)
        same = {(r["id"], r["tbl"]) for r in rows if model.term_bytes(r["tbl"], tuple(r["hash"])) == raw}
        assert {(r["id"], r["tbl"]) for r in lookup_bytes(postings, model, raw).collect()} == same
    assert lookup_bytes(postings, model, b"123456789").count() == 0
    with pytest.raises(VectorError, match="doesn't support term queries with value of type .str."):
        lookup_bytes(postings, model, "term")


def test_models_are_shared_and_checked():
    assert h.model_of(CosineLsh(12, 5, 3)) is h.model_of(CosineLsh(12, 5, 3))
    with pytest.raises(VectorError):
        h.model_of(DenseFloatMapping(3))
    for bad in (lambda: CosineLsh(12, 5, 32), lambda: PermutationLsh(3, 4, True), lambda: L2Lsh(3, 0, 1, 1), lambda: L2Lsh(3, 1, 1, 0)):
        with pytest.raises(VectorError):
            bad()
    with pytest.raises(VectorError):
        h.model_of(HammingLsh(3, 5, 4))


@pytest.mark.parametrize("i", [0, 1, -1, 127, -127, 128, -128, 32767, -32767, 32768, -32768, 2**31 - 1, -(2**31)])
def test_int_codec(i):
    b = codecs.int_to_bytes(i)
    assert codecs.int_from_bytes(b) == i and len(b) == (1 if abs(i) < 128 else 2 if abs(i) < 32768 else 4)


def test_array_codecs():
    assert codecs.ints_from_bytes(codecs.ints_to_bytes([1, -2, 3], prefix=9)) == [9, 1, -2, 3]
    assert codecs.ints_from_bytes(codecs.ints_to_bytes([1, -2, 3]), 4, 8) == [-2, 3]
    assert codecs.floats_from_bytes(codecs.floats_to_bytes([0.5, -2.0])) == [0.5, -2.0]
