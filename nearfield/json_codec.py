"""The JSON forms of vectors, mappings and queries.

Keys may come in any order, and unknown ones are skipped. The type of a mapping is accepted with any prefix
(`x_dense_float_vector`), and its options are the one object in it, under whatever name.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import mapping as m
from . import query as q
from .errors import ParseError
from .vectors import DENSE, SPARSE, DenseFloat, Empty, Indexed, Similarity, SparseBool, Vector

#: The names that the JSON forms allow.
MODELS = ("exact", "lsh", "permutation_lsh")
TYPES = (m.DENSE_TYPE, m.SPARSE_TYPE)


def token(x: Any) -> str:
    if isinstance(x, bool):
        return "VALUE_BOOLEAN"
    kinds = ((dict, "START_OBJECT"), (list, "START_ARRAY"), (str, "VALUE_STRING"), (int, "VALUE_NUMBER"), (float, "VALUE_NUMBER"))
    return next((name for kind, name in kinds if isinstance(x, kind)), "VALUE_NULL")


def _expect(x: Any, *kinds: str, name: str = "") -> Any:
    if token(x) not in kinds:
        raise ParseError(f"Expected {f'[{name}]' if name else 'token'} to be one of [{','.join(kinds)}] but found [{token(x)}]")
    return x


def _one_of(x: str, allowed, name: str = "") -> str:
    if x not in allowed:
        raise ParseError(f"Expected {f'[{name}]' if name else 'token'} to be one of [{','.join(allowed)}] but found [{x}]")
    return x


def _numbers(x: list) -> list:
    return [_expect(v, "VALUE_NUMBER") for v in x]


def _unable(what: str) -> ParseError:
    return ParseError(f"Unable to construct [{what}] from parsed JSON")


def _loaded(x: Any) -> Any:
    if not isinstance(x, (str, bytes)):
        return x
    try:
        return json.loads(x)
    except ValueError as e:
        raise ParseError(str(e)) from e


def similarity_from_json(x: Any) -> Similarity:
    text = _expect(x, "VALUE_STRING")
    lower = "cosine" if text.lower() == "angular" else text.lower()
    if lower not in (allowed := [s.value for s in Similarity]):
        _one_of(text, allowed)
    return Similarity(lower)


def vector_from_json(x: Any) -> Vector:
    """A dict, a list or their text. A pointer is preferred to a sparse vector, and that to a dense one."""
    x = _loaded(x)
    _expect(x, "START_ARRAY", "START_OBJECT")
    if isinstance(x, list):
        if not x:
            return DenseFloat(())
        if _expect(x[0], "END_ARRAY", "START_ARRAY", "VALUE_NUMBER") is x[0] and isinstance(x[0], list):
            return SparseBool(tuple(_numbers(x[0])), _expect(x[1] if len(x) > 1 else None, "VALUE_NUMBER"))
        return DenseFloat(tuple(_numbers(x)))
    kinds = {"field": "VALUE_STRING", "id": "VALUE_STRING", "index": "VALUE_STRING", "true_indices": "START_ARRAY", "total_indices": "VALUE_NUMBER", "values": "START_ARRAY"}
    has = {k: _expect(v, kinds[k], name=k) for k, v in x.items() if k in kinds}
    if not x:
        return Empty()
    if {"field", "id", "index"} <= has.keys():
        return Indexed(has["index"], has["id"], has["field"])
    if {"true_indices", "total_indices"} <= has.keys():
        return SparseBool(tuple(_numbers(has["true_indices"])), has["total_indices"])
    if "values" in has:
        return DenseFloat(tuple(_numbers(has["values"])))
    raise _unable("vector")


def mapping_from_json(x: Any) -> m.Mapping:
    x = _expect(_loaded(x), "START_OBJECT")
    kind, options = None, {}
    for k, v in x.items():
        if k == "type":
            text = _expect(v, "VALUE_STRING", name=k)
            kind = next((t for t in TYPES if text == t or text.endswith("_" + t)), None) or _one_of(text, TYPES, k)
        elif k == "options" or isinstance(v, dict):
            options = _expect(v, "START_OBJECT", name=k)
    kinds = {"dims": "VALUE_NUMBER", "L": "VALUE_NUMBER", "k": "VALUE_NUMBER", "w": "VALUE_NUMBER", "model": "VALUE_STRING", "repeating": "VALUE_BOOLEAN"}
    has: dict = {}
    for k, v in options.items():
        if k in kinds:
            has[k] = _expect(v, kinds[k], name=k)
        if k == "model":
            _one_of(v, MODELS, k)
        if k == "similarity":
            has[k] = similarity_from_json(v)
    forms = {
        (m.DENSE_TYPE, "exact", None): m.DenseFloatMapping,
        (m.SPARSE_TYPE, "exact", None): m.SparseBoolMapping,
        (m.SPARSE_TYPE, "lsh", Similarity.JACCARD): m.JaccardLsh,
        (m.SPARSE_TYPE, "lsh", Similarity.HAMMING): m.HammingLsh,
        (m.DENSE_TYPE, "lsh", Similarity.COSINE): m.CosineLsh,
        (m.DENSE_TYPE, "lsh", Similarity.L2): m.L2Lsh,
        (m.DENSE_TYPE, "permutation_lsh", None): m.PermutationLsh,
    }
    model = has.get("model", "exact")
    form = forms.get((kind, model, has.get("similarity") if model == "lsh" else None))
    try:
        return form(**{k: has[k] for k in form.__dataclass_fields__})
    except (AttributeError, KeyError):
        raise _unable("mapping") from None


def query_from_json(x: Any) -> q.Query:
    """probes must be given for the l2 similarity; exact queries skip candidates."""
    x = _expect(_loaded(x), "START_OBJECT")
    kinds = {"candidates": "VALUE_NUMBER", "probes": "VALUE_NUMBER", "field": "VALUE_STRING", "model": "VALUE_STRING"}
    has: dict = {}
    for k, v in x.items():
        if k in kinds:
            has[k] = _expect(v, kinds[k], name=k)
        if k == "model":
            _one_of(v, MODELS, k)
        if k == "similarity":
            has[k] = similarity_from_json(v)
        if k == "vec":
            has[k] = vector_from_json(v)
    forms = {Similarity.COSINE: q.CosineLshQuery, Similarity.HAMMING: q.HammingLshQuery, Similarity.JACCARD: q.JaccardLshQuery, Similarity.L2: q.L2LshQuery}
    form = {"exact": q.Exact, "lsh": forms.get(has.get("similarity")), "permutation_lsh": q.PermutationLshQuery}.get(has.get("model"))
    try:
        if "similarity" not in has:
            raise KeyError("similarity")
        return form(**{k: has[k] for k in form.__dataclass_fields__})
    except (AttributeError, KeyError):
        raise _unable("nearest neighbors query") from None


def dense_from_json(text: Column) -> Column:
    """A column of JSON texts as dense vectors: {"values": [...]} or [...]; other texts are null."""
    return F.coalesce(F.from_json(text, "struct<values:array<float>>")["values"], F.from_json(text, DENSE))


def sparse_from_json(text: Column) -> Column:
    """A column of JSON texts as sparse vectors: the object, or [[...], n]; other texts are null."""
    whole = F.from_json(text, SPARSE)
    short = F.regexp_extract(text, r"^\s*\[\s*(\[[^\]]*\])\s*,\s*\d+\s*\]\s*$", 1)
    total = F.regexp_extract(text, r"^\s*\[\s*\[[^\]]*\]\s*,\s*(\d+)\s*\]\s*$", 1)
    brief = F.struct(F.from_json(short, "array<int>").alias("true_indices"), total.try_cast("int").alias("total_indices"))
    return F.when(whole["true_indices"].isNotNull() & whole["total_indices"].isNotNull(), whole).when(short != "", brief)
