"""Matching on a corpus small enough to check by hand or by sets."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumendex.functions import weights as W
from lumendex.functions.editdist import osa_distance
from lumendex.operators.ast import Query as Q
from lumendex.operators.ast import QueryError
from lumendex.operators.enquire import Enquire
from lumendex.sources.catalog import Catalog, from_text

TEXTS = {1: "the cat sat on the mat", 2: "the dog sat", 3: "a cat and a dog and the cat", 4: "fish", 5: "", 6: "mat cat"}


@pytest.fixture(scope="module")
def cat(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, v, "en" if k % 2 else "", k % 3) for k, v in TEXTS.items()], "did long, text string, lang string, n int")
    c = from_text(docs, {0: F.col("lang"), 1: F.col("n")})
    return c.with_tables(postings=c.postings.persist())


def dids(c, q, **o):
    return sorted(r.did for r in Enquire(c, q, **o).matches.collect())


def words(k):
    return set(TEXTS[k].split())


def test_sets(cat):
    assert dids(cat, Q.of("AND", ["cat", "the"])) == [1, 3]
    assert dids(cat, Q.of("OR", ["cat", "fish"])) == [1, 3, 4, 6]
    assert dids(cat, Q.of("XOR", ["cat", "dog", "the"])) == [3, 6]
    assert dids(cat, Q.of("AND_NOT", ["cat", "the"])) == [6]
    assert dids(cat, Q.of("AND_MAYBE", ["cat", "dog"])) == [1, 3, 6]
    assert dids(cat, Q.all()) == [1, 2, 3, 4, 5, 6] and dids(cat, Q.nothing()) == []
    assert dids(cat, Q.value_le(0, "zz")) == [1, 3, 5] and dids(cat, Q.value_ge(0, "")) == [1, 2, 3, 4, 5, 6]
    assert dids(cat, Q.number_range(1, 1.0, 2.0)) == [1, 2, 4, 5]


def test_positions(cat):
    assert dids(cat, Q.of("PHRASE", ["cat", "sat"])) == [1]
    assert dids(cat, Q.of("PHRASE", ["the", "mat"], 6)) == [1]
    assert dids(cat, Q.of("PHRASE", ["mat", "cat"], 9)) == [6]
    assert dids(cat, Q.of("NEAR", ["mat", "cat"], 2)) == [6]
    assert dids(cat, Q.of("NEAR", ["cat", "cat"], 8)) == [3]
    assert dids(cat, Q.of("NEAR", ["cat", "cat"], 3)) == []


def test_expansion(cat):
    assert dids(cat, Q.wildcard("?at")) == [1, 2, 3, 6]
    assert dids(cat, Q.wildcard("c*t", combiner="OR")) == [1, 3, 6]
    assert dids(cat, Q.edit_distance("cta", 1)) == [1, 3, 6]
    with pytest.raises(QueryError):
        dids(cat, Q.wildcard("*", 2))


def test_bm25_by_hand(cat):
    w = {r.did: r.w for r in Enquire(cat, Q.term("fish")).matches.collect()}
    n, avl = 6, sum(len(t.split()) for t in TEXTS.values()) / 6
    tw = (n - 1 + 0.5) / 1.5
    assert math.isclose(w[4], math.log(tw) * 2 / (0.5 * max(1 / avl, 0.5) + 0.5 + 1))
    common = {r.did: r.w for r in Enquire(cat, Q.term("the")).matches.collect()}
    assert all(v > 0 for v in common.values())  # half of the documents: bent, not negative


def test_synonym_clamp(cat):
    one = {r.did: r.w for r in Enquire(cat, Q.of("SYNONYM", ["fish", "fish"])).matches.collect()}
    assert set(one) == {4} and one[4] > 0


def test_sort_and_collapse(cat):
    e = Enquire(cat, Q.all(), sort="value", slot=0)
    assert [r.did for r in e.mset(0, 6).orderBy("rank").collect()] == [2, 4, 6, 1, 3, 5]
    e = Enquire(cat, Q.all(), sort="value", slot=0, reverse=True, collapse_slot=0)
    rows = {r.did: r.collapse_count for r in e.ranked().collect()}
    assert rows == {1: 2, 2: 0, 4: 0, 6: 0}  # unset keys never collapse


def test_percent(cat):
    rows = {r.did: r.percent for r in Enquire(cat, Q.of("OR", ["cat", "dog"])).mset(0, 6, percent=True).collect()}
    assert rows[3] == 100 and all(1 <= p <= 100 for p in rows.values())


def test_schemes(cat):
    for name, w in W.SCHEMES.items():
        rows = Enquire(cat, Q.of("OR", ["cat", "dog"]), w()).matches.collect()
        assert {r.did for r in rows} == {1, 2, 3, 6}, name
        assert all(math.isfinite(r.w) for r in rows), name
    assert W.create("bm25 1.2 0 1 0.75").b == 0.75
    with pytest.raises(ValueError):
        W.create("none")


def test_empty(spark):
    c = Catalog.empty(spark)
    assert dids(c, Q.all()) == [] and c.checked().count() == 0


def test_union_and_checks(cat):
    u = Catalog.union([cat, cat])
    assert sorted(r.did for r in u.documents.collect()) == list(range(1, 13))
    assert cat.checked().count() == 0 and u.checked().count() == 0
    assert {r.did: r.text for r in cat.reconstruct_text().collect()}[2] == "the dog sat"


TERMS = st.sampled_from(["cat", "dog", "the", "mat", "fish", "none"])
TREES = st.recursive(TERMS.map(Q.term), lambda s: st.tuples(st.sampled_from(["AND", "OR", "XOR", "AND_NOT", "AND_MAYBE", "FILTER", "MAX"]), st.lists(s, min_size=2, max_size=3)).map(lambda x: Q.of(*x)), max_leaves=5)


def by_sets(q):
    if q.op == "NOTHING":
        return set()
    if q.op == "TERM":
        return {k for k in TEXTS if q["term"] in words(k)}
    xs = [by_sets(s) for s in q.subs]
    first, rest = xs[0], xs[1:]
    if q.op in ("AND", "FILTER"):
        return set.intersection(*xs)
    if q.op in ("OR", "MAX"):
        return set.union(*xs)
    if q.op == "AND_NOT":
        return first - set.union(*rest)
    if q.op == "XOR":
        return {k for k in TEXTS if sum(k in x for x in xs) % 2}
    return first


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(TREES)
def test_algebra_is_set_algebra(cat, q):
    assert dids(cat, q) == sorted(by_sets(q))


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa(a, b):
    def slow(i, j):
        if not i or not j:
            return i + j
        best = min(slow(i - 1, j) + 1, slow(i, j - 1) + 1, slow(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, slow(i - 2, j - 2) + 1)
        return best

    d = slow(len(a), len(b)) if len(a) + len(b) <= 8 else None
    if d is not None:
        assert osa_distance(a, b) == d
        assert osa_distance(a, b, 1) == min(d, 2)
