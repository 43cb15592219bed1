"""The query algebra without data: folding, operators, accessors, serialisation."""

import pytest

from lumendex.operators.ast import Query as Q
from lumendex.operators.ast import QueryError

A, B, C = (Q.term(t, 1, i) for i, t in enumerate("abc", 1))


def test_folding():
    assert Q.of("AND", [A, Q.nothing()]).empty()
    assert Q.of("OR", [A, Q.nothing()]) == A
    assert Q.of("AND_NOT", [A, Q.all()]).empty()
    assert Q.of("OR", []).empty() and Q.of("AND", [A]) == A
    assert len(Q.of("OR", [Q.of("OR", [A, B]), C]).subs) == 3
    assert Q.value_range(1, "b", "a").empty()
    assert Q.value_ge(1, "").op == "ALL" and Q.value_range(1, "", "x").op == "VALUE_LE"
    assert (A ^ A).empty()


def test_operators_and_text():
    assert (A & ~B).describe() == "Query((a@1 AND_NOT b@2))"
    assert (A | B).describe() == "Query((a@1 OR b@2))"
    assert (2 * A).describe() == "Query(2 * a@1)" and (A / 2)["factor"] == 0.5
    assert Q.of("PHRASE", [A, B]).describe() == "Query((a@1 PHRASE 2 b@2))"
    assert ((A * 2) * 3)["factor"] == 6


def test_positional_operands():
    with pytest.raises(QueryError):
        Q.of("NEAR", [Q.of("AND", [A, B]), C])
    assert Q.of("NEAR", [Q.all(), A]).empty()
    with pytest.raises(QueryError):
        A.scale(-1)


def test_accessors_and_serialisation():
    q = Q.of("FILTER", [Q.of("OR", [B, A]), Q.value_range(1, "a", "b")])
    assert q.terms() == ["a", "b"] and q.length() == 2
    assert Q.unserialise(q.serialise()) == q
    assert Q.of("OR", [Q.term("x", 3), Q.wildcard("y*")]).length() == 4
    with pytest.raises(QueryError):
        Q.source(lambda c: None).serialise()
