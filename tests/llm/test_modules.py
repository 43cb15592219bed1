"""Each name of a module is defined once: a later definition would silently stand for an earlier one."""

import ast
import random
from collections import Counter
from pathlib import Path

import pytest

import lumendex.llm
from lumendex.llm import jaccard


@pytest.mark.parametrize("path", sorted(Path(lumendex.llm.__file__).parent.glob("*.py")), ids=lambda p: p.name)
def test_names_are_defined_once(path):
    named = (ast.FunctionDef, ast.ClassDef)
    scopes = [n for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, (ast.Module, ast.ClassDef))]
    for scope in scopes:
        names = Counter(n.name for n in scope.body if isinstance(n, named))
        assert not [k for k, n in names.items() if n > 1]


def test_the_first_in_order_leads_its_key(spark):
    """Not the smallest node: the one that meets most others is first in order."""
    rows = [(1, 10, True, 7), (1, 20, True, 3), (1, 5, False, 1), (2, 30, True, 2), (3, 40, False, 1), (3, 50, False, 2)]
    listed = spark.createDataFrame(rows, "key long, node long, own boolean, order long")
    assert [tuple(r) for r in jaccard._led(listed).collect()] == [(1, 20, 3)]


def test_equal_rows_leave_a_task_once(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(2, "c d")], "doc_id long, text string").coalesce(1)
    marks = jaccard.signed(docs, jaccard.Rule(3, (90, 100)))
    facts = marks.select("node", "doc_id", "text_key").distinct()
    got = jaccard.texts_of(docs, facts, facts.select("node")).select("text").collect()
    assert sorted(r.text for r in got) == ["a b", "c d"]


def test_a_family_is_not_split_by_its_keys_leaders(spark, docs, monkeypatch):
    """Copies of a text with few to many words changed: under a key they ask about a family or a few, not about one for each leader."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base), "en", "a")]
    for i in range(1, 400):
        words = base[:]
        for _ in range(rng.randrange(2, 9)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    made, spread = [], jaccard.spread

    def counted(left, right, key, *by):
        out = spread(left, right, key, *by)
        if key == "key" and "family" in right.columns:
            made.append((left.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "spread", counted)
    assert jaccard.join(docs(rows)).count() == 400
    (asked, met), = made
    assert asked > 1000 and met <= 4 * asked
