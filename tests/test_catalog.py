"""The index of texts: what is made of each text where it lies, against the tables that tokens are shuffled to."""

import random

import pytest
from pyspark.sql import functions as F

from lumendex.operators import cluster
from lumendex.operators.ast import Query as Q
from lumendex.operators.enquire import Enquire
from lumendex.sources import catalog as cat
from lumendex.sources import writer


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(3)
    texts = ["the cat the dog The", None, "", "a b a c a don't ümlaut a", "x", "thing thong thign"] + [" ".join(rng.choice("the thing thins wing b cd der e").replace(" ", "x") + rng.choice(["", "ing", " der", " the"]) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "did long, text string").persist()
    new = cat.from_text(docs, {0: F.lit("s")})
    return new, cat.Catalog(new.documents, cat.postings_of(cat.tokens_of(docs)), new.values)


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "of",
    [
        lambda c: c.postings, lambda c: c.docstats, lambda c: c.termstats, lambda c: c.collstats, lambda c: c.counts, lambda c: c.lists(["the", "a", "zz"]), lambda c: c.lists([]), lambda c: c.posting_list("der"),
        lambda c: c.terms_where(lambda t: t.startswith("th")), lambda c: c.counts_where(lambda t: t.endswith("ing")), lambda c: c.postings_of(c.documents.where("did in (1, 4, 9)").select("did")),
        lambda c: c.counts_of(c.documents.where("did in (1, 4, 9)").select("did")), lambda c: c.position_list("the", 1), lambda c: c.kept().docstats, lambda c: c.kept().postings,
    ],
)
def test_texts_where_they_lie_give_the_tables_of_tokens(both, of):
    a, b = (of(c) for c in both)
    assert a.dtypes == b.dtypes and rows(a) == rows(b)


@pytest.mark.parametrize(
    "q",
    [
        Q.of("OR", [Q.term("thing"), Q.term("der")]), Q.of("PHRASE", [Q.term("a"), Q.term("c")]), Q.of("SYNONYM", [Q.term("the"), Q.term("der")]), Q.wildcard("th*"), Q.wildcard("w*ing*", combiner="MAX"), Q.wildcard("t*", 2, "MOST_FREQUENT", "OR"),
        Q.edit_distance("thing", 1, combiner="OR"), Q.edit_distance("thing", 1), Q.of("OR", [Q.wildcard("th*"), Q.term("der")]),
    ],
)
def test_queries_find_the_same(both, q):
    got, want = ([(r.did, round(r.w, 9), r.subqs) for r in Enquire(c, q).matches.orderBy("did").collect()] for c in both)
    assert got == want and got


def test_tokens_are_not_shuffled(both):
    c = both[0]
    for df in (c.docstats, c.postings, c.counts, c.lists(["the"]), c.counts_where(lambda t: t.startswith("th"))):
        assert "Exchange" not in plan(df)
    assert plan(c.termstats).split("Initial Plan")[-1].count("Exchange") == 1  # of terms, counted in their tasks
    assert "positions" not in plan(c.termstats)


def test_a_large_corpus_is_not_kept(spark, sf, monkeypatch):
    from lumendex import queries as engine

    monkeypatch.setattr(engine, "_OPEN", {})
    small = rows(engine.catalog(spark, sf).docstats)
    assert engine.catalog(spark, sf).postings.is_cached
    monkeypatch.setattr(engine, "_OPEN", {})
    monkeypatch.setattr(engine, "KEPT_BYTES", 0, raising=False)
    assert not engine.catalog(spark, sf).postings.is_cached and rows(engine.catalog(spark, sf).docstats) == small


def test_only_what_a_pattern_may_take_is_joined(both):
    """Filters on the dictionary hold for the postings too, before they meet it."""
    for c in both:
        x = Enquire(c, Q.wildcard("w*ing*", combiner="MAX")).matches
        assert plan(x).count("StartsWith") + plan(x).count("startswith") >= 2


def test_a_page_is_found_once(both, spark):
    for c in both:
        dids = c.documents.where("did > 6").select("did", F.rand().alias("r")).orderBy("r").limit(5)
        p = cluster.points(c, dids)  # another page each time it is looked for
        assert {r.did for r in p.collect()} == {r.did for r in p.select("did").distinct().collect()}
        assert cluster.cosine_distances(p).count() <= 10


def test_changes_know_their_statistics(both, spark):
    tokens = spark.createDataFrame([(1, "new", 2, 9), (1, "the", 1, 3), (1, "the", 1, 90), (4, "new", 1, None), (777, "gone", 1, 1)], "did long, term string, wdf_inc int, pos int")
    for c in both:
        for out in (writer.edited(c, tokens), writer.deleted(c, c.documents.where("did % 3 = 0")), writer.merged(c, cat.from_text(spark.createDataFrame([(3, "p q p"), (900, None)], "did long, text string")))):
            again = out.with_tables()  # statistics from the postings
            assert rows(out.docstats.select("did", "doclen", "uniq", "wdfmax")) == rows(again.docstats.select("did", "doclen", "uniq", "wdfmax"))
            own = again.postings.groupBy("did").agg(F.sum("wdf").alias("doclen")).join(again.docstats.select("did", F.col("doclen").alias("l")), "did")
            assert own.where("doclen != l").count() == 0
    a, b = (rows(writer.edited(c, tokens).postings) for c in both)
    assert a == b
    assert [(r.wdf, r.positions) for r in writer.edited(both[0], tokens).postings.where("did = 1 and term = 'the'").collect()] == [(5, [1, 3, 5, 90])]


def test_statistics_of_changes_shuffle_no_positions(both, spark):
    c = both[0]
    tokens = c.documents.where("did % 4 = 0").select("did", F.lit("new").alias("term"), F.lit(2).alias("wdf_inc"), F.lit(7).alias("pos"))
    assert "posexplode" not in plan(writer.edited(c, tokens).docstats) and "explode(positions" not in plan(writer.edited(c, tokens).docstats)
    new = cat.from_text(spark.createDataFrame([(3, "p q p")], "did long, text string"))
    assert "explode" not in plan(writer.merged(c, new).docstats)


def test_tasks_of_an_edit_grow_in_number(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1).alias("did"), "text")
    monkeypatch.setattr(writer, "EDITED_BYTES", 10_000)
    assert writer._parts(docs) > 4 and writer._parts(spark.createDataFrame([(1, "a")], "did long, text string").union(spark.range(1).selectExpr("id", "'a'"))) >= 4
