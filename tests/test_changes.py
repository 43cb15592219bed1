"""Snapshots, mutation, streams, tools and registered queries."""

from datetime import date

from pyspark.sql import functions as F

from lumendex import queries, tools
from lumendex.operators.ast import Query as Q
from lumendex.operators.enquire import Enquire
from lumendex.plans import request
from lumendex.sources import catalog as cat
from lumendex.sources import ingest, writer
from lumendex.streaming import ingest as streaming


def make(d):
    tokens = cat.tokens_of(d, "text").unionByName(cat.boolean_tokens(d, "Q", F.col("key")))
    return cat.Catalog(d.select("did", F.col("text").alias("data")), cat.postings_of(tokens), cat.values_of(d, {0: F.col("key")}))


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key string, text string")


def state(c):
    return {r.did: r.data for r in c.documents.collect()}


def test_snapshots_and_upserts(spark, tmp_path):
    db = writer.Database(spark, f"{tmp_path}/db")
    db.commit(db.added(rows(spark, [("a", "one two"), ("b", "two three"), ("c", "four")]), make))
    reader = writer.Database(spark, f"{tmp_path}/db")
    assert (db.revision, db.last_did, state(reader.catalog)) == (1, 3, {1: "one two", 2: "two three", 3: "four"})
    db.commit(writer.replaced_by_term(db.catalog, rows(spark, [("b", "new"), ("z", "zed")]), "Q", make, db.last_did))
    assert state(reader.catalog)[2] == "two three" and reader.reopen() and not reader.reopen()
    assert state(reader.catalog) == {1: "one two", 2: "new", 3: "four", 4: "zed"}
    db.commit(writer.deleted_by_term(db.catalog, "Qd"))
    db.commit(writer.deleted_by_term(db.catalog, "Qz"))
    db.commit(db.added(rows(spark, [("y", "why")]), make))
    assert max(state(db.catalog)) == 5  # the id of a deleted document is not used again
    assert db.catalog.checked().count() == 0
    before = db.revision
    db.commit(db.catalog, batch="b1")
    db.commit(db.catalog, batch="b1")
    assert db.revision == before + 1


def test_edit_and_compact(spark):
    c = make(rows(spark, [("a", "one two"), ("b", "two")]).withColumn("did", F.when(F.col("key") == "a", 1).otherwise(2).cast("long")))
    more = spark.createDataFrame([(2, "new", 3, 9)], "did long, term string, wdf_inc int, pos int")
    e = writer.edited(c, more)
    assert e.checked().count() == 0
    assert {r.term: r.wdf for r in e.term_list(2).collect()} == {"Qb": 0, "two": 1, "new": 3}
    e = writer.removed_terms(e, spark.createDataFrame([(2, "two")], "did long, term string"))
    assert e.checked().count() == 0 and e.term_list(2).count() == 2
    m = writer.compacted([c, c])
    assert sorted(state(m)) == [1, 2, 3, 4] and m.checked().count() == 0


def test_index_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows(spark, [("a", "one"), ("b", "two")]).coalesce(1).write.parquet(src)
    db = writer.Database(spark, f"{tmp_path}/db")

    def run():
        s = spark.readStream.schema("key string, text string").parquet(src)
        streaming.index_stream(s, db, make, checkpoint=f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        db.reopen()

    run()
    assert sorted(state(db.catalog).values()) == ["one", "two"]
    rows(spark, [("b", "changed"), ("c", "three")]).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(state(db.catalog).values()) == ["changed", "one", "three"] and db.catalog.checked().count() == 0


def test_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert streaming.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()
    assert streaming.sessions(e).agg(F.sum("n")).first()[0] == e.count()


def test_scripted_dump(spark, tmp_path):
    (tmp_path / "d.txt").write_text("id=1\ntext=Hello World\n\nid=2\ntext=World\nsize=30\n")
    x = ingest.read_dump(spark, str(tmp_path / "d.txt")).withColumn("did", F.element_at(F.element_at("fields", "id"), 1).cast("long"))
    c = ingest.scripted(x, "id : unique=Q\ntext : spell index field\nsize : valuenumeric=1\n")
    assert {r.did for r in Enquire(c, Q.term("world")).matches.collect()} == {1, 2}
    assert c.checked().count() == 0 and {r.word: r.freq for r in c.spelling.collect()} == {"hello": 1, "world": 2}
    assert [r.num for r in c.values.collect()] == [30.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>T</title><p>body &lt;x</p>")
    (tmp_path / "b.csv").write_text('a,"b c",d')
    got = {r.path.rsplit("/", 1)[1]: (r.type, r.title, r.text) for r in ingest.files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": ("text/html", "T", "body <x"), "b.csv": ("text/csv", "", "a b c d")}


def test_request_parts():
    q = request.date_terms(date(1999, 12, 30), date(2001, 2, 2))
    assert q.terms() == ["Dlatest", "D19991230", "D19991231", "Y2000", "M200101", "D20010201", "D20010202"]
    assert request.filters(["XA:x", "XA:y", "Hz"]).describe() == "Query((Hz AND (XA:x OR XA:y)))"
    assert request.span({"END": ["20200110"], "SPAN": ["3"]}) == (date(2020, 1, 8), date(2020, 1, 10))


def test_tools(spark, tmp_path, capsys):
    make(rows(spark, [("a", "one two")]).withColumn("did", F.lit(1).cast("long"))).save(f"{tmp_path}/i")
    assert tools.main(["check", f"{tmp_path}/i"]) == 0
    assert tools.main(["quest", f"{tmp_path}/i", "one"]) == 0
    assert tools.main(["compact", f"{tmp_path}/i", f"{tmp_path}/i", f"{tmp_path}/o"]) == 0
    assert tools.main(["delve", f"{tmp_path}/o", "-t", "one"]) == 0
    out = capsys.readouterr().out
    assert "No errors" in out and "Parsed query: Query(one@1)" in out


def test_pushdown(spark, tmp_path, sf):
    queries.catalog(spark, sf).save(f"{tmp_path}/i")
    c = cat.Catalog.open(spark, f"{tmp_path}/i")
    plan = Enquire(c, Q.of("OR", ["the", "of"])).matches._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan and plan.count("positions") == plan.split("== Physical Plan ==")[0].count("positions")


def test_registered_queries_have_sql(spark, sf):
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) > 150
    assert queries.QUERIES["bm25_or_top10"](spark, sf).count() == 10
