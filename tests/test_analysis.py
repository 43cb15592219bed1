"""The term generator over columns: bounded frames, counts, and the one rule by expression and by character."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumendex.functions import analysis
from lumendex.functions.analysis import CHUNK, STOPWORDS, TermGenerator, tokenize

ODD = "AAbBcC..'’&+#,;·10²½٣é _-ßİΣς日本́­‌‿٠ \n״‧"


class Docs:
    """In the place of a DataFrame: what would be run over its batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def groupBy(self, *_):
        return self

    agg = groupBy

    def mapInArrow(self, f, _):
        self.f = f
        return self


@pytest.mark.parametrize("make", ["tokens", "counts"])
def test_frames_are_bounded_whatever_the_batch(spark, make):
    docs = Docs(spark)
    getattr(TermGenerator("english", "some"), make)(docs)
    texts = [" ".join(f"w{d}x{i}" for i in range(50_000)) for d in range(4)]
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(texts)], names=["did", "text"])
    sizes = [b.num_rows for b in docs.f(iter([batch]))]
    assert sum(sizes) == 2 * 4 * 50_000 and max(sizes) <= 2 * (CHUNK + 50_000)
    assert len(sizes) > 1 and (make == "counts" or max(sizes) <= CHUNK)


@pytest.mark.parametrize("gen", [TermGenerator("none", "none", ngrams=True), TermGenerator("english", "some", tuple(STOPWORDS["english"])), TermGenerator("english", "all_z", ("the",), "all")])
def test_counts_are_those_of_tokens(spark, monkeypatch, gen):
    monkeypatch.setattr(analysis, "PIECE", 20)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(ODD + "the running dogs  ") for _ in range(300))) for i in range(40)] + [(98, ""), (99, None), (100, "x" * 100 + " U.S.A. AT&T’s C++ 1,000.5")]
    docs = spark.createDataFrame(rows, "did long, text string")
    want = gen.tokens(docs).groupBy("term").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, gen.counts(docs).collect())) == sorted(map(tuple, want.collect()))


def test_both_ways_find_the_same_words():
    rng = random.Random(2)
    for k in range(20_000):
        x = "".join(rng.choice(ODD[: 24 if k % 2 else None]) for _ in range(12))
        for ngrams in (False, True):
            assert list(tokenize(x, ngrams)) == list(analysis._by_characters(x, ngrams)), x


def test_pieces_are_the_text(monkeypatch):
    monkeypatch.setattr(analysis, "PIECE", 7)
    for x in ("", "short", "a bb ccc dddd eeeee\nffffff", "x" * 50, "x" * 50 + " y"):
        assert "".join(analysis._pieces(x)) == x


def test_texts_come_in_batches_of_bytes(spark):
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > 0
    TermGenerator().tokens(spark.createDataFrame([(1, "a")], "did long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= analysis.BATCH_BYTES


def test_pages_go_back_in_bounded_frames(spark, monkeypatch):
    monkeypatch.setattr(analysis, "PAGES", 1000)
    docs = Docs(spark)
    analysis.extracted(docs, html=True)
    pages = [f"<title>T {i}</title><p>{'word ' * 100}</p>" for i in range(50)] + [None]
    batch = pa.record_batch([pa.array(range(51), pa.int64()), pa.array([f"u{i}" for i in range(51)]), pa.array(pages, pa.string())], names=["page_id", "url", "html"])
    out = list(docs.f(iter([batch])))
    assert max(b.num_rows for b in out) <= 3 and sum(b.num_rows for b in out) == 51
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["title"] for r in rows] == [f"T {i}" for i in range(50)] + [""] and [r["html"] for r in rows] == pages


def test_pages_meet_their_text_without_a_join(spark):
    from lumendex.sources import ingest

    pages = spark.createDataFrame([(1, "http://h/x", "<title>A b</title><p>c c</p>"), (2, "http://h/y", None)], "page_id long, url string, html string")
    c = ingest.pages_catalog(pages)
    assert "Join" not in c.documents._jdf.queryExecution().executedPlan().toString()
    got = {r.term: (r.termfreq, r.collfreq) for r in c.termstats.collect()}
    assert got["Sa"] == (1, 5) and got["c"] == (1, 2) and got["Hh"] == (2, 0) and got["Uhttp://h/y"] == (1, 0)
