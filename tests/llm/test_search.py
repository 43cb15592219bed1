"""Nearest neighbours, Jaccard join, archives against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from lumendex.llm import ann, jaccard, warc


def test_ann_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24))
    x[100:140] = x[100]  # copies: ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    odd = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] + [1.0] * 23), (5080, [1.0] * 3), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    index, c = ann.build_index(df)
    assert index.count() == 3000
    found = {}
    for r in ann.search(index, c, index.where("vec_id % 20 = 0").select("vec_id", "embedding")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 20))
    hit = 0
    for q, got in found.items():
        got = sorted(got)
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        s = x @ x[q]
        assert np.allclose([g[2] for g in got], s[[g[1] for g in got]], rtol=1e-12)
        assert [(-round(g[2], 9), g[1]) for g in got] == sorted((-round(g[2], 9), g[1]) for g in got)
        s[q] = -np.inf
        hit += len({g[1] for g in got} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hit / (20 * len(found)) >= 0.97


def test_ann_few_and_none(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(0, 60, 20)], "vec_id long, embedding array<float>")
    index, c = ann.build_index(df)
    assert ann.search(index, c, index.select("vec_id", "embedding")).count() == 6
    index, c = ann.build_index(df.limit(0))
    assert ann.search(index, c, index.select("vec_id", "embedding")).count() == 0


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed,k,num,den", [(1, 3, 90, 100), (2, 5, 8, 10), (3, 3, 90, 100), (4, 2, 6, 10)])
def test_jaccard_components(spark, seed, k, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "ELEMENTS", 300)
    monkeypatch.setattr(jaccard, "QUERIES", 8)
    monkeypatch.setattr(jaccard, "MEMBERS", 8)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 5)
    monkeypatch.setattr(jaccard, "BLOCK", [50, 1 << 20][seed % 2])
    monkeypatch.setattr(jaccard, "BUCKET", 500)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, ""), (1, None), (2, " \n"), (3, "A"), (4, "a")]
    for _ in range(18):
        text = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 4, 9, 20, 33, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 4, 25])):
            w = list(text)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((len(rows), " ".join(w + w[: rnd.choice([0, 0, 0, 1])])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, k, (num, den)).collect()}
    assert got == brute(rows, k, num, den)


def test_jaccard_odd_rows(odd, none):
    rows = jaccard.join(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.component_id for r in rows}
    assert by[None] is None and by[8] == 4 and by[1] == 1 and by[2] == 2
    kept = jaccard.filter_documents(odd, 3, (90, 100))
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert jaccard.join(none).count() == 0 and jaccard.filter_documents(none).count() == 0


def test_jaccard_one_id_several_texts(docs):
    """Rows of one id with unlike texts are documents of their own; none is lost, whatever the other is linked with."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    df = docs([(5, words(1), "en", "a"), (5, words(2), "en", "a"), (3, words(2) + " end", "en", "a"), (5, words(1), "en", "a"), (7, words(3), "en", None)])
    df = df.withColumnRenamed("size", "text_key")
    got = sorted((r.doc_id, r.text) for r in jaccard.filter_documents(df).collect())
    assert got == [(3, words(2) + " end"), (5, words(1)), (7, words(3))]
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect()) == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 7)]


def test_jaccard_repeated_rows_do_not_meet(docs, spark):
    """20000 equal rows under one id: one class, no task holds their texts together."""
    df = spark.range(20_000).selectExpr("7L as doc_id", "'a b c d e f g' as text").unionByName(spark.createDataFrame([(8, "a b c d e f g h i j k l m n")], "doc_id long, text string"))
    rows = jaccard.join(df).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, rows)) == [(7, 7, 20_000), (8, 8, 1)]
    assert jaccard.filter_documents(df).count() == 2


def test_archives(spark, tmp_path):
    rows = [(i, f"http://h{i}/", ["<a>", "<b>", "", None, f"<p>{i}é</p>" * 50][i % 5]) for i in range(60)] + [(None, None, "<a>"), (7, "again", "<q>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"{tmp_path}/w"
    warc.write_archives(df, path, frame=500, bundle=2000)
    back = warc.read_archives(spark, path).collect()
    best = {}
    for i, _, h in rows:
        best.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = best[h or ""]
        first = max((x for x in same if x is not None), default=None) if len(same) > 1 else None
        kind = "response" if first is None or first == i else "revisit"
        want.append((i or -1, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, first if kind == "revisit" else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back], key=key) == sorted(want, key=key)
    places = warc.index(spark, path)
    assert places.count() == len(rows)
    hit = warc.lookup(spark, path, places.where("record = '14'")).collect()
    assert len(hit) == 1 and hit[0].block.endswith(b"</p>") and hit[0].headers["WARC-Type"] == "response"


def test_bundle_is_plain_zstandard(spark, tmp_path):
    import zstandard

    b = warc.Bundler(frame=100)
    for i in range(20):
        b.add(str(i), warc.record("response", str(i), "u", b"x" * i, i, "D", None))
    raw = b.finish() + warc._END
    z = warc.Bundle(raw)
    assert len(z.places()) == 20 and len(z.frames) > 3
    name, frame, offset = z.places()[13]
    assert z.read(frame, offset)[0]["WARC-Record-ID"] == "<urn:page:13>"
    whole = b"".join(z.frame(k) for k in range(len(z.frames) - 1))
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == whole


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0
