"""Toxicity, lattice scores, packing, token counts, the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumendex.llm import lattice, packing, queries, tokencount, toxicity

SPLIT = re.compile(r"[\x20\x09-\x0d]+")


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op6(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    bad = [r for r in rows if r.toxic == 1]
    good = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in bad) / len(bad) > 0.7
    assert sum(r.predicted for r in good) / len(good) < 0.02
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_spans_and_edges(docs, odd, none, spark):
    rows = [(i, f"fine words w{i} here. " + ("you utter moron! " if i % 4 == 0 else "kind of nice! ") + "the end.", "en", "a") for i in range(200)]
    df = docs(rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    for r in toxicity.score(df, model).collect():
        assert r.predicted == int(r.doc_id % 4 == 0)
        text = rows[r.doc_id][1].encode()
        assert [text[s.start : s.end].decode().strip() for s in r.offending] == (["you utter moron!"] if r.predicted else [])
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.fit(df, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_long_clean_text_stays_clean(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    df = docs([(i, ("rude " if i % 2 else "") + "plain text follows. " * 3, "en", "a") for i in range(100)])
    model = toxicity.fit(df, labels)
    long = docs([(0, "plain text follows. " * 20_000, "en", "a")])
    assert toxicity.score(long, model).first().predicted == 0


def test_lattice_base_and_marginals(spark, odd, none):
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    rows = lattice.score(odd, trains).collect()
    src = odd.collect()
    tok = lambda t: [w for w in SPLIT.split(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if w] + [""]
    learn = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 != 1
    c = Counter(w for r in src if learn(r.doc_id) for w in tok(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id or 0, not learn(r.doc_id), len(tok(r.text)), sum(c[w] > 0 for w in tok(r.text)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(r.text)), 3)) for r in src)
    got = sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lattice.score(none, trains).count() == 0


def test_lattice_without_learning(spark, odd):
    """rounds=0: the vocabulary's order alone weighs the segmentations."""
    trains = F.lit(True)
    words = lattice.count_words(odd.where("doc_id != 6"), trains)
    logp, end = lattice.fit(words, rounds=0)
    v = lattice.vocabulary(lattice.default_path())
    assert np.allclose(np.exp(logp), v.first * (1 - math.exp(end))) and math.exp(end) == pytest.approx(0.01)


def test_lattice_forward_is_the_sum_over_segmentations():
    v = lattice.vocabulary(lattice.default_path())
    logp = np.log(v.first)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lattice.default_path())
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    price = {sp.id_to_piece(i): logp[k] for k, i in enumerate(ids)}

    def total(s):
        if not s:
            return 1.0
        out = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in price:
                out += math.exp(price[s[:k]]) * total(s[k:])
            elif k == 1:
                out += lattice.BYTE ** len(s[:1].encode()) * total(s[1:])
        return out

    words = ["the", "thing", "éa", "日x", "a", "zzzz"]
    got, expected = lattice.forward(v, words, logp, np.ones(len(words)))
    assert np.allclose(got, [math.log(total("▁" + w)) for w in words])
    assert expected.sum() >= len(words)


def test_packing_is_whole(docs, odd, spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.default_path())
    rows = packing.pack(odd).collect()
    want = {}
    for r in odd.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            key = (r.doc_id, p, s, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places(rows)


def check_places(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_rounds(spark, monkeypatch, none):
    monkeypatch.setattr(packing, "GROUP", 50)
    monkeypatch.setattr(packing, "FAN", 2)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, 0, 0, int(n), 7) for i, n in enumerate(rng.integers(1, 900, 600))], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.assign(df).collect()
    assert len(rows) == 600
    n = check_places(rows)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) + 3
    assert packing.pack(none).count() == 0


def test_packing_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 200)
    seen = spark.sparkContext.accumulator(0)
    real = packing._pack_group

    def watched(*a):
        f = real(*a)

        def g(pdf):
            if len(pdf) > 900:
                seen.add(1)
            return f(pdf)

        return g

    monkeypatch.setattr(packing, "_pack_group", watched)
    df = spark.range(5000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "100L as length", "9L as ids_crc32")
    rows = packing.assign(df).collect()
    assert len(rows) == 5000 and check_places(rows) <= math.ceil(5000 / 20) + 1 and not seen.value


def test_toxicity_sample_is_bounded(docs, spark, monkeypatch):
    """A labelled id in many rows teaches once, and texts beyond the bound don't."""
    rows = [(1, "rude words. ", "en", "a")] * 2000 + [(2, "kind words. ", "en", "a"), (3, "rude words. " * 400, "en", "a")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs(rows), labels)) == 3
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    assert sorted(r[0] for r in toxicity.training_rows(docs(rows), labels)) in ([0], [0, 1])


def test_toxicity_score_is_the_noisy_or(docs, spark):
    """Scores recomputed in plain Python from the model's weights, a sentence and a word at a time."""
    df = docs([(i, f"fine words w{i} here. " + ("you utter moron! " if i % 3 == 0 else "kind of nice! ") + "the end", "en", "a") for i in range(120)] + [(500, None, "en", "a"), (501, "moron", "en", "a")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    words, weights, bias, leak = model
    price = dict(zip(words.tolist(), weights.tolist()))

    def word_hash(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(toxicity.hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    for r in df.collect():
        good = 1 - sig(leak)
        for s in re.split(r"(?<=[.!?\n])", r.text or ""):
            found = [price[h] for h in {word_hash(w) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", s.lower())} if h in price]
            good *= 1 - sig(bias + sum(found)) if found else 1
        assert got[r.doc_id] == pytest.approx(1 - good, abs=1e-9)


def test_local_search_empties_bins():
    lengths = np.array([5, 5, 6, 4, 3, 7, 2, 8])
    bins = [[i] for i in range(8)]
    out = packing.local_search(bins, lengths, 10)
    assert sorted(i for b in out for i in b) == list(range(8)) and len(out) == 4
    assert all(lengths[b].sum() <= 10 for b in out)


def test_token_counts(odd, none, spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_path())
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(odd).collect())
    want = sorted((r.doc_id or 0, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in odd.collect())
    assert got == want
    assert tokencount.token_counts(none).count() == 0
    c = tokencount.counter(tokencount.default_path())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", " ", "a  b ", "\n\n a\tb", "ab" * 900, "   x", "12 345"]
    assert c.count(texts) == [len(x) for x in sp.encode(texts)]
    assert 0 < c.late.mean() < 0.2
    rng = np.random.default_rng(2)
    long = ["a" * 70_001, "ab" * 30_000 + "c", "".join(map(chr, rng.integers(97, 123, 40_000))), "".join(rng.choice(list("etaoin▁ésß日"), 20_000))]
    assert c.count(long) == [len(x) for x in sp.encode(long)]
    few = [w for t in texts[:40] for w in c.pretokens(t)]
    together = c.merged(few).tolist()
    before, c.late = c.late, np.ones_like(c.late)
    assert c.merged(few).tolist() == together  # the leftmost alone, one a round
    c.late = before


def test_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    x, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        y = stage(spark, x, sf)
        assert y.columns == docs.columns
        x = y.persist()
        seen.append(x.count())
    assert docs.count() >= seen[0] >= seen[1] >= seen[2] > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, x, sf).collect()
    check_places(rows)
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(rows)
