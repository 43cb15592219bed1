"""What lies on disk while queries run: tables go when nothing reads them, and texts meet groups in rounds."""

import gc
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from lumendex.llm import _store, jaccard, quality


def _tables(spark):
    return {p.name.rsplit("-", 1)[0] for p in Path(_store.shared_dir(spark).removeprefix("file:"), "lumendex").glob("*")}


def _swept(spark, until):
    for _ in range(20):  # the JVM learns a little later what Python let go
        gc.collect()
        spark.range(1).count()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        _store.sweep(spark)
        if until():
            return True
    return False


def test_a_stage_leaves_no_table_behind(spark, docs):
    text = " ".join(f"w{k}" for k in range(80))
    kept = quality.filter_documents(docs([(1, text, "en", "a"), (2, "short", "en", "a")]))
    later = kept.select("doc_id")
    del kept
    assert not _swept(spark, lambda: "quality-rows" not in _tables(spark))  # a plan still reads it
    assert [r.doc_id for r in later.collect()] == [1]
    del later
    assert _swept(spark, lambda: "quality-rows" not in _tables(spark))


def test_keys_are_dropped_before_nodes_meet(spark, docs, monkeypatch):
    """The shuffles of all later steps don't lie beside the keys of all documents."""
    seen, links = [], jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda d, met, *a: seen.append("marks" in _tables(spark)) or links(d, met, *a))
    assert _swept(spark, lambda: "marks" not in _tables(spark))
    assert jaccard.join(docs([(1, "a b c d", "en", "a"), (2, "a b c d", "en", "a")])).count() == 2
    assert seen == [False]


def test_a_product_of_texts_is_shuffled_in_rounds(spark, docs, monkeypatch):
    """Variants of a text, half of them linked to few: these meet all groups of the family, so more text is compared than there is."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = base[:]
        for at in rng.sample(range(120), 2 if i < 80 else 6):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    df = docs(rows)
    monkeypatch.setattr(jaccard, "ELEMENTS", 1000)
    monkeypatch.setattr(jaccard, "QUERIES", 8)
    monkeypatch.setattr(jaccard, "MEMBERS", 8)
    monkeypatch.setattr(jaccard, "HOT_ROWS", 5)
    found = lambda: {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    whole, sizes, verify = found(), [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda x, rule: sizes.append(x.agg(F.sum(F.octet_length("text"))).first()[0] or 0) or verify(x, rule))
    monkeypatch.setattr(jaccard, "ROUND", 1, raising=False)
    assert found() == whole
    texts = sum(len(t) for _, t, *_ in rows)
    assert sum(sizes) > 3 * texts and max(sizes) < 2 * texts
