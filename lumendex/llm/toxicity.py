"""Toxicity by multiple-instance learning: sentences are instances, a document's label is all that is known.

A sentence's score is a logistic function of the words in it that weigh something, 0 if it has none; a document's is
the noisy-or of its sentences' and of a leak, the chance of the label without a bad sentence, so one bad sentence is
enough and length alone never makes a document toxic. The weights are trained from document labels alone by the likelihood of the noisy-or, and so
learn which sentences are to blame; the sentences above SENTENCE are returned with their places.

The classifier is fitted on at most SAMPLE labelled documents of each label, those with the smallest hashes of their
id, while their texts are SAMPLE_BYTES in all; of an id with several texts one teaches. Words are runs of letters and digits (and all bytes beyond ASCII), lower-cased, known by a 64-bit hash; labels,
language, source and id are never inputs.

Defined results: texts of any length are scored whole; columns of docs of any name are only carried, those beyond text
are no input; ties of a score don't matter. A null or empty text has one sentence without words and gets the leak as its score; documents
labelled twice count as toxic if either label says so; null labels teach nothing; without labels of both kinds every
score is 0; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import small_batches, table
from ._text import LOWER, chunks, hashes, mix, spans

SAMPLE = 2500
SAMPLE_BYTES = 32 << 20
THRESHOLD = 0.7
SENTENCE = 0.5
EPOCHS = 200
RATE = 0.15
L2 = 1e-4
LEAST_SHARE = 0.02
CLEAN_WEIGHT = 3

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True

Model = tuple[np.ndarray, np.ndarray, float, float]
_OUT = "doc_id long, n_sentences long, score double, predicted int, offending array<struct<start:long,end:long,score:double>>"


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each sentence (bytes): to a stop, or the end of the text; every text has at least one."""
    ends = np.flatnonzero(_STOP[data]) + 1
    cuts = np.unique(np.concatenate([ends, offsets[1:][offsets[1:] > offsets[:-1]]]))
    empty = np.flatnonzero(offsets[1:] == offsets[:-1])
    row = np.searchsorted(offsets, cuts - 1, "right") - 1
    starts = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
    starts, cuts, row = np.concatenate([starts, offsets[empty]]), np.concatenate([cuts, offsets[empty]]), np.concatenate([row, empty])
    o = np.argsort(row, kind="stable")
    return starts[o].astype(np.int64), cuts[o].astype(np.int64), row[o].astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sentence of each distinct word in it, the word's hash, the sentences)."""
    at = sentences(data, offsets)
    low = LOWER[data]
    starts, ends, _ = spans(low, offsets, _APART)
    word = hashes(low, starts, ends)
    full = np.flatnonzero(at[1] > at[0])  # words lie in sentences that are not empty
    of = full[np.searchsorted(at[0][full], starts, "right") - 1] if len(starts) else starts
    first = np.sort(np.unique(mix(word ^ mix(of.astype(np.uint64))), return_index=True)[1])
    return of[first], word[first], at


def training_rows(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, sample: int = SAMPLE) -> list[tuple[int, bytes, bytes]]:
    """(label, words of each sentence, buckets) of at most `sample` documents of each label."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    if may_learn is not None:
        y = y.where(may_learn)
    order = (F.xxhash64("doc_id"), "doc_id")
    y = y.where("__y = 1").orderBy(*order).limit(sample).unionByName(y.where("__y = 0").orderBy(*order).limit(sample))
    x = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")  # at most 2 * sample narrow rows
    # a text an id, chosen where its rows lie and then among those: repeated rows don't add up
    x = x.groupBy("doc_id").agg(F.first("__y").alias("__y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    w = Window.partitionBy("__y").orderBy(*order)
    x = x.withColumn("__b", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(w)).where(F.col("__b") <= SAMPLE_BYTES).select("__y", "text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(0).to_pylist()
            for i, j, data, offsets in chunks(b.column(1)):
                of, word, (_, _, row) = features(data, offsets)
                first = np.searchsorted(row, np.arange(j - i + 1))
                lens = np.bincount(of, minlength=len(row))
                words = np.concatenate([[0], np.cumsum(lens)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(label[i:j], pa.int32()),
                        pa.array([lens[a:z].astype(np.int32).tobytes() for a, z in zip(first, first[1:])], pa.binary()),
                        pa.array([word[words[a] : words[z]].tobytes() for a, z in zip(first, first[1:])], pa.binary()),
                    ],
                    ["y", "lens", "words"],
                )

    return [tuple(r) for r in x.mapInArrow(f, "y int, lens binary, words binary").collect()]


def train(rows: list[tuple[int, bytes, bytes]]) -> Model | None:
    """Hashes and weights of the words that weigh something, the bias and the leak, by Adam on the noisy-or's cross-entropy, both labels weighing the same."""
    if len({y for y, _, _ in rows}) < 2:
        return None
    rows = sorted(set(rows))  # copies of a document teach once
    y = np.array([r[0] for r in rows], float)
    lens = np.concatenate([np.frombuffer(r[1], np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) // 4 for r in rows])
    hash_, word = np.unique(np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]), return_inverse=True)
    sentence = np.repeat(np.arange(len(lens)), lens)
    # words weigh something if they are clearly more frequent in toxic documents than in others
    pair = np.unique(word.astype(np.int64) * len(y) + doc[sentence])
    share = [np.bincount(pair[y[pair % len(y)] == k] // len(y), minlength=len(hash_)) / (y == k).sum() for k in (0, 1)]
    del pair
    least = max(LEAST_SHARE, 0.5 / np.sqrt(y.sum()))
    seen = (share[1] - CLEAN_WEIGHT * share[0] >= least)[word]
    word, sentence = word[seen], sentence[seen]
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    words, w, b, _ = _descend(y, weigh, doc, word, sentence)
    strong = np.isin(word, words[1 / (1 + np.exp(-b - w)) >= SENTENCE / 2])  # the rest would only add up in long texts
    words, w, b, leak = _descend(y, weigh, doc, word[strong], sentence[strong])
    return hash_[words], w, b, leak


def _descend(y, weigh, doc, word, sentence) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Words, weights, bias and leak. Only sentences with a word that weighs something are instances."""
    words, word = np.unique(word, return_inverse=True)
    said, at = np.unique(sentence, return_inverse=True)
    of = doc[said]
    w, b, leak = np.full(len(words), 1.0), -2.0, -2.0
    m, v = np.zeros(len(words) + 2), np.zeros(len(words) + 2)
    for t in range(1, EPOCHS + 1):
        z = b + np.bincount(at, w[word], len(said))
        none = np.bincount(of, np.logaddexp(0, z), len(y)) + np.logaddexp(0, leak)  # minus log of the odds of no reason
        slope = weigh * np.where(y == 1, -1 / np.expm1(np.maximum(none, 1e-9)), 1.0)
        g = slope[of] / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.concatenate([np.bincount(word, g[at], len(words)) + L2 * w, [g.sum() + L2 * b, slope.sum() / (1 + np.exp(-leak))]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * min(1.0, 3 * (1 - t / (EPOCHS + 1)))
        w, b, leak = w - step[:-2], b - step[-2], leak - step[-1]
    return words, w, float(b), float(leak)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_sentences, score, predicted, offending (places in bytes of UTF-8, scores) of each row of docs."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # at most 1 / LEAST_SHARE words a word of a document: small, whatever the corpus

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, data, offsets in chunks(b.column(1)):
                yield _scored(ids[i:j], data, offsets, weights.value, threshold)

    return docs.select("doc_id", "text").mapInArrow(f, _OUT)


def _scored(ids, data, offsets, model, threshold) -> pa.RecordBatch:
    of, word, (start, end, row) = features(data, offsets)
    n = len(offsets) - 1
    if model is None:
        p, none = np.zeros(len(row)), np.zeros(n)
    else:
        words, weights, bias, leak = model
        at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
        known = words[at] == word if len(words) else np.zeros(len(word), bool)
        z = bias + np.bincount(of[known], weights[at[known]] if len(words) else None, len(row))
        z[np.bincount(of[known], minlength=len(row)) == 0] = -np.inf
        p, none = 1 / (1 + np.exp(-np.clip(z, -700, 700))), np.bincount(row, np.logaddexp(0, z), n) + np.logaddexp(0, leak)
    total = -np.expm1(-none)
    bad = np.flatnonzero((p >= SENTENCE) & (total[row] >= threshold))
    first = np.searchsorted(row[bad], np.arange(n + 1)).astype(np.int32)
    spots = pa.StructArray.from_arrays([pa.array(start[bad] - offsets[row[bad]]), pa.array(end[bad] - offsets[row[bad]]), pa.array(p[bad])], ["start", "end", "score"])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.bincount(row, minlength=n)), pa.array(total), pa.array((total >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(first), spots)],
        ["doc_id", "n_sentences", "score", "predicted", "offending"],
    )


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None) -> Model | None:
    return train(training_rows(docs, labels, may_learn))


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text the model does not take for toxic."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, _remainder(3) != 1)
    weights = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(at)):
                keep = _scored(pa.nulls(j - i), data, offsets, weights.value, threshold).column(3)
                yield b.slice(i, j - i).filter(pa.compute.equal(keep, 0))

    return docs.mapInArrow(f, docs.schema)


def op6(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_sentences", "offending")
