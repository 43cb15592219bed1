"""Language-model scores by subword lattices.

The pieces of an existing vocabulary are the arcs of a lattice over each word (a word is its characters after the mark
of a word's start; no piece reaches from one word into the next, so a text's lattice is the row of its words'). The
vocabulary's scores give its order (they are ranks, not log probabilities), and the order a first weight to every piece;
expected counts over the lattices of all training texts' words then estimate the weights anew, ROUNDS times; with rounds=0
the vocabulary's order alone weighs the segmentations. The probability of a text is the sum over all
its segmentations: forward recursion in log space, a word at a time, and an end.

Counting is one aggregation over the words of all texts. The lattices are run once for each distinct word. Texts are
scored by the values of their words: those of the HOT most frequent words are broadcast (a fixed number), the others
are joined by a 64-bit hash of the word.

Defined results: a null text is empty and has one token, its end; texts of any length are scored whole, and a very long
word by as many steps as it has characters; repeated rows count and are scored each; words of equal frequency are hot or
not by their spelling, which changes no score; with no training text every count is 0 and the pieces keep their first
weights; other columns of docs don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut, small_batches, table
from ._text import LOWER, chunks, hashes, mix, spans

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 5
HOT = 1 << 17
PRIOR = 1000.0
BYTE = 1e-5 / 256
CELLS = 1 << 18
WORDS = 40_000
_MARK = "▁"
_WS = "' \\t\\n\\u000b\\u000c\\r'"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_B, _SEED, _BITS = np.uint64(0x9E3779B97F4A7C17), np.uint64(0x1234567), np.uint64(1 << 20)


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * _B + code)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Vocabulary:
    """Pieces, found by a hash of their code points and length, and the weights that the vocabulary's scores imply."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in kept]
        rank = np.argsort(np.argsort([-sp.get_score(i) for i in kept], kind="stable"))
        first = 1.0 / (rank + 2.0)
        self.first = first / first.sum()
        self.longest = max(map(len, pieces))
        keys = np.zeros(len(pieces), np.uint64)
        for k in {len(p) for p in pieces}:
            of = [i for i, p in enumerate(pieces) if len(p) == k]
            codes = np.array([[ord(c) for c in pieces[i]] for i in of], np.uint64)
            h = np.full(len(of), _SEED, np.uint64)
            for j in range(k):
                h = _step(h, codes[:, j])
            keys[of] = h
        o = np.argsort(keys)
        self.keys, self.ids = keys[o], o.astype(np.int64)
        self.seen = np.zeros(_BITS, bool)  # most stretches of text are no piece; one look tells
        self.seen[keys % _BITS] = True

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ...: of each word (row) and place, the id of the piece of k characters from there, or -1."""
        n = codes.shape[1]
        out, h = [], np.full(codes.shape, _SEED, np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            h = _step(h[:, : n - k + 1], codes[:, k - 1 :])
            ids = np.full(h.shape, -1, np.int64)
            r, c = np.nonzero(self.seen[h % _BITS])
            if len(r):
                key = h[r, c]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ids[r, c] = np.where(self.keys[at] == key, self.ids[at], -1)
            out.append(ids)
        return out


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(0)) + safe


def gathered(batches: Iterator[pa.RecordBatch], rows: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` rows: the recursion runs over many words of a length at a time."""
    held, n = [], 0
    for b in batches:
        for i in range(0, b.num_rows, rows):
            held.append(b.slice(i, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def forward(v: Vocabulary, words: list[str], logp: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of each word's probability, over all segmentations; and, for counts, each piece's expected count.

    logp: of each piece, from v's ids; a character that is no piece costs BYTE for each byte of its UTF-8."""
    total, expected = np.zeros(len(words)), np.zeros(len(logp))
    marked = [_MARK + w for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(words))
    order = np.argsort(lens, kind="stable")
    padded = np.append(logp, -np.inf)
    i = 0
    while i < len(order):
        n = int(lens[order[i]])
        j = int(np.searchsorted(lens[order], n, "right"))
        j = min(j, i + max(1, CELLS // n))
        at = order[i:j]
        i = j
        codes = np.frombuffer("".join(marked[k] for k in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n).astype(np.uint64)
        ids = v.arcs(codes)
        cost = [padded[x] for x in ids]
        size = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
        cost[0] = np.where(ids[0] < 0, size * math.log(BYTE), cost[0])
        some = [k for k, x in enumerate(ids, 1) if k == 1 or (x >= 0).any()]
        alpha = np.full((n + 1, len(at)), -np.inf)
        alpha[0] = 0
        for e in range(1, n + 1):
            alpha[e] = _lse(np.stack([alpha[e - k] + cost[k - 1][:, e - k] for k in some if k <= e]))
        total[at] = alpha[n]
        if counts is None:
            continue
        beta = np.full((n + 1, len(at)), -np.inf)
        beta[n] = 0
        for s in range(n - 1, -1, -1):
            beta[s] = _lse(np.stack([cost[k - 1][:, s] + beta[s + k] for k in some if k <= n - s]))
        for k, x in enumerate(ids, 1):
            r, s = np.nonzero(x >= 0)
            if len(r):
                share = np.exp(alpha[s, r] + cost[k - 1][r, s] + beta[s + k, r] - alpha[n, r])
                expected += np.bincount(x[r, s], share * counts[at[r]], len(expected))
    return total, expected


def count_words(docs: DataFrame, trains: Column) -> DataFrame:
    """word, c (in training texts), n (in all): of every text's words, lower-cased A-Z; '' is the end of a text."""
    t = F.expr(f"array_remove(split(translate(coalesce(text, ''), concat({_WS}, '{_UP}'), concat('      ', '{_LOW}')), ' '), '')")
    x = docs.select(trains.cast("int").alias("train"), F.explode(F.concat(t, F.array(F.lit("")))).alias("word"))
    return x.groupBy("word").agg(F.sum("train").alias("c"), F.count("*").alias("n"))


def fit(words: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log weights of the pieces, and of the end, from words (word, c).

    Each round sums expected counts over the partitions: at most one row a piece comes to the driver."""
    v = vocabulary(path or default_path())
    seen = words.where("c > 0 and word != ''").select("word", "c")
    ends = words.where("word = ''").agg(F.sum("c")).first()[0] or 0
    p, end = v.first, 0.01
    for _ in range(rounds):
        logp = np.log(p * (1 - end))

        def f(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            v, sums = vocabulary(path or default_path()), 0.0
            for part in gathered(batches):
                sums = sums + forward(v, part.column(0).to_pylist(), logp, part.column(1).to_numpy().astype(float))[1]
            ids = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(np.atleast_1d(sums)[ids], pa.float64())], ["piece", "e"])

        rows = seen.mapInArrow(f, "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
        e = np.zeros(len(p))
        e[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        all_ = e.sum()
        p = (e + PRIOR * v.first) / (all_ + PRIOR)
        end = (ends + 0.5) / (ends + all_ + 1)
    return np.log(p * (1 - end)), math.log(end)


def word_values(words: DataFrame, model: tuple[np.ndarray, float], train_tokens: int, train_distinct: int, path: str | None = None) -> DataFrame:
    """word, key (its hash), c, n, base and lm: log10 of its probability by counts and by the lattice."""
    sent = words.sparkSession.sparkContext.broadcast(model)  # one float a piece of the vocabulary

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (logp, end) = vocabulary(path or default_path()), sent.value
        for part in gathered(batches):
            text = part.column(0).to_pylist()
            lm = forward(v, text, logp)[0]
            lm[[w == "" for w in text]] = end
            raw = [w.encode() for w in text]
            ends = np.cumsum([len(r) for r in raw])
            key = hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends).astype(np.int64)
            c = part.column(1).to_numpy().astype(float)
            base = np.log10((c + 0.5) / (train_tokens + 0.5 * (train_distinct + 1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), part.column(1), part.column(2), pa.array(base), pa.array(lm / math.log(10))], ["word", "key", "c", "n", "base", "lm"])

    return words.select("word", "c", "n").mapInArrow(f, "word string, key long, c long, n long, base double, lm double")


_DOC = "row long, doc_id long, n_tokens long, n_known long, base double, lm double, cold array<long>, times array<int>"


def score(docs: DataFrame, trains: Column, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    words = cut(count_words(docs, trains), "lattice-words")
    whole = words.agg(F.sum("c").alias("t"), F.sum(F.when(F.col("c") > 0, 1)).alias("v")).first()
    tokens, distinct = int(whole.t or 0), int(whole.v or 0)
    values = cut(word_values(words, fit(words, path), tokens, distinct, path), "lattice-values")
    top = values.orderBy(F.desc("n"), "word").limit(HOT).select("key", (F.col("c") > 0).cast("int").alias("k"), "base", "lm").toArrow()
    o = np.argsort(top.column(0).to_numpy(), kind="stable")
    hot = spark.sparkContext.broadcast(tuple(top.column(i).to_numpy()[o] for i in range(4)))  # at most HOT rows

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, base, lm = hot.value
        end = int(hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64)).astype(np.int64)[0])
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1)):
                low = LOWER[data]
                starts, ends, of = spans(low, offsets)
                h = np.concatenate([hashes(low, starts, ends).astype(np.int64), np.full(j - i, end)])
                of = np.concatenate([of, np.arange(j - i)])
                at = np.minimum(np.searchsorted(key, h), max(len(key) - 1, 0))
                found = key[at] == h
                sums = [np.bincount(of[found], x[at[found]], j - i) for x in (known, base, lm)]
                cold, of_cold = h[~found], of[~found]
                o = np.lexsort((cold, of_cold))
                cold, of_cold = cold[o], of_cold[o]
                new = np.flatnonzero(np.concatenate([[True], (cold[1:] != cold[:-1]) | (of_cold[1:] != of_cold[:-1])])) if len(cold) else cold
                edges = pa.array(np.searchsorted(of_cold[new], np.arange(j - i + 1)).astype(np.int32))
                times = np.diff(np.append(new, len(cold))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(j - i)), b.column(0)[i:j], pa.array(np.bincount(of, minlength=j - i)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                        pa.ListArray.from_arrays(edges, pa.array(cold[new])), pa.ListArray.from_arrays(edges, pa.array(times)),
                    ],
                    [c.split()[0] for c in _DOC.split(", ")],
                )
                row += j - i

    d = cut(docs.select("doc_id", "text").mapInArrow(f, _DOC), "lattice-docs")
    rare = d.select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("key"), F.col("x.times").alias("times"))
    rare = rare.join(values.select("key", "c", F.col("base").alias("b"), F.col("lm").alias("l")), "key")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("b")).alias("b"), F.sum(F.col("times") * F.col("l")).alias("l"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.join(rare, "row", "left").select(
        "doc_id", (~trains).alias("held_out"), "n_tokens", (F.col("n_known") + zero("k")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("lm") + zero("l")).alias("score"),
    )


def op7(spark, sf_dir):
    small_batches(spark)
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    return score(table(spark, sf_dir, "documents"), trains)
