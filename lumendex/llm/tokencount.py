"""Token counts of a BPE sentence-piece model by rank-synchronous merging of ragged numpy arrays.

A text is cut into pre-tokens across which no piece of the vocabulary reaches: a run of spaces with what follows it,
and control characters that only occur as bytes. Pre-tokens not met before in this worker are laid end to end as one
array of symbols; in each round every sequence merges its pair of lowest rank, wherever it stands (from the left, where
two overlap), all sequences at once, until no pair is a piece. A merge makes pairs of higher rank only, so this is the order
one at a time; of the few pieces of which that isn't true the leftmost alone is merged. After a round only the pairs beside
merges are looked up, so a very long pre-token takes as many rounds as it has unlike pairs, not symbols. What survives is
counted: one for a known symbol, its UTF-8 bytes for another.

Defined results: a null text counts as empty: no bytes, no tokens. Texts and pre-tokens of any length are counted whole
by the same rounds, and the count never depends on how texts are batched. Rows are independent: repeated rows get equal
counts, other columns of docs don't matter, empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import small_batches, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
REMEMBER = 1 << 19
CHARS = 1 << 21
_SPACE = "▁"
_NONE = np.iinfo(np.int64).max


class Counter:
    """Counts tokens as the library does for this vocabulary, a pre-token at a time."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kept = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in kept}
        pieces = list(self.rank)
        order = sorted(range(len(pieces)), key=lambda k: (self.rank[pieces[k]], k))
        self.ids = {pieces[k]: n for n, k in enumerate(order)}  # equal scores: first listed first; ids are ranks
        ranks = np.array([self.rank[pieces[k]] for k in order])
        self.level = np.concatenate([[0], np.cumsum(np.diff(ranks) > 0)])  # pairs of equal score are equal in rank
        left, right, to = [], [], []
        for p, n in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(n)
        key = np.array(left, np.int64) * (1 << 32) + np.array(right, np.int64)
        o = np.argsort(key)
        self.key, self.to = key[o], np.array(to, np.int64)[o]
        part = np.concatenate([left, right]).astype(np.int64)
        long = np.array([len(pieces[k]) > 1 for k in order])[part]
        back = self.level[np.concatenate([to, to]).astype(np.int64)] <= self.level[part]
        self.late = np.zeros(self.level[-1] + 1, bool)  # levels of pieces that are part of a pair of no higher rank
        self.late[self.level[part[back & long]]] = True
        inside = {c for p in pieces if len(p) > 1 for c in p}
        alone = [c for c in "\n\t\r" if c not in inside]
        crossed = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        cut = re.escape("".join(alone))
        self.split = None if crossed else re.compile(f"{_SPACE}*[^{_SPACE}{cut}]+|{_SPACE}+" + (f"|[{cut}]" if cut else ""))
        self.known: dict[str, int] = {}

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level and symbol of what each pair merges to; _NONE if it is no piece."""
        pair = np.where((a >= 0) & (b >= 0), a * (1 << 32) + b, -1)
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        hit = self.key[at] == pair
        to = np.where(hit, self.to[at], 0)
        return np.where(hit, self.level[to], _NONE), to

    def merged(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word, all words merged at once."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        chars = "".join(words)
        distinct = {c: self.ids.get(c, -len(c.encode())) for c in set(chars)}  # not a piece: minus its bytes
        symbol = np.fromiter(map(distinct.__getitem__, chars), np.int64, len(chars))
        owner = np.repeat(np.arange(len(words)), lens)
        total = np.zeros(len(words), np.int64)
        if not len(symbol):
            return total
        level, to = (np.append(x, e) for x, e in zip(self._pairs(symbol[:-1], symbol[1:]), (_NONE, 0)))
        level[:-1][owner[1:] != owner[:-1]] = _NONE
        while len(symbol):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(owner)))
            low = np.minimum.reduceat(level, heads)  # the lowest rank of each sequence
            keep = np.repeat(low != _NONE, sizes)
            over = ~keep
            if over.any():
                total += np.bincount(owner[over], np.where(symbol[over] < 0, -symbol[over], 1), len(words)).astype(np.int64)
            take = np.flatnonzero(keep & (level == np.repeat(low, sizes)))
            if len(take):
                # of a row of overlapping pairs every other one; of late pieces the leftmost
                run = np.flatnonzero(np.concatenate([[True], take[1:] != take[:-1] + 1]))
                odd = (np.arange(len(take)) - np.repeat(run, np.diff(np.append(run, len(take))))) % 2 == 1
                first = np.concatenate([[True], owner[take][1:] != owner[take][:-1]])
                take = take[~odd & (first | ~self.late[level[take]])]
                symbol[take] = to[take]
                keep[take + 1] = False
            at = np.cumsum(keep)[take] - 1  # where the merged symbols are after this
            symbol, owner, level, to = symbol[keep], owner[keep], level[keep], to[keep]
            if len(at):
                at = np.unique(np.concatenate([at, at[at > 0] - 1]))
                inside = at[at < len(symbol) - 1]
                level[inside], to[inside] = self._pairs(symbol[inside], symbol[inside + 1])
                level[at[at == len(symbol) - 1]] = _NONE
                level[inside[owner[inside] != owner[inside + 1]]] = _NONE
        return total

    def pretokens(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = _SPACE + text.replace(" ", _SPACE)
        return self.split.findall(escaped) if self.split else [escaped]

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = list({w for ws in cut for w in ws if w not in self.known})
        ends, at = np.cumsum([len(w) for w in new]), 0
        while at < len(new):
            to = min(at + 20_000, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, "right"))))
            self.known.update(zip(new[at:to], self.merged(new[at:to]).tolist()))
            at = to
        return [sum(map(self.known.__getitem__, ws)) for ws in cut]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._text import chunks

        c = counter(path or default_path())
        for b in batches:
            text = b.column(1)
            for i, j, _, offsets in chunks(text, 1 << 22):
                n = np.array(c.count([t or "" for t in text[i:j].to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10(spark, sf_dir):
    small_batches(spark)
    return token_counts(table(spark, sf_dir, "documents"))
