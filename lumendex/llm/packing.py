"""Packing token pieces into sequences of at most CAPACITY tokens: best fit, then swap-based local search.

Documents are tokenised once; only (doc_id, piece, start, length, crc) goes further. Pieces are dealt by a hash into
groups of about GROUP; a group that is far longer (repeated rows) is dealt again by the rows' places in the table. In
each group the pieces, longest first, go to the fullest sequence that still holds them; then the local search takes the
underfull sequences and exchanges one piece for one, two for one, or moves a piece whenever that raises the sum of squared
fills, so that full ones get fuller and the emptiest run empty. The emptiest sequences, of GROUP / FAN pieces at most, give
their pieces to a next round, which packs those of FAN groups together, until one group is left. So every group is
bounded, whatever share of the rows a source or a length has, and though no sequence of it may be full.

Ids are those of the library. Words met before come from a table in the worker; a text with special strings, or with
characters beyond the ranges whose classes are certain, goes to the library whole.

Defined results: a null text counts as empty; an empty text is one piece, its end id 0; a text of any length is
tokenised whole and cut into pieces; repeated rows and repeated ids are documents of their own; pieces of equal length
take whichever place comes first, one is as good as another; columns of docs of any name don't matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cut, small_batches, table

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
GROUP = 20_000
FAN = 16
LEVELS = 64
HOT = 1 << 16
UNDERFULL = 0.995
REMEMBER = 1_000_000

# Latin text: which characters are letters and numbers is the same in every version of Unicode.
_LETTER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_BLANK = "\t-\r \u0085\u00a0"
_PLAIN = re.compile("[\t-\r -~\u00a0-\u012f\u0132-\u017f]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and words are short work for threads
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.library = Tokenizer.from_file(path)
        # for words that are already lower-case and cut: the library's merges without its own preparation
        parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": next(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")}
        self.words = Tokenizer.from_str(json.dumps(parts))
        self.known: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.words.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words not met before go to the library, those of all texts in one call.

        No word goes beyond a blank, so plain texts are cut at blanks, and what lies between two is cut into words once.
        What is no word itself is not remembered: words with marks beside them are many more than words."""
        whole = ["<|" in t or not _PLAIN.fullmatch(t) for t in texts]
        runs = [[] if w else t.lower().split() for w, t in zip(whole, texts)]
        if len(self.known) > REMEMBER:
            self.known.clear()
        known = self.known
        cut_ = {r: [r] if r.isalpha() else _WORDS.findall(r) for r in set().union(*runs).difference(known)}
        new = list(set().union(*cut_.values()).difference(known))
        known.update(zip(new, self._ids(new)))
        get = known.__getitem__
        passing = {r: b"".join(map(get, ws)) for r, ws in cut_.items() if r not in known}
        known.update(passing)
        out = [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") if w else np.frombuffer(b"".join(map(get, rs)), "<u4") for w, t, rs in zip(whole, texts, runs)]
        for r in passing:
            del known[r]
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._text import chunks

        e = encoder(path or default_path())
        for b in batches:
            text = b.column(1)
            for i, j, _, _ in chunks(text, 1 << 22):
                row, piece, start, length, crc = [], [], [], [], []
                for k, ids in enumerate(e.encode([t or "" for t in text[i:j].to_pylist()]), i):
                    ids = np.append(ids, np.array([END], "<u4")).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        row.append(k), piece.append(p), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that is left
    rooms: list[int] = []  # those in use, ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            r = rooms[at]
            b = room[r].pop()
            if not room[r]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if not room[r - n]:
            insort(rooms, r - n)
        room[r - n].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, underfull: float = UNDERFULL) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each of which raises the sum of squared fills, until none is left.

    Pieces of n tokens in all leave a bin with room r for another, and a piece of m < n comes back, or none (m = 0): a
    move, one for one, two for one. This raises the sum if the other bin has n to n + r - 1 tokens free without the piece
    of m. So bins are listed by that, for each of their lengths and for 0, and the tightest partner is looked up among
    all. The emptiest bins come first, so that they run empty."""
    size = lengths.tolist()
    low = int(capacity * underfull)
    full = [b for b in bins if sum(size[i] for i in b) >= low]
    open_ = [b for b in bins if sum(size[i] for i in b) < low]
    fill = [sum(size[i] for i in b) for b in open_]
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (m, bin) by what the bin has free without m
    least = np.full(capacity + 1, capacity + 1)  # the least m of each

    def list_(b: int) -> None:
        for m in {0, *(size[i] for i in open_[b])} if open_[b] else ():
            at = capacity - fill[b] + m
            insort(free[at], (m, b))
            least[at] = free[at][0][0]

    def unlist(b: int) -> None:
        for m in {0, *(size[i] for i in open_[b])} if open_[b] else ():
            at = capacity - fill[b] + m
            del free[at][bisect_left(free[at], (m, b))]
            least[at] = free[at][0][0] if free[at] else capacity + 1

    def step(b: int) -> bool:
        """An exchange for a bin that is not listed itself."""
        room = capacity - fill[b]
        mine = {size[i]: i for i in open_[b]}
        order = sorted(mine, reverse=True)

        def swap(n: int, out: list[int], below: int) -> bool:
            fits = least[n : n + room] < below
            at = int(fits.argmax())
            if not fits[at]:
                return False
            m, t = free[n + at][0]
            unlist(t)
            back = [next(j for j in open_[t] if size[j] == m)] if m else []
            for x, y, some in ((b, t, out), (t, b, back)):
                for i in some:
                    open_[x].remove(i)
                    open_[y].append(i)
            fill[t] += n - m
            fill[b] -= n - m
            list_(t)
            return True

        if any(swap(n, [mine[n]], 1) for n in order) or any(swap(n, [mine[n]], n) for n in order):
            return True
        pairs = {}
        for x, n in enumerate(order):
            twin = next((i for i in open_[b] if size[i] == n and i != mine[n]), None)
            pairs.update({n + k: [mine[n], mine[k]] for k in order[x + 1 :]})
            if twin is not None:
                pairs[2 * n] = [mine[n], twin]
        return any(swap(n, out, n) for n, out in pairs.items())

    for b in range(len(open_)):
        list_(b)
    changed = True
    while changed:
        changed = False
        for b in sorted(range(len(open_)), key=fill.__getitem__):
            unlist(b)
            while open_[b] and fill[b] < low and step(b):
                changed = True
            list_(b)
    return full + [b for b in open_ if b]


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, sequence_id long, offset long, final boolean"


def _pack_group(capacity: int, level: int, last: bool, groups: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        low, grp = int(capacity * UNDERFULL), int(pdf["grp"].iloc[0])
        # the emptiest go on, as many as keep the next level's groups as short as this one's
        goes, left = set(), GROUP // FAN
        for k in sorted((k for k, b in enumerate(bins) if lengths[b].sum() < low), key=lambda k: lengths[bins[k]].sum()):
            left -= len(bins[k])
            if last or left < 0:
                break
            goes.add(k)
        sequence, offset, final = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64), np.ones(len(pdf), bool)
        for k, b in enumerate(bins):
            n = lengths[b]
            sequence[b] = (k * groups + grp) * LEVELS + level
            offset[b] = np.cumsum(n) - n
            final[b] = k not in goes
        pdf["sequence_id"], pdf["offset"], pdf["final"] = sequence, offset, final
        return pdf

    return f


def assign(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces_ with sequence_id and offset."""
    x = cut(pieces_, "packing-pieces", narrow=True)
    n = x.count()
    groups = max(1, -(-n // GROUP))
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    x = x.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))
    # groups much longer than a hash of unlike rows makes them; any beyond the HOT longest holds less than one row in HOT
    hot = x.groupBy("grp").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * GROUP).orderBy(F.desc("rows"), "grp").limit(HOT)
    hot = cut(hot.select("grp", F.ceil(F.col("rows") / GROUP).alias("parts")), "packing-hot")
    if parts := hot.agg(F.max("parts")).first()[0]:
        x = x.join(F.broadcast(hot), "grp", "left").withColumn("grp", F.col("grp") * parts + F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))))
        groups *= parts
    empty = lambda d: d.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "final": F.lit(False)})
    x = empty(x).select(*names)
    done, level = [], 0
    while True:
        last = groups == 1
        packed = cut(x.groupBy("grp").applyInPandas(_pack_group(capacity, level, last, groups), _SCHEMA), f"packing-{level}")
        done.append(packed.where("final"))
        if last:
            break
        level, groups = level + 1, max(1, -(-groups // FAN))
        x = packed.where("not final").withColumn("grp", F.expr(f"grp div {FAN}"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("grp", "final")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs."""
    return assign(pieces(docs, path, capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9(spark, sf_dir):
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"))
