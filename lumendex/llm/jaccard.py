"""Exact joins of documents by the Jaccard similarity of their word shingles, with a token-group matrix.

1. Every document's set of shingles (64-bit hashes) is made from its whole text. Equal sets are one class, a node of
   what follows, known by 64 bits of its fingerprint (of 10^10 different sets about three pairs share theirs, as
   shingles themselves may).
2. Candidates come from the pigeonhole principle. Sets of a size class whose similarity reaches the threshold differ
   in at most H elements; when hashes deal all elements into m > H parts, at least m - H parts are equal in both. So a
   set is listed under a key for each part that isn't empty, and similar sets meet under m - H - e keys at least, e
   being the empty parts of the one with fewer. m leaves room for the usual e; a set with more lists its empty parts
   too. Sets near the lower edge of their class are also listed under the keys of the class below, as it deals them.
   Most keys are listed once and go no further: keys are shuffled once, packed, each key of a block of documents by one
   of its classes, so a key that all documents list is a row a block; what else a block holds of a key that it lists
   for several classes is known to meet there. Sets that meet others under too few keys to be linked with any are out.
3. Under each key the node that meets most others, under all its keys together, leads; every node is compared with those of its leaders with which it shares as
   many keys as their sizes call for, not with each other. The links that hold give components.
4. Similar nodes make groups: those whose leaders are led by the same one (the first in order), in chunks of about ELEMENTS tokens, a component at a
   time. A group is stored with the union of its members' tokens. A node that met nodes of other components, under as many
   keys of theirs together as a link calls for, is a query to the groups of those nodes' leaders: the tokens that it
   shares with the union bound what it shares with any member, and only groups whose bound reaches the overlap that the
   threshold calls for are opened and compared member by member.
5. Components of all links.

Joins deal the rows of their commonest keys by a hash and repeat the other side (spread()), so that no key, leader,
hub, group or class lands in one task, whatever its share.

So every link between different components is found, and none that is implied by others need be: work within a large
family of near copies grows with its size, not with its square, but for documents that are like a family and linked
to none of it, which meet its groups. No candidate is dropped or capped. (That last case is a product: documents that
share a key with a family and are linked to none of it, times the family's groups. Its texts are shuffled in rounds, so
it takes time but not more disk; the keys of all documents are dropped once it is known which of them meet.)

Defined results: a null or empty text has no shingles and is linked with nothing, its component is its own id; a text
of fewer words than a shingle is one shingle; texts of any length are taken whole, one of more than 512 KB by itself;
rows of one doc_id with unlike texts are documents of their own; a row with a null doc_id takes no part and has a null
component; equal rows are one class; columns of docs beyond doc_id and text may have any names and are only carried; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, drop, fresh, small_batches, table
from ._text import LOWER, chunks, hashes, mix, spans, trim

U = np.uint64
GROWTH = 1.5
ELEMENTS = 1 << 19
MEMBERS = 512
QUERIES = 2048
FILTER_WORDS = 1 << 18
BLOCK = 1 << 18
BUCKET = 1 << 19
ROUND = 1 << 30
HOT_ROWS = 1000
HOT_KEYS = 1 << 16
MOST_SUBS = 4096


class Rule:
    """Words in a shingle, and the least similarity as a fraction num / den."""

    def __init__(self, shingle: int, threshold: tuple[int, int]):
        self.shingle, (self.num, self.den) = shingle, threshold
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * GROWTH)))

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def most(self, n: int) -> int:
        """Most elements in which a set of n and one linked with it differ."""
        return n * (self.den - self.num) // self.num

    def parts(self, c: int) -> int:
        """Parts for class c: more than its sets can differ in, and room for as many empty parts as chance makes; 0 if only equal sets are alike."""
        top = self.edges[c + 1] - 1
        most = self.most(top)
        if not most:
            return 0
        empty = (most + 2) * math.exp(-top / (most + 2))
        return most + 2 + math.ceil(empty + 3 * math.sqrt(empty))

    def reaches_below(self, n: int, c: int) -> bool:
        return c > 0 and self.num * n <= self.den * (self.edges[c] - 1)

    def linked(self, a, b, both):
        return self.den * both >= self.num * (a + b - both)

    def overlap(self, a: int, b: int) -> int:
        """Least overlap of linked sets of a and b elements."""
        return -(-self.num * (a + b) // (self.num + self.den))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = LOWER[data]
    starts, ends, row = spans(low, offsets)
    words = hashes(low, starts, ends)
    n = len(words)
    with np.errstate(over="ignore"):
        whole = np.full(max(n - shingle + 1, 0), shingle, U)
        for k in range(shingle):
            whole = mix(whole * U(0x9E3779B97F4A7C15) + words[k : n - shingle + 1 + k])
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        elif b > a:
            h = np.full(1, b - a, U)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mix(h * U(0x9E3779B97F4A7C15) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def part_keys(s: np.ndarray, mixed: np.ndarray, c: int, parts: int, most: int) -> tuple[np.ndarray, int]:
    """The keys of set s as class c deals it, and its number of empty parts."""
    part = (s % U(parts)).astype(np.int64)
    o = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[o], np.arange(parts + 1))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mixed[o])])
        sums = total[edge[1:]] - total[edge[:-1]]
        keys = mix(sums + mix(np.arange(parts, dtype=U) + (U(c) << U(44))))
    full = edge[1:] > edge[:-1]
    empty = int((~full).sum())
    return keys if empty >= parts - most else keys[full], empty


_SIGNED = "doc_id long, text_key long, n long, node long, class int, parts int, below int, e_own int, e_probe int, own array<long>, probe array<long>"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    edge = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([np.zeros(0, U), *arrays]).astype(np.int64)))


def signed(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key, n (elements), node (the class of equal sets), keys under the own size class and that below."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(2), 1 << 18):
                rows = []
                for s in shingle_sets(data, offsets, rule.shingle):
                    own = probe = np.zeros(0, U)
                    c = parts = below = e_own = e_probe = 0
                    mixed = mix(s ^ U(0x5851F42D4C957F2D))
                    if len(s):
                        c, most = rule.size_class(len(s)), rule.most(len(s))
                        if parts := rule.parts(c):
                            own, e_own = part_keys(s, mixed, c, parts, most)
                        if rule.reaches_below(len(s), c) and (below := rule.parts(c - 1)):
                            probe, e_probe = part_keys(s, mixed, c - 1, below, most)
                    with np.errstate(over="ignore"):
                        rows.append((len(s), mixed.sum(dtype=U), np.bitwise_xor.reduce(mix(mixed)), c, parts, below, e_own, e_probe, own, probe))
                n, fp1, fp2, *small, own, probe = zip(*rows)
                n, fp1, fp2 = (np.array(x, U) for x in (n, fp1, fp2))
                with np.errstate(over="ignore"):
                    node = mix(fp1 ^ mix(fp2 + n * U(0x9E3779B97F4A7C15))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j], b.column(1)[i:j], pa.array(n.astype(np.int64)), pa.array(node), *(pa.array(x, pa.int32()) for x in small), _lists(own), _lists(probe)],
                    [c.split()[0] for c in _SIGNED.split(", ")],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(f, _SIGNED)


_PACKED = "bucket int, known boolean, keys binary, nodes binary, flags binary"
_OWN, _SEVERAL = 1, 2


def _packed(rows: list[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    bucket, known, *arrays = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(known), *(pa.array([x.tobytes() for x in a], pa.binary()) for a in arrays)], [c.split()[0] for c in _PACKED.split(", ")])


def _block(batches: list[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The keys of a block of documents: one row of each bucket with each key once, and the rest of the keys that meet here."""
    node = np.concatenate([b.column(0).to_numpy() for b in batches])
    lens = [np.concatenate([pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False) for b in batches]) for c in (1, 2)]
    key = np.concatenate([b.column(c).flatten().to_numpy().view(U) for c in (1, 2) for b in batches])
    of = np.concatenate([np.repeat(np.arange(len(node)), n) for n in lens])
    flag = np.zeros(len(key), np.uint8)
    flag[: lens[0].sum()] = _OWN
    first = np.zeros(len(node), bool)
    first[np.unique(node, return_index=True)[1]] = True  # copies say nothing new
    key, of, flag = key[first[of]], of[first[of]], flag[first[of]]
    if not len(key):
        return
    o = np.argsort(key, kind="stable")
    key, of, flag = key[o], of[o], flag[o]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(head)
    flag[at[np.diff(np.append(at, len(key))) > 1]] |= _SEVERAL
    bucket = (key[at] % U(buckets)).astype(np.int64)
    o = np.lexsort((of[at], bucket))  # a document's keys side by side: its node then costs next to nothing
    at, bucket = at[o], bucket[o]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(k, False, key[at[a:z]], node[of[at[a:z]]], flag[at[a:z]]) for k, (a, z) in enumerate(zip(edge, edge[1:])) if z > a]
    more = np.flatnonzero(~head)
    if len(more):
        rows.append((int(key[0] % U(buckets)), True, key[more], node[of[more]], flag[more]))
    yield _packed(rows)


def meetings(marks: DataFrame) -> DataFrame:
    """key, node, own: the keys under which several classes are listed, with each of them (own: by its own size class). Some rows come several times."""
    marks = marks.where("n > 0 and doc_id is not null").select("node", "own", "probe")
    keys = marks.agg(F.sum(F.size("own") + F.size("probe"))).first()[0] or 0
    buckets = max(1, -(-keys // BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column(1).flatten()) + len(b.column(2).flatten())
            if n >= BLOCK:
                yield from _block(held, buckets)
                held, n = [], 0
                trim()
        if n:
            yield from _block(held, buckets)
            trim()

    def out(key: np.ndarray, node: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(key), 1 << 16):
            z = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(key[a:z].view(np.int64)), pa.array(node[a:z]), pa.array((flag[a:z] & _OWN).astype(bool))], ["key", "node", "own"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for known, *arrays in zip(*(b.column(c).to_pylist() for c in range(1, 5))):
                arrays = [np.frombuffer(x, t) for x, t in zip(arrays, (U, np.int64, np.uint8))]
                if known:
                    yield from out(*arrays)
                else:
                    held.append(arrays)
        if not held:
            return
        key, node, flag = (np.concatenate(x) for x in zip(*held))
        del held
        o = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]]))
        lens = np.diff(np.append(at, len(key)))
        some = np.repeat((lens > 1) | (np.bitwise_or.reduceat(flag[o], at) >= _SEVERAL), lens)
        key, node, flag = key[o[some]], node[o[some]], flag[o[some]]
        if not len(key):
            return
        o = np.lexsort((node, key))
        key, node, flag = key[o], node[o], flag[o]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        meets = (np.add.reduceat(new.astype(np.int64), at) > 1) | (np.bitwise_or.reduceat(flag, at) >= _SEVERAL)
        new &= np.repeat(meets, np.diff(np.append(at, len(key))))
        key, node, flag = key[new], node[new], flag[new]
        del o, new, at, meets, some, lens
        yield from out(key, node, flag)
        trim()

    return marks.mapInArrow(deal, _PACKED).repartitionById(buckets, "bucket").mapInArrow(meet, "key long, node long, own boolean")


def _hot(x: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """__hot, __subs: the keys with most rows of x, at most HOT_KEYS, and over how many tasks each is dealt."""
    hot = x.groupBy(key).agg(F.count("*").alias("__rows")).where(F.col("__rows") > rows).orderBy(F.desc("__rows"), key).limit(HOT_KEYS)
    return F.broadcast(hot.select(F.col(key).alias("__hot"), F.least(F.ceil(F.col("__rows") / rows), F.lit(MOST_SUBS)).alias("__subs")))


def _dealt(x: DataFrame, hot: DataFrame, key: str, *by: str) -> DataFrame:
    """x with sub: 0, or for a hot key a number that depends on `by`."""
    part = F.pmod(F.xxhash64(*by) if by else F.monotonically_increasing_id(), F.coalesce("__subs", F.lit(1)))
    return x.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("sub", part.cast("long")).drop("__hot", "__subs")


def _repeated(x: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """x with sub: a row for each number that _dealt gives its key."""
    subs = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__subs", F.lit(1)).cast("long") - 1))
    return x.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("sub", subs).drop("__hot", "__subs")


def spread(left: DataFrame, right: DataFrame, key: str, *by: str) -> DataFrame:
    """left joined with right on key. No key's rows of left meet in one task: those of keys in more than HOT_ROWS rows are
    dealt by a hash of `by` (none: by their places), and right's rows of these keys are repeated. The HOT_KEYS commonest are dealt;
    any other key has less than one row in HOT_KEYS of all."""
    hot = _hot(left, key)
    return _dealt(left, hot, key, *by).join(_repeated(right, hot, key), [key, "sub"]).drop("sub")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges (u, v), of the nodes that have edges.

    Large-star and small-star steps in turn: each node's neighbours are linked to the smallest node next to it, until
    nothing changes; every component is then a star around its smallest node."""
    e = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sum_ = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    now = sum_(e)
    while True:
        # of few edges none can make a hub, so they are not counted by node
        wide = (lambda x, y, key: spread(x, y, key, "v")) if now[0] > HOT_ROWS else (lambda x, y, key: x.join(y, key))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = cut(wide(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = wide(large, low, "u").select("v", "m").where("v != m").unionByName(low.select(F.col("u").alias("v"), "m"))
        old, e = e, cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        drop(old, large)
        before, now = now, sum_(e)
        if before == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _bit(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64))


def texts_of(docs: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the classes of nodes (node), a row for each task that held such a row.

    A bitmap of fixed size keeps most other texts out of the shuffle."""
    ids = cut(facts.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id", "text_key"), "texts-ids")
    words = ids.select(_bit("doc_id").alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_WORDS, np.int64)
    bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)  # 2 MB, whatever the corpus

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_on: set[tuple[int, int]] = set()  # equal rows leave a task once
        for b in batches:
            at = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = (sent.value[at // 64].view(U) >> (at % 64).astype(U) & U(1)).astype(bool)
            b = b.filter(pa.array(keep)).select([0, 1, 2])
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            new = [r not in sent_on and not sent_on.add(r) for r in rows]
            yield b if all(new) else b.filter(pa.array(new, pa.bool_()))

    near = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text", _bit("doc_id").alias("b")).where("doc_id is not null")
    near = near.mapInArrow(f, "doc_id long, text_key long, text string")
    out = cut(near.join(ids, ["doc_id", "text_key"]).select("node", "text"), "texts")
    drop(ids)
    return out


_ROWS = "g long, sub long, role int, node long, comp long, text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """((g, sub), role, rows): maximal runs of each batch."""
    for b in batches:
        k = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for s, t in zip(edges, edges[1:]):
            if t > s:
                yield (int(k[s, 0]), int(k[s, 1])), int(k[s, 2]), b.slice(s, t - s)


class Joined:
    """Components that links found so far in a task have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links = 0

    def root(self, c: int) -> int:
        top = c
        while (t := self.up.get(top, top)) != top:
            top = t
        while c != top:
            self.up[c], c = top, self.up[c]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.links += 1
        return True


class Group:
    """A group's tokens with their owners, sorted, and their union."""

    def __init__(self, ids: list[int], comps: list[int], sets: list[np.ndarray]):
        self.ids, self.comps, self.sizes = np.array(ids), np.array(comps), np.array([len(s) for s in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        o = np.argsort(token, kind="stable")
        self.token, self.owner = token[o], owner[o]
        self.union, self.first = np.unique(self.token, return_index=True)
        self.first = np.append(self.first, len(self.token))
        self.seen = -1

    def links(self, doc: int, comp: int, s: np.ndarray, rule: Rule, joined: Joined) -> list[int]:
        """Members that s is linked with, of components that no link has joined with its own yet."""
        if self.seen != joined.links:
            self.roots, self.seen = np.array([joined.root(c) for c in self.comps.tolist()]), joined.links
        fit = (rule.den * self.sizes >= rule.num * len(s)) & (rule.num * self.sizes <= rule.den * len(s)) & (self.roots != joined.root(comp)) & (self.ids != doc)
        if not fit.any():
            return []
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        at = at[self.union[at] == s]
        if len(at) < rule.overlap(len(s), int(self.sizes[fit].min())):  # the bound: the group stays closed
            return []
        lens = self.first[at + 1] - self.first[at]
        spots = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.bincount(self.owner[spots], minlength=len(self.ids))
        ok = np.flatnonzero(fit & rule.linked(self.sizes, len(s), both)).tolist()
        return [int(self.ids[k]) for k in ok if joined.join(comp, int(self.comps[k]))]


def verify(rows: DataFrame, rule: Rule) -> DataFrame:
    """u, v: links of the queries (role 1) of each (g, sub) with its group's members (role 0).

    Links that join nothing new in their task are left out, so there are fewer than rows; a query whose group is all of its own component is not compared."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.repartition(parts, "g", "sub").sortWithinPartitions("g", "sub", "role")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, held, joined = None, None, [], Joined()
        for key, role, b in _runs(batches):
            if key != at:
                at, group, held = key, None, []
            ids, comps = b.column(3).to_pylist(), b.column(4).to_pylist()
            u, v = [], []
            for i, j, data, offsets in chunks(b.column(5)):
                for d, c, s in zip(ids[i:j], comps[i:j], shingle_sets(data, offsets, rule.shingle)):
                    if not len(s):
                        continue
                    if role == 0:
                        held.append((d, c, s))
                        continue
                    if group is None and held:
                        group = Group(*map(list, zip(*held)))
                    if group is not None:
                        new = group.links(d, c, s, rule, joined)
                        u += [d] * len(new)
                        v += new
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return x.mapInArrow(f, "u long, v long")


def _laid_out(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows for verify() from (g, sub, node, comp, role)."""
    return rows.join(texts, "node").select(*[c.split()[0] for c in _ROWS.split(", ")])


def verified(texts: DataFrame, members: DataFrame, queries: DataFrame, rule: Rule) -> DataFrame:
    """verify() of rows (g, sub, node, comp), written.

    A text goes to every group that it is compared with: a product, which may be far longer than all texts. So groups are
    dealt to rounds, whose shuffles go one after the other: of ROUND bytes of text, or as many as the texts have if that is more."""
    bytes_ = cut(texts.select("node", F.octet_length("text").cast("long").alias("bytes")), "texts-bytes")
    rows = cut(members.withColumn("role", F.lit(0)).unionByName(queries.withColumn("role", F.lit(1))), "rows")
    sum_ = lambda x: x.agg(F.sum("bytes")).first()[0] or 0
    rounds = max(1, -(-sum_(rows.join(bytes_, "node")) // max(ROUND, sum_(bytes_))))
    done = []
    for k in range(rounds):
        one = rows.where(F.pmod(F.xxhash64(F.lit(rounds), "g", "sub"), F.lit(rounds)) == k) if rounds > 1 else rows
        done.append(cut(verify(_laid_out(texts, one), rule), "links"))
    out = done[0]
    if rounds > 1:
        for d in done[1:]:
            out = out.unionByName(d)
        out = cut(out, "links")
        drop(*done)
    drop(rows, bytes_)
    return out


def _led(listed: DataFrame) -> DataFrame:
    """key, leader, rank (the leader's order) of the keys under which a set of the key's class meets another. The first in order leads."""
    own = F.col("own")
    x = listed.groupBy("key").agg(F.min_by(F.when(own, F.col("node")), F.when(own, F.col("order"))).alias("leader"), F.min(F.when(own, F.col("order"))).alias("rank"), F.min("node").alias("least"), F.max("node").alias("most"))
    return x.where("leader is not null and least != most").select("key", "leader", "rank")


def links(docs: DataFrame, met: DataFrame, facts: DataFrame, rule: Rule) -> DataFrame:
    """u, v: links between classes that connect whatever is connected. met (of meetings()) is dropped."""
    num, den = rule.num, rule.den
    all_met = cut(met.distinct(), "met-all")
    drop(met)
    # a set that is linked shares as many keys as it has parts, less those that may differ and those that are empty
    least = f"k >= if(own, parts, below) - n * {den - num} div {num} - if(own, e_own, e_probe)"
    enough = all_met.groupBy("node", "own").agg(F.count("*").alias("k")).join(facts, "node").where(least)
    some = cut(all_met.join(enough.select("node", "own"), ["node", "own"], "left_semi").select("key", "node", "own"), "met-enough")
    drop(all_met)
    # the node leads that meets most others, all its keys together: what a family was copied from, not one of the copies
    rows = spread(some, some.groupBy("key").agg(F.count("*").alias("rows")), "key", "node").groupBy("node").agg(F.least(F.sum("rows"), F.lit((1 << 42) - 1)).alias("met"))
    order = F.shiftleft(F.lit((1 << 42) - 1) - F.col("met"), 21) + F.shiftrightunsigned("node", 43)
    ranked = cut(some.join(rows.select("node", order.alias("order")), "node"), "met-ranked")
    drop(some)
    some = ranked
    lead = facts.select(F.col("node").alias("leader"), F.col("n").alias("m"), F.col("class").alias("lead_class"), F.col("parts").alias("lead_parts"), F.col("e_own").alias("e_lead"))
    met = cut(spread(some.select("key", "node", "own"), _led(some).join(lead, "leader"), "key", "node"), "met")
    drop(some)

    # every node with those of its leaders that share enough keys
    of_lead = [F.first(c).alias(c) for c in ("m", "lead_class", "lead_parts", "e_lead")]
    stars = met.where("node != leader").groupBy("leader", "node").agg(F.count("*").alias("shared"), *of_lead)
    stars = stars.join(facts.select("node", "n", "class", "e_own", "e_probe"), "node")
    differ = f"(n + m - 2 * (({num} * (n + m) + {num + den - 1}) div {num + den}))"
    empty = "least(e_lead, if(class = lead_class, e_own, e_probe))"
    stars = stars.where(f"{num} * greatest(n, m) <= {den} * least(n, m) and shared >= lead_parts - {differ} - {empty}")
    stars = cut(stars.select("leader", "node"), "stars")
    texts = texts_of(docs, facts, stars.select("node").unionByName(stars.select(F.col("leader").alias("node"))))
    hot = _hot(stars, "leader", MEMBERS)
    asked = _dealt(stars, hot, "leader", "node").select(F.col("leader").alias("g"), "sub", "node", F.col("node").alias("comp"))
    leads = _repeated(stars.select("leader").distinct(), hot, "leader").select(F.col("leader").alias("g"), "sub", F.col("leader").alias("node"), F.col("leader").alias("comp"))
    first = verified(texts, leads, asked, rule)
    drop(stars, texts)

    # nodes that met other components, as queries to groups
    comp = components(first)
    comp = cut(met.select("node").distinct().join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "comp-of")
    more = cut(met.select("key", "node", "own", "leader", "rank").join(comp, "node"), "met-some")
    drop(met)
    more_led = cut(spread(more, comp.select(F.col("node").alias("leader"), F.col("comp").alias("lead_comp")), "leader", "key", "node"), "met-comps")
    drop(more, comp)
    mixed = more_led.where("comp != lead_comp").select("key").distinct()
    at = cut(spread(more_led, mixed, "key", "node"), "met-mixed")
    drop(more_led)
    # of a node's leaders the first in order names its family, so one that leads a few keys of a family doesn't split it
    family = at.groupBy("node", "comp").agg(F.min_by("leader", F.struct("rank", "leader")).alias("family")).join(facts.select("node", "n"), "node")
    family = cut(family.withColumn("fc", F.xxhash64("family", "comp")), "families")
    sizes = cut(family.groupBy("fc", "family", "comp").agg(F.sum("n").alias("size")), "family-sizes")
    small = sizes.groupBy("family").agg(F.sum(F.when(F.col("size") <= ELEMENTS, F.col("size"))).alias("small"))
    sizes = spread(sizes.select("fc", "family", "comp", "size"), small, "family", "comp").select("fc", F.col("family").alias("__f"), F.col("comp").alias("__c"), "size", "small")
    place = F.when(F.col("size") > ELEMENTS, F.xxhash64("family", "comp", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / ELEMENTS)))).otherwise(
        F.xxhash64("family", F.pmod(F.xxhash64("comp"), F.ceil(F.col("small") / ELEMENTS)))
    )
    grouped = spread(family, sizes, "fc", "node").where("family = __f and comp = __c")
    grouped = cut(grouped.select("node", "comp", "family", place.alias("g")), "groups")
    drop(family)
    seen = at.select("key", "node").join(grouped.select("node", "family"), "node").select("key", "family").distinct()
    # a node shares with a member that it is linked with as many keys as it shares with any that it is linked with
    asks = spread(at.select("key", "node", "comp", "own", (F.col("comp") != F.col("lead_comp")).alias("apart")), seen, "key", "node")
    asks = asks.groupBy("node", "comp", "own", "family").agg(F.count("*").alias("k"), F.max("apart").alias("apart")).join(facts.select("node", "n", "parts", "below", "e_own", "e_probe"), "node")
    asks = cut(asks.where("apart").where(least).select("node", "comp", "family").distinct(), "asks")
    drop(at)
    units = cut(spread(asks, grouped.select("family", "g").distinct(), "family", "node").select("g", "node", "comp").distinct(), "units")
    drop(asks)
    hot = _hot(units, "g", QUERIES)
    members = cut(_repeated(grouped.select("g", "node", "comp").join(units.select("g").distinct(), "g", "left_semi"), hot, "g").select("g", "sub", "node", "comp"), "members")
    drop(grouped)
    texts = texts_of(docs, facts, units.select("node").unionByName(members.select("node")))
    second = verified(texts, members, _dealt(units, hot, "g", "node").select("g", "sub", "node", "comp"), rule)
    both = cut(first.unionByName(second), "all-links")
    drop(first, second, units, members, texts)
    return both


def _classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """marks; and node, doc_id, text_key (a document of the class, that with the smallest id), comp (its component's node), links of every class."""
    marks = cut(signed(docs, rule), "marks", few=True)
    facts = marks.where("n > 0 and doc_id is not null").groupBy("node")
    same = [F.first(c).alias(c) for c in ("n", "class", "parts", "below", "e_own", "e_probe")]
    facts = cut(facts.agg(F.min("doc_id").alias("doc_id"), F.min_by("text_key", F.struct("doc_id", "text_key")).alias("text_key"), *same), "facts")
    met, keyed = cut(meetings(marks), "met"), marks
    marks = cut(keyed.select("doc_id", "text_key", "n", "node"), "marks-few")
    drop(keyed)  # the keys, most of a document's marks
    found = links(docs, met, facts, rule)
    count = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    x = facts.select("node", "doc_id", "text_key").join(components(found), "node", "left").join(count, "node", "left")
    x = cut(x.select("node", "doc_id", "text_key", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    drop(found, facts)
    return marks, x


def join(docs: DataFrame, shingle: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: of each row of docs.

    n_links counts the links kept with the document's class (those that connect, not all that hold)."""
    marks, classes = _classes(docs, Rule(shingle, threshold))
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = cut(spread(classes.select("node", "comp", "links"), least, "comp", "node").select("node", "component_id", "links"), "class-ids")
    linked = F.expr("n > 0 and doc_id is not null")
    x = spread(marks.where(linked).select("doc_id", "n", "node"), classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("links").alias("n_links"))
    return x.unionByName(marks.where(~linked).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def filter_documents(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id. Rows with a null id stay; of rows without words
    that are alike in id and text one stays.

    Each (doc_id, text) is one row before the texts meet, so a row that is repeated without end is dropped where it lies."""
    marks, classes = _classes(docs, Rule(shingle, threshold))
    keep = classes.groupBy("comp").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_key", F.struct("doc_id", "text_key")).alias("text_key")).select("doc_id", "text_key")
    keep = cut(keep.unionByName(marks.where("n = 0 and doc_id is not null").select("doc_id", "text_key")).distinct(), "kept")
    drop(marks, classes)
    key, nth = fresh(docs, "text_key"), fresh(docs, "nth")
    one = Window.partitionBy("doc_id", key).orderBy(F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]))
    x = docs.where("doc_id is not null").withColumn(key, F.xxhash64("text")).withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1)
    keep = keep.select("doc_id", F.col("text_key").alias(key))
    return x.join(keep, ["doc_id", key], "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op5(spark, sf_dir):
    small_batches(spark)
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
