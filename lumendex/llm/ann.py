"""Nearest neighbours by randomly rotated one-bit codes.

Each vector, less the centroid and scaled to length one, is rotated; the signs of its D coordinates are its code, D
bits, beside two correction scalars: its distance from the centroid and the inner product of the unit vector with its
own code. A query's rotated coordinates are rounded to four bits, so its product with a code is four counts of the bits
that the packed code shares with a plane of the query. From that the inner product is estimated without bias, and its
error stays within EPSILON * sqrt((1 - f * f) / (f * f) / (D - 1)) of the lengths' product, f being the second scalar,
but for rare cases, and what the rounding can make. A query's vectors whose estimate plus bound reaches the k-th best product
found so far are reranked by exact products in double precision; no other limit is set on their number.

Vectors stay where they are stored and are taken in parts of PART_BYTES. Queries come to them in blocks of QUERY_BYTES, one
pass over the index each, broadcast; with each query goes the k-th best product among SAMPLE vectors, so that a task sends
back what beats it, k rows a query at most. So no vector is shuffled; the work is that of queries times vectors, as
stated, and what comes back is at most k rows a query and task. The centroid is fitted on CENTER vectors with the
smallest hashes, from which the SAMPLE is taken too; all vectors are indexed.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part; equal products go to the smaller id; copies of a row are candidates each; a query is no candidate of its
own id; with fewer than k candidates all are returned; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, table

K = 20
PART_BYTES = 64 << 20
QUERY_BYTES = 16 << 20
TILE = 1 << 22
CENTER = 4096
SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
EPSILON = 2.2
LEVELS = 4
SEED = 7


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    x = x.where("forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('inf')) and exists(embedding, e -> e != 0)")
    most = x.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return x.join(F.broadcast(most), F.size("embedding") == F.col("n")).drop("n")


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, packed into 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def encode(x: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance from the centroid, inner product of the unit residual with its code."""
    residual = (x - centroid) @ turn.T
    far = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(far > 0, far, 1)[:, None]
    return words(unit > 0), far, np.abs(unit).sum(1) / math.sqrt(x.shape[1])


def build_index(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, code, far, fit) of every valid vector, and the centroid."""
    x = valid(vectors)
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTER).collect()
    centroid = np.mean([r.embedding for r in sample], axis=0) if sample else np.zeros(1)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(len(centroid))
        for b in batches:
            if b.num_rows:
                code, far, fit = encode(matrix(b.column(1)), centroid, turn)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(far), pa.array(fit)], ["vec_id", "embedding", "code", "far", "fit"])

    return cut(x.mapInArrow(f, "vec_id long, embedding array<double>, code binary, far double, fit double"), "ann-index"), centroid


class Part:
    """The vectors of one part, ready for queries."""

    def __init__(self, batches: list[pa.RecordBatch], centroid: np.ndarray):
        ids = np.concatenate([b.column(0).to_numpy() for b in batches])
        o = np.argsort(ids, kind="stable")
        take = lambda k: np.concatenate([b.column(k).to_numpy() for b in batches])[o]
        self.ids, self.x = ids[o], np.concatenate([matrix(b.column(1)) for b in batches])[o]
        self.far, fit = take(3), np.maximum(take(4), 1e-9)
        self.code = np.frombuffer(b"".join(c for b in batches for c in b.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)[o]
        self.ones = np.bitwise_count(self.code).sum(1, dtype=np.int64)
        self.d = d = self.x.shape[1]
        self.scale = self.far / fit / math.sqrt(d)
        self.error = self.far * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * EPSILON / math.sqrt(max(d - 1, 1))
        self.centroid, self.turn = centroid, rotation(d)

    def search(self, i: int, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best for query i that reach `least`, best first."""
        asked, turned = least, self.turn @ q
        low, high = turned.min(), turned.max()
        step = (high - low) / (2**LEVELS - 1) or 1.0
        level = np.clip(np.rint((turned - low) / step), 0, 2**LEVELS - 1).astype(np.uint8)
        planes = words(level[None, :] >> np.arange(LEVELS, dtype=np.uint8)[:, None] & 1)
        shared = sum(np.bitwise_count(self.code & planes[j]).sum(1, dtype=np.int64) << j for j in range(LEVELS))
        product = 2 * (low * self.ones + step * shared) - (low * self.d + step * int(level.sum()))  # of the signs with the rounded query
        bound = self.error * np.linalg.norm(q) + self.scale * np.abs(low + step * level - turned).sum()
        estimate = self.scale * product + q @ self.centroid
        other = self.ids != i
        first = np.argpartition(-estimate, min(4 * k, len(estimate) - 1))[: 4 * k + 1]
        exact = self.x[first[other[first]]] @ q
        if len(exact) >= k:
            least = max(least, np.partition(exact, len(exact) - k)[len(exact) - k])
        rest = np.flatnonzero((estimate + bound >= least - 1e-6 * abs(least)) & other)
        score = np.einsum("nd,d->n", self.x[rest], q)
        top = np.lexsort((self.ids[rest], -score))[:k]
        top = top[score[top] >= asked]
        return self.ids[rest[top]], score[top]


def _block(index: DataFrame, centroid: np.ndarray, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: for each query the k best of every partition of the index."""
    sent = index.sparkSession.sparkContext.broadcast((ids, q, least))  # QUERY_BYTES

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, least = sent.value
        least, best = least.copy(), [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

        def visit(held: list[pa.RecordBatch]) -> None:
            part = Part(held, centroid)
            for j, i in enumerate(ids.tolist()):
                v, s = (np.concatenate(x) for x in zip(best[j], part.search(i, q[j], k, least[j])))
                top = np.lexsort((v, -s))[:k]
                best[j] = v[top], s[top]
                if len(top) == k:
                    least[j] = max(least[j], best[j][1][-1])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.nbytes
            if n >= PART_BYTES:
                visit(held)
                held, n = [], 0
        if held:
            visit(held)
        if any(len(v) for v, _ in best):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(v) for v, _ in best])), pa.array(np.concatenate([v for v, _ in best])), pa.array(np.concatenate([s for _, s in best]))], ["query_id", "vec_id", "score"])

    return index.mapInArrow(f, "query_id long, vec_id long, score double")


def _arrow(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow().combine_chunks()
    return t.column(0).to_numpy(), matrix(t.column(1).combine_chunks())


def search(index: DataFrame, centroid: np.ndarray, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, embedding) the k nearest found."""
    row_bytes = 8 * (len(centroid) + 2)
    known, sample = _arrow(index.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // row_bytes))))
    blocks = max(1, -(-queries.count() * row_bytes // QUERY_BYTES))
    near = None
    for block in range(blocks):
        ids, q = _arrow(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block))
        least = np.full(len(ids), -np.inf)
        rows = max(1, TILE // max(1, len(known)))
        for a in range(0, len(ids), rows):
            products = q[a : a + rows] @ sample.T
            products[ids[a : a + rows, None] == known[None, :]] = -np.inf
            if products.shape[1] >= k:
                least[a : a + rows] = np.partition(products, products.shape[1] - k, axis=1)[:, -k]
        found = _block(index, centroid, ids, q, least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0)), k)
        near = found if near is None else near.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir):
    index, centroid = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, centroid, index.where("vec_id % 20 = 0").select("vec_id", "embedding").distinct())
