"""Clustering of a result page: sparse tf-idf points, cosine distance, k-means and equal-sized groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog


def points(c: Catalog, dids: DataFrame, stopwords: list[str] = ()) -> DataFrame:
    """did, term, w: (1 + ln f) ln(N / tf), frequencies within dids; terms of one or of all documents carry nothing."""
    page = dids.select("did").distinct().persist()  # found once; by its rows Spark tells whether it can be broadcast
    n = page.count()
    p = c.counts_of(page).where("wdf > 0")
    if stopwords:
        p = p.where(~F.col("term").isin(list(stopwords)))
    p = p.select("did", "term", "wdf").persist()
    tf = p.groupBy("term").agg(F.count("*").alias("tf")).where((F.col("tf") > 1) & (F.col("tf") < n))
    return p.join(tf, "term").select("did", "term", ((1 + F.log(F.col("wdf").cast("double"))) * F.log(F.lit(float(n)) / F.col("tf"))).alias("w"))


def cosine_distances(a: DataFrame) -> DataFrame:
    """d1, d2, distance of all pairs of a page's documents (1 for pairs without a common term, 0 if either is empty)."""
    norm = a.groupBy("did").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    x, y = a.select(F.col("did").alias("d1"), "term", F.col("w").alias("w1")), a.select(F.col("did").alias("d2"), "term", F.col("w").alias("w2"))
    dot = x.join(y, "term").where("d1 < d2").groupBy("d1", "d2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    n1, n2 = norm.select(F.col("did").alias("d1"), F.col("n").alias("n1")), norm.select(F.col("did").alias("d2"), F.col("n").alias("n2"))
    return dot.join(n1, "d1").join(n2, "d2").select("d1", "d2", (1 - F.col("dot") / F.sqrt(F.col("n1") * F.col("n2"))).alias("distance"))


def page_matrix(c: Catalog, dids: list[int]) -> np.ndarray:
    """A row for each of a page's documents, in the page's order."""
    page = c.spark.createDataFrame([(int(d),) for d in dids], "did long")
    rows = points(c, page).collect()  # a page is short
    at, term = {d: i for i, d in enumerate(dids)}, {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    x = np.zeros((len(dids), max(len(term), 1)))
    for r in rows:
        x[at[r.did], term[r.term]] = r.w
    return x


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = math.sqrt(float(a @ a) * float(b @ b))
    return 0.0 if n == 0 else 1 - float(a @ b) / n


def kmeans(x: np.ndarray, k: int, rounds: int = 1000, threshold: float = 1e-6) -> np.ndarray:
    """Cluster of each row: seeds spread over the page, the nearest centroid (the first of equals), until none moves."""
    n = len(x)
    k = min(k, n)
    centres = x[[i * n // k for i in range(k)]].copy()
    own = np.zeros(n, int)
    for _ in range(rounds):
        own = np.array([min(range(k), key=lambda j: (cosine(r, centres[j]), j)) for r in x])
        new = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
        moved = max(cosine(a, b) for a, b in zip(centres, new))
        centres = new
        if moved <= threshold:
            break
    return own


def equal_groups(x: np.ndarray, k: int) -> np.ndarray:
    """k groups of nearly equal size: the best document leads, its nearest join it, then the farthest of the rest leads."""
    n = len(x)
    k = min(k, n)
    own, left, lead = np.full(n, -1), list(range(n)), 0
    for j in range(k):
        size = n // k + (j < n % k)
        left.remove(lead)
        near = sorted(left, key=lambda i: (cosine(x[lead], x[i]), i))[: size - 1]
        for i in [lead, *near]:
            own[i] = j
        left = [i for i in left if i not in near]
        if left:
            lead = max(left, key=lambda i: (cosine(x[lead], x[i]), -i))
    return own


def diversified(x: np.ndarray, weights: list[float], k: int, r: int, lam: float = 0.5, b: float = 5.0, sigma2: float = 1e-3) -> list[int]:
    """Row numbers of a page in a new order: of the first k, picks trade their weight against closeness to earlier ones."""
    first, left = [], list(range(min(k, len(x))))
    while left and len(first) < r:
        gain = lambda i: lam * weights[i] - (1 - lam) * sum((1 - cosine(x[i], x[j])) / (b + sigma2) for j in first)
        best = max(left, key=lambda i: (gain(i), -i))
        first.append(best)
        left.remove(best)
    return first + left + list(range(min(k, len(x)), len(x)))
