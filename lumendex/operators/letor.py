"""Learning to rank: features, normalisation, two listwise rankers, and measures of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import Catalog

NAMES = ("tf", "tf_doclen", "idf", "colltf_colllen", "tfidf_doclen", "tf_doclen_colltf_colllen")
PARTS = ("title", "body", "whole")


def features(c: Catalog, terms: list[str], dids: DataFrame, title_prefix: str = "S") -> DataFrame:
    """did and the six measures for title, body and whole of each of dids, for a query's terms (bodies are unprefixed)."""
    want = [(t, title_prefix + t) for t in dict.fromkeys(terms)]
    side = c.spark.createDataFrame([(b, t, "body") for b, _ in want for t in [b]] + [(s, b, "title") for b, s in want], "term string, base string, part string")
    p = c.postings.where(F.col("term").isin([x for w in want for x in w])).join(F.broadcast(side), "term")
    title = F.col("term").startswith(title_prefix)
    len_ = c.postings.groupBy("did").agg(F.sum(F.when(title, F.col("wdf")).otherwise(0)).alias("title"), F.sum(F.when(~title, F.col("wdf")).otherwise(0)).alias("body"), F.sum("wdf").alias("whole"))
    coll = len_.agg(*[F.sum(x).cast("double").alias(x) for x in PARTS]).first()
    stats = p.groupBy("base").agg(*[F.sum(F.when(F.col("part") == x, F.col("wdf")).otherwise(0)).alias(f"c_{x}") for x in PARTS[:2]], F.sum("wdf").alias("c_whole"), *[F.countDistinct(F.when(F.col("part") == x, F.col("did"))).alias(f"n_{x}") for x in PARTS[:2]], F.countDistinct("did").alias("n_whole"))
    tf = p.groupBy("did", "base").agg(*[F.sum(F.when(F.col("part") == x, F.col("wdf")).otherwise(0)).alias(f"t_{x}") for x in PARTS[:2]], F.sum("wdf").alias("t_whole"))
    grid = dids.select("did").join(F.broadcast(stats), F.lit(True), "left").join(tf, ["did", "base"], "left").join(len_.select("did", *[F.col(x).alias(f"l_{x}") for x in PARTS]), "did", "left").na.fill(0)
    n = float(c.stats["n"])
    out = []
    log = lambda x: F.sum(F.log10(1 + x))
    for x in PARTS:
        t, l, cf, idf, cl = F.col(f"t_{x}"), F.col(f"l_{x}"), F.col(f"c_{x}"), F.log10(n / (1 + F.col(f"n_{x}"))), F.lit(float(coll[x] or 0))
        out += [log(t), log(t / (1 + l)), log(idf), log(cl / (1 + cf)), log(t * idf / (1 + l)), log(t * cl / (1 + l * cf))]
    return grid.groupBy("did").agg(*[e.alias(f"{NAMES[i % 6]}_{PARTS[i // 6]}") for i, e in enumerate(out)])


def normalised(x: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Each feature over its largest value in its group; a largest value of 0 leaves it."""
    w = Window.partitionBy(*by)
    return x.select(*[c for c in x.columns if c not in columns], *[(F.col(c) / F.when(F.max(c).over(w) == 0, 1.0).otherwise(F.max(c).over(w))).alias(c) for c in columns])


def training_lines(x: DataFrame, columns: list[str]) -> DataFrame:
    """One text line for each (label, qid, features, did)."""
    values = [F.concat(F.lit(f"{i}:"), F.col(c).cast("string")) for i, c in enumerate(columns, 1)]
    return x.select(F.concat_ws(" ", F.col("label").cast("string"), F.concat(F.lit("qid:"), F.col("qid").cast("string")), *values, F.concat(F.lit("#docid="), F.col("did").cast("string"))).alias("value"))


def _matrix(pdf: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return pdf[columns].to_numpy(float), pdf["label"].to_numpy(float)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def listnet_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the cross entropy of the top-one probabilities, over the list's length."""
    return x.T @ (_softmax(x @ w) - _softmax(y)) / len(y)


def listmle_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the likelihood that the best document comes first."""
    top = int(np.argmax(y))
    return x.T @ _softmax(x @ w) - x[top]


def train(rows: DataFrame, columns: list[str], gradient=listnet_gradient, rate: float = 0.001, rounds: int = 15) -> np.ndarray:
    """Weights by gradient descent over queries. Each round is one aggregation of the queries' gradients.

    rows: qid, label, features. A query's list is what one search returned, so it is short."""
    w = np.zeros(len(columns))
    schema = ", ".join(f"g{i} double" for i in range(len(columns)))

    def of(w: np.ndarray):
        def f(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y = _matrix(pdf, columns)
            return pd.DataFrame([gradient(x, y, w)], columns=[f"g{i}" for i in range(len(columns))])

        return f

    for _ in range(rounds):
        g = rows.groupBy("qid").applyInPandas(of(w), schema).agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(len(columns))]).first()
        w = w - rate * np.array([v or 0.0 for v in g])
    return w


def score(rows: DataFrame, columns: list[str], w) -> DataFrame:
    return rows.withColumn("score", sum((F.col(c) * float(v) for c, v in zip(columns, w)), F.lit(0.0)))


def ndcg(rows: DataFrame) -> DataFrame:
    """qid, ndcg of lists of (qid, rank from 1, label)."""
    ideal = Window.partitionBy("qid").orderBy(F.desc("label"))
    x = rows.withColumn("best", F.row_number().over(ideal))
    gain = lambda r: (F.pow(2.0, "label") - 1) / F.log2(F.col(r) + 1)
    g = x.groupBy("qid").agg(F.sum(gain("rank")).alias("dcg"), F.sum(gain("best")).alias("ideal"))
    return g.select("qid", F.when(F.col("dcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def err(rows: DataFrame) -> DataFrame:
    """qid, err: expected reciprocal rank, grades against the largest label of the list."""
    x = rows.withColumn("most", F.max("label").over(Window.partitionBy("qid")))
    x = x.withColumn("stop", (F.pow(2.0, "label") - 1) / F.pow(2.0, "most"))
    one = x.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "stop"))).alias("l"))
    return one.select("qid", F.expr("aggregate(l, struct(1D as p, 0D as e), (a, x) -> struct(a.p * (1 - x.stop) as p, a.e + a.p * x.stop / x.rank as e), a -> a.e)").alias("err"))
