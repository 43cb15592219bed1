"""Query expansion: the terms that mark documents judged relevant."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog


def _relevant_terms(c: Catalog, rset: DataFrame, k: float) -> DataFrame:
    """term, r, rf (wdf in relevant documents), mult, with the term's statistics."""
    p = c.postings.join(rset.select("did").distinct(), "did", "left_semi")
    f = F.when(F.col("wdf") == 0, 1).otherwise(F.col("wdf"))
    avl = float(c.stats["avg_len"] or 1) or 1.0
    mult = (k + 1) * f / (k * F.col("doclen") / avl + f)
    x = p.groupBy("term").agg(F.count("*").alias("r"), F.sum("wdf").alias("rf"), F.sum(mult).alias("mult"))
    return x.join(c.termstats, "term")


def prob_weight(R: float, N: float):
    r, n = F.col("r"), F.col("termfreq")
    return F.col("mult") * F.log((r + 0.5) * (N - n - (R - r) + 0.5) / ((n - r + 0.5) * (R - r + 0.5)))


def bo1_weight(N: float):
    mean = F.col("collfreq") / N
    return F.col("rf") * F.log((1 + mean) / mean) / math.log(2) + F.log(1 + mean) / math.log(2)


def candidates(c: Catalog, rset: DataFrame, scheme: str = "prob", k: float = 1.0, exclude: list[str] = (), decider=None, min_weight: float = 0.0) -> DataFrame:
    """term, w of all terms above min_weight. Their number is the bound that an expansion set reports."""
    x = _relevant_terms(c, rset, k)
    N = float(c.stats["n"])
    if scheme in ("prob", "trad"):
        x = x.withColumn("w", prob_weight(float(rset.select("did").distinct().count()), N))
    elif scheme == "bo1":
        x = x.withColumn("w", bo1_weight(N))
    else:
        raise ValueError(f"no expansion scheme {scheme}")
    if exclude:
        x = x.where(~F.col("term").isin(list(exclude)))
    if decider is not None:
        x = x.where(decider(F.col("term")))
    return x.where(F.col("w") > min_weight).select("term", "w", "termfreq")


def eset(c: Catalog, rset: DataFrame, maxitems: int, **options) -> DataFrame:
    """The best terms: by weight, those of equal weight in descending order."""
    return candidates(c, rset, **options).orderBy(F.desc("w"), F.desc("term")).limit(maxitems)


def filter_terms(reject: list[str]):
    return lambda t: ~t.isin(list(reject))


def filter_prefix(prefix: str):
    return lambda t: t.startswith(prefix)


def both(a, b):
    return lambda t: a(t) & b(t)
