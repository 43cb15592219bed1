"""The simplified dynamic Bayesian click model: relevance of documents from logged result lists and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relevances(log: DataFrame) -> DataFrame:
    """qid, did, attractiveness, satisfaction, relevance from sessions (qid, hits array<long>, clicks map<long,int>).

    A user reads from the top to the last click: every document down to there was seen, a click marks it attractive,
    and the last click satisfied. One of each is counted in advance for and against. A session without clicks teaches
    nothing beyond its documents being known."""
    x = log.select("qid", "hits", "clicks").withColumn("clicked", F.expr("transform(hits, h -> coalesce(clicks[h], 0) > 0)"))
    x = x.withColumn("last", F.expr("array_max(transform(clicked, (c, i) -> if(c, i, -1)))"))
    x = x.select("qid", "clicked", "last", F.posexplode("hits").alias("i", "did"))
    seen, hit = F.col("i") <= F.col("last"), F.expr("clicked[i]")
    g = x.groupBy("qid", "did").agg(
        F.sum((seen & hit).cast("long")).alias("a1"), F.sum((seen & ~hit).cast("long")).alias("a0"),
        F.sum((seen & hit & (F.col("i") == F.col("last"))).cast("long")).alias("s1"), F.sum((seen & hit & (F.col("i") < F.col("last"))).cast("long")).alias("s0"),
    )
    rate = lambda one, zero: (F.col(one) + 1) / (F.col(one) + F.col(zero) + 2)
    g = g.withColumns({"attractiveness": rate("a1", "a0"), "satisfaction": rate("s1", "s0")})
    return g.select("qid", "did", "attractiveness", "satisfaction", (F.col("attractiveness") * F.col("satisfaction")).alias("relevance"))


def qrels(log: DataFrame, scale: float = 1.0) -> DataFrame:
    """qid, iter, did, label: judgements from a click log."""
    return relevances(log).select("qid", F.lit("Q0").alias("iter"), "did", (F.col("relevance") * scale).alias("label"))


def parsed_log(lines: DataFrame) -> DataFrame:
    """Sessions from CSV columns QueryID, Query, Hits, Offset, Clicks (hits: ids with commas; clicks: id:count with commas)."""
    pairs = F.expr("transform(filter(split(Clicks, ','), x -> x != ''), x -> struct(cast(split(x, ':')[0] as bigint), cast(split(x, ':')[1] as int)))")
    return lines.select(F.col("QueryID").alias("qid"), F.col("Query").alias("query"), F.expr("transform(filter(split(Hits, ','), x -> x != ''), x -> cast(x as bigint))").alias("hits"), F.col("Offset").cast("int").alias("offset"), F.map_from_entries(pairs).alias("clicks"))
