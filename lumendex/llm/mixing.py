"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how often each of its documents should be taken: a whole number of times plus a
fraction. The fractions of two documents are paired: words move from one to the other, in a random direction whose
odds keep both expectations, until one of the two is whole. What is left of a group of documents is one fraction, and
the fractions of groups are paired in the same way, FAN groups at a time, up a tree, until one a source is left and
drawn. Pairs are made in the order of size, so what is left open is a short document, and the words that the copies
take are those of the target up to part of its few.

Groups are made by a hash of doc_id and have about GROUP documents whatever their source's share; a group that is far
longer (rows repeated under one id) is dealt again by the rows' places in the table of sizes. Random numbers come from
hashes of the rows, so reruns agree whatever the partitions. Only (doc_id, source, size) is shuffled. The targets of
sources are found by sums over the table of sources, which may be long: it stays distributed.

Defined results: a null text has size 0 and is never taken (its copies take no words), texts of any length count whole;
null sources are one source, the last; repeated rows are documents of their own, as are rows of equal size (ties go by a
hash); a null doc_id is a document like others; an empty table gives an empty result; a source without words has the
target 0; columns of docs of any name are only carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, own, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
GROUP = 10_000
FAN = 64
HOT = 1 << 16
SEED = 17
_WS = "' \\t\\n\\u000b\\u000c\\r'"


_WORDS = f"cast(size(array_remove(split(translate(coalesce(text, ''), {_WS}, '      '), ' '), '')) as long)"


def sizes(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source, size (words of the whole text), and the columns to carry."""
    return docs.select("doc_id", "source", F.expr(_WORDS).alias("size"), *carry)


def targets(by_source: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """by_source (source, source_size, ...) with target: words to take, by weight, none above `most` times the source's size, the excess dealt again.

    Sources are numbered by ranges of their names. Each is given its weight times one level or its most, and the level is
    raised until the sum is right: every round is one sum over the sources, and closes those that are full."""
    order = [F.col("source").isNull(), F.col("source")]
    x = cut(by_source.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mixing-sources")
    ranges = x.groupBy("range").agg(F.count("*").alias("n"))
    ranges = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row a partition
    x = x.join(F.broadcast(ranges), "range").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    x = cut(x.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))}).drop("range", "before", "place"), "mixing-weights")
    all_ = float(x.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        r = x.agg(F.sum(F.when(F.col("weight") * level > F.col("cap"), F.col("cap"))).alias("cap"), F.sum(F.when(F.col("weight") * level <= F.col("cap"), F.col("weight"))).alias("weight"), F.sum((F.col("weight") * level > F.col("cap")).cast("int")).alias("full")).first()
        if (r.full or 0) == full:
            break
        full = r.full or 0
        if not r.weight:
            level = float("inf")
            break
        level = (all_ - (r.cap or 0.0)) / r.weight
    return x.withColumn("target", F.least("cap", F.col("weight") * level)).drop("weight", "cap")


def pair(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """(0 or 1 for each, the index of the one left open or -1). p is changed to what each has in the end.

    Two open fractions p, q of documents of a and b words: of a*p + b*q words, as many as fit go to one side or the
    other, so that at least one becomes 0 or 1. The two outcomes have the odds that leave both expectations as they
    were."""
    at = -1
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if at < 0:
            at = j
            continue
        a, b, x, y = size[at], size[j], p[at], p[j]
        up, down = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)  # words that can go to `at`, and from it
        if draws[j] * (up + down) < down:
            x, y = x + up / a, y - up / b
        else:
            x, y = x - down / a, y + down / b
        p[at], p[j] = x, y
        whole_x, whole_y = x <= 1e-12 or x >= 1 - 1e-12, y <= 1e-12 or y >= 1 - 1e-12
        if whole_x:
            p[at] = round(x)
        if whole_y:
            p[j] = round(y)
        at = -1 if whole_x and whole_y else j if whole_x else at
    return p, at


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    from ._text import mix

    return (mix(key.astype(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(float) / 2.0**53


_NAMES = ["doc_id", "source", "size", "source_size", "target", "pick", "grp", "p", "open"]


def _round_groups(level: int):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "pick", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        pick = pdf["pick"].to_numpy(np.uint64)
        nth = np.arange(len(pick)) - np.searchsorted(-pdf["size"].to_numpy(), -pdf["size"].to_numpy())  # equal rows draw apart
        p, at = pair(pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float), _uniform(pick + nth.astype(np.uint64), SEED + level))
        pdf["p"], pdf["open"] = p, False
        if at >= 0:
            pdf.loc[at, "open"] = True
        return pdf

    return f


def _with_targets(sized: DataFrame) -> DataFrame:
    """sized with source_size, target and groups. Of many sources the HOT with most rows are broadcast; no other is in more than one row in HOT."""
    side = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))), "mixing-targets")
    side = side.select(F.col("source").alias("__s"), "source_size", "target", F.ceil(F.col("rows") / GROUP).alias("groups"))
    on = sized["source"].eqNullSafe(F.col("__s"))
    if side.count() <= HOT:
        return sized.join(F.broadcast(side), on).drop("__s")
    top = F.broadcast(side.orderBy(F.desc("groups"), "__s").limit(HOT))
    found = sized.join(top, on, "left")
    is_top = F.col("groups").isNotNull()
    rest = found.where(~is_top).select(*sized.columns)
    return found.where(is_top).drop("__s").unionByName(rest.join(side, rest["source"].eqNullSafe(side["__s"])).drop("__s"))


def copies(sized: DataFrame) -> DataFrame:
    """sized (doc_id, source, size, and what it carries) with source_size, target, copies; one row a document."""
    more = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    sized = cut(sized, "mixing-sizes", narrow=True)
    x = _with_targets(sized)
    pick = F.xxhash64(F.lit(SEED), "doc_id", "size", F.coalesce("source", F.lit("\0")), F.col("source").isNull())
    x = x.withColumn("pick", pick).withColumn("grp", F.pmod("pick", F.greatest("groups", F.lit(1))))
    # groups much longer than a hash of unlike rows makes them; any beyond the HOT longest holds less than one row in HOT
    hot = x.groupBy("source", "grp").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * GROUP).orderBy(F.desc("rows"), "source", "grp").limit(HOT)
    hot = cut(hot.select(F.col("source").alias("__s"), F.col("grp").alias("__g"), F.ceil(F.col("rows") / GROUP).alias("parts")), "mixing-hot")
    most_parts = hot.agg(F.max("parts")).first()[0] or 1
    if most_parts > 1:
        x = x.join(F.broadcast(hot), x["source"].eqNullSafe(hot["__s"]) & (x["grp"] == hot["__g"]), "left")
        x = x.withColumn("grp", F.col("grp") * most_parts + F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))).drop("__s", "__g", "parts")
    x = x.withColumn("rate", F.expr("if(source_size = 0, 0D, target / source_size)"))
    x = x.withColumn("p", F.when(F.col("size") == 0, 0.0).otherwise(F.col("rate") - F.floor("rate")))
    most, level = (x.agg(F.max("groups")).first()[0] or 1) * most_parts, 0
    open_ = x.withColumn("open", F.lit(True)).select(*_NAMES, *more)
    done = []
    while True:
        out = cut(open_.groupBy("source", "grp").applyInPandas(_round_groups(level), open_.schema), f"mixing-{level}")
        done.append(out.where(~F.col("open")))
        rest = out.where("open")
        if most == 1:
            break
        most, level = -(-most // FAN), level + 1
        open_ = rest.withColumn("grp", F.expr(f"grp div {FAN}"))
    last = rest.withColumn("p", F.when(F.expr(f"pmod(xxhash64(pick, {SEED}L), 1000000007) / 1000000007D") < F.col("p"), 1.0).otherwise(0.0))
    out = done[0]
    for d in [*done[1:], last]:
        out = out.unionByName(d)
    whole = F.expr("if(source_size = 0 or size = 0, 0L, cast(floor(target / source_size) as long))")
    return out.select("doc_id", "source", "size", "source_size", "target", (whole + F.round("p").cast("long")).alias("copies"), *more)


def mix_documents(docs: DataFrame) -> DataFrame:
    """Each row of docs as many times as the mix takes it.

    Rows are written once with a number of their own, by which the copies come back, so rows that are alike in all else don't
    meet. The copies grow with the documents and are not broadcast, however few."""
    x, names = own(docs)
    x = cut(x.withColumn("number", F.monotonically_increasing_id()), "mixing-rows")
    taken = copies(sizes(x.withColumnsRenamed({names[c]: c for c in ("doc_id", "source", "text")}), "number"))
    taken = taken.where("copies > 0").select("number", F.col("copies").cast("int"))
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("times")
    return x.join(taken.hint("merge"), "number").select("*", times).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8(spark, sf_dir):
    x = copies(sizes(table(spark, sf_dir, "documents")))
    return x.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
