"""Quality rules with thresholds taken from the corpus itself.

Every document gets a few integer measures. For each language and source, a mergeable quantile sketch of each
measure (counts of logarithmic bins, so that two sketches merge by adding counts; ranks are exact, and a bin's edges, 1% apart,
bound the quantile in it) gives the quartiles, the outer edge of either's bin, and the fence beyond them is the group's
threshold:

* word length: FENCE interquartile ranges beyond either quartile;
* shares of symbols, repeated lines and repeated words: the third quartile plus FENCE interquartile ranges, or what COUNTS
  chance events make of a document of the group's median length if that is more. That length is a quantile of the same
  sketches (of the share that one event makes), so no limit is a number fixed beforehand, and where most documents have
  none of a thing, as with symbols, the limit follows their lengths.

Groups of fewer than MIN_GROUP documents use the merged sketch of their language, languages as small as that the sketch
of all. Thresholds are joined with the rows by language and source; rows are not known by ids.

Native throughout: no Python runs on the executors.

Defined results: a null text has no words and fails the base rules; null languages and sources are groups of their
own; repeated rows are each judged; texts of any length are measured whole, in one row's memory; an empty table gives an
empty result; columns of docs beyond doc_id, text, lang and source may have any names: filter_documents carries them, the
measures don't see them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, own

SYMBOLS = "#*$%&|<>"
BINS_PER_E = 100
MIN_GROUP = 100
FENCE = 3.0
COUNTS = 20
#: measure: (expression over the base columns, that of one event's share in millionths or None: both sides are fenced)
MEASURES = {
    "word_len": ("(1000 * word_chars) div n_words", None),
    "symbols": ("(10000 * n_symbols) div word_chars", "1000000 div word_chars"),
    "dup_lines": ("(10000 * n_dup_lines) div n_lines", "1000000 div n_lines"),
    "repeats": ("(10000 * n_repeat_words) div n_words", "6000000 div n_words"),  # a window and its copy are six words
}
_WS = "' \\t\\n\\u000b\\u000c\\r'"


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all of the whole text).

    A window of three words is its words with spaces between, so equal windows are equal strings. A row's windows
    are sorted once; neighbours that are equal mark the words that they cover."""
    x = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    x = x.withColumn("__w", F.expr(f"array_remove(split(translate(__t, {_WS}, '      '), ' '), '')"))
    x = x.withColumn("__l", F.expr(f"filter(split(__t, '\\n'), l -> translate(l, {_WS}, '') != '')"))
    x = x.withColumn("__n", F.size("__w"))
    x = x.withColumn(
        "__3",
        F.expr("if(__n < 3, array(), transform(slice(__w, 1, greatest(__n - 2, 0)), (w, i) -> concat(w, ' ', __w[i + 1], ' ', __w[i + 2])))"),
    )
    x = x.withColumn("__d", F.expr("if(size(array_distinct(__3)) = size(__3), null, sort_array(transform(__3, (w, i) -> struct(w as w, i as i))))"))
    x = x.withColumn(
        "__p",
        F.expr(
            "sort_array(transform(filter(transform(__d, (x, j) -> if((j > 0 and __d[greatest(j - 1, 0)].w = x.w) or (j < size(__d) - 1 and __d[least(j + 1, size(__d) - 1)].w = x.w), x.i, -1)), i -> i >= 0), i -> i))"
        ),
    )
    covered = "if(__d is null, 0L, aggregate(__p, struct(-3 as last, 0L as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n))"
    x = x.withColumns(
        {
            "n_words": F.col("__n").cast("long"),
            "word_chars": F.expr(f"length(translate(__t, {_WS}, ''))").cast("long"),
            "n_symbols": F.expr(f"length(__t) - length(translate(__t, '{SYMBOLS}', ''))").cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": F.expr("size(__l) - size(array_distinct(__l))").cast("long"),
            "n_repeat_words": F.expr(covered),
        }
    )
    return x.drop("__t", "__w", "__l", "__n", "__3", "__d", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(e: str) -> Column:
    return F.expr(f"if({e.split(' div ')[1]} = 0, 0L, {e})")


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bin, n): counts of bins for each group, each language and all rows together.

    Rows that fail the base rules don't shape the thresholds. Level 2 is lang and source, 1 lang, 0 all."""
    parts = {k: e for k, (e, _) in MEASURES.items()} | {f"unit_{k}": u for k, (_, u) in MEASURES.items() if u}
    long = measured.where(~base_failed()).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _value(e).alias("v")) for k, e in parts.items()])).alias("m"))
    bins = F.when(F.col("m.v") <= 0, 0).otherwise(1 + F.floor(F.log(F.col("m.v").cast("double")) * BINS_PER_E)).cast("int")
    fine = long.select("lang", "source", F.col("m.measure").alias("measure"), bins.alias("bin")).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    merged = lambda level, lang, source: fine.select(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source"), "measure", "bin", "n")
    null = F.lit(None).cast("string")
    out = merged(2, F.col("lang"), F.col("source")).unionByName(merged(1, F.col("lang"), null)).unionByName(merged(0, null, null))
    return out.groupBy("level", "lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, group_rows, lo_<m>, hi_<m>): one row for each sketched group."""
    w = Window.partitionBy("level", "lang", "source", "measure")
    up = sketch.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = lambda q, part: F.min(F.when(F.col("cum") >= F.ceil(F.col("all") * q), F.when(F.col("bin") == 0, 0.0).otherwise(F.exp((F.col("bin") - part) / BINS_PER_E))))
    q = up.groupBy("level", "lang", "source", "measure").agg(at(0.25, 1.0).alias("q1"), at(0.5, 0.5).alias("q2"), at(0.75, 0.0).alias("q3"), F.max("all").alias("rows"))
    of = lambda name, column: F.max(F.when(F.col("measure") == name, F.col(column))).alias(f"{column}_{name}")
    wide = q.groupBy("level", "lang", "source").agg(
        F.max("rows").alias("group_rows"), *[of(k, c) for k in MEASURES for c in ("q1", "q3")], *[of(f"unit_{k}", "q2") for k, (_, u) in MEASURES.items() if u]
    )
    out = []
    for k, (_, unit) in MEASURES.items():
        reach = f"{FENCE}D * (q3_{k} - q1_{k})"
        reach = f"greatest({reach}, {COUNTS} * q2_unit_{k} / 100)" if unit else reach
        out += [F.expr(f"q3_{k} + {reach}").alias(f"hi_{k}"), F.lit(-1.0).alias(f"lo_{k}") if unit else F.expr(f"q1_{k} - {reach}").alias(f"lo_{k}")]
    return wide.select("level", "lang", "source", "group_rows", *out)


def judge(measured: DataFrame) -> DataFrame:
    """measured with base_failed, threshold_level and kept.

    The thresholds of the two upper levels hold one row a language and one row in all; those of the lowest level have
    one row for each language and source of MIN_GROUP rows and are joined by whatever way their size calls for."""
    t = cut(thresholds(sketches(measured)), "thresholds")
    names = [f"{s}_{k}" for k in MEASURES for s in ("lo", "hi")]
    x = measured.withColumn("base_failed", base_failed())
    for level, keys in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        side = t.where((F.col("level") == level) & (F.col("group_rows") >= (MIN_GROUP if level else 0)))
        side = side.select(*[F.col(k).alias(f"__{k}{level}") for k in keys], *[F.col(n).alias(f"__{level}{n}") for n in ["group_rows", *names]])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}{level}"))
        x = x.join(side, on, "left") if keys else x.join(F.broadcast(side.limit(1)), on, "left")
    level = F.when(F.col("__2group_rows").isNotNull(), 2).when(F.col("__1group_rows").isNotNull(), 1).when(F.col("__0group_rows").isNotNull(), 0)
    x = x.withColumn("threshold_level", level)
    ok = ~F.col("base_failed")
    for k, (e, _) in MEASURES.items():
        lo, hi = (F.when(F.col("threshold_level") == 2, F.col(f"__2{s}_{k}")).when(F.col("threshold_level") == 1, F.col(f"__1{s}_{k}")).otherwise(F.col(f"__0{s}_{k}")) for s in ("lo", "hi"))
        ok = ok & F.coalesce((_value(e) >= lo) & (_value(e) <= hi), F.lit(True))
    return x.withColumn("kept", ok).select(*measured.columns, "base_failed", "kept", "threshold_level")


def measures(docs: DataFrame) -> DataFrame:
    """The narrow table of base columns, written once."""
    return cut(base_columns(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality", narrow=True)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a document: base columns, base_failed, kept."""
    return judge(measures(docs))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with docs' columns. Rows are written once with their measures; the thresholds are
    joined with these, so no text is shuffled while the thresholds are few."""
    x, names = own(docs)
    x = base_columns(x, names["text"]).withColumnsRenamed({names[c]: c for c in ("lang", "source")})
    back = [F.col(c if names[c] == f"own_{i}" and c in ("lang", "source") else f"own_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return judge(cut(x, "quality-rows")).where("kept").select(*back)


def op1(spark, sf_dir):
    from ._store import table

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "threshold_level")
