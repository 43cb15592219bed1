"""Spelling: a dictionary of words with frequencies, suggestions within a few edits, synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expand import _osa


def added(spelling: DataFrame, words: DataFrame) -> DataFrame:
    """The dictionary after adding words (word, n); a negative n removes, words of one character are ignored."""
    x = spelling.select("word", "freq").unionByName(words.select("word", F.col("n").cast("long").alias("freq"))).where("length(word) > 1")
    return x.groupBy("word").agg(F.sum("freq").alias("freq")).where("freq > 0")


def fragments(word: Column) -> Column:
    """Head and tail of two, both ends of words of up to four, and all runs of three."""
    n = F.length(word)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat(F.lit("M"), F.substring(word, i, F.lit(3))))
    ends = F.array(F.concat(F.lit("H"), F.substring(word, 1, 2)), F.concat(F.lit("T"), F.expr("right(word, 2)")))
    short = F.when(n <= 4, F.array(F.concat(F.lit("B"), F.substring(word, 1, 1), F.expr("right(word, 1)")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(ends, short, F.when(n >= 3, runs).otherwise(F.array().cast("array<string>"))))


def asked_fragments(word: Column) -> Column:
    """Those of an asked word: its own, and of words of two and three those of its swapped forms."""
    n = F.length(word)
    a, b, c = (F.substring(word, i, 1) for i in (1, 2, 3))
    two = F.array(F.concat(F.lit("H"), b, a), F.concat(F.lit("T"), b, a))
    three = F.array(F.concat(F.lit("M"), b, a, c), F.concat(F.lit("M"), a, c, b))
    swapped = F.when(n == 2, two).when(n == 3, three).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(fragments(word), swapped))


def suggestions(spelling: DataFrame, words: DataFrame, max_edit: int = 2) -> DataFrame:
    """word, suggestion for each of words (word): least edits, then most frequent, then first by bytes; null without one.

    Candidates share a fragment with the word or, if that has two or three letters, with a swap of it; a word that is itself more frequent than its candidates needs none."""
    known = spelling.select("word", "freq").withColumn("frag", F.explode(fragments(F.col("word")))).select(F.col("word").alias("cand"), "freq", "frag")
    asked = words.select("word").distinct().where("length(word) > 1")
    pairs = asked.withColumn("frag", F.explode(asked_fragments(F.col("word")))).join(known, "frag").select("word", "cand", "freq").distinct()
    most = F.least(F.lit(max_edit), F.length("word") - 1)
    pairs = pairs.where((F.abs(F.length("word") - F.length("cand")) <= most) & (F.col("cand") != F.col("word")))
    pairs = pairs.withColumn("d", _osa("word", "cand", most)).where(F.col("d") <= most)
    best = Window.partitionBy("word").orderBy("d", F.desc("freq"), "cand")
    pairs = pairs.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    own = spelling.select("word", F.col("freq").alias("own"))
    x = words.select("word").distinct().join(pairs, "word", "left").join(own, "word", "left")
    return x.select("word", F.when(F.coalesce("own", F.lit(0)) < F.col("freq"), F.col("cand")).alias("suggestion"))


def synonym_added(synonyms: DataFrame, new: DataFrame) -> DataFrame:
    return synonyms.unionByName(new.select("term", "synonym")).distinct()


def synonym_removed(synonyms: DataFrame, gone: DataFrame) -> DataFrame:
    return synonyms.join(gone.select("term", "synonym"), ["term", "synonym"], "left_anti")
