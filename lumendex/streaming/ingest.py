"""Documents and events as streams: an index that grows by micro-batches, facets that run on, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.catalog import Catalog
from ..sources.writer import Database, replaced_by_term


def index_stream(docs: DataFrame, db: Database, make: Callable[[DataFrame], Catalog], prefix: str = "Q", checkpoint: str | None = None) -> DataStreamWriter:
    """A stream of (key, text, ...) into a database: upserts by the unique term prefix + key.

    A batch that is delivered again after a failure finds its number in the pointer and changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        db.reopen()
        last = df.groupBy("key").agg(F.max_by(F.struct("*"), F.struct("*")).alias("r")).select("r.*") if "at" not in df.columns else df.groupBy("key").agg(F.max_by(F.struct("*"), "at").alias("r")).select("r.*")
        db.commit(replaced_by_term(db.catalog, last, prefix, make, db.last_did), batch=f"batch-{number}")

    out = docs.writeStream.foreachBatch(batch).outputMode("append")
    return out.option("checkpointLocation", checkpoint) if checkpoint else out


def running_facets(matches: DataFrame, value: str = "value") -> DataFrame:
    """value, n over all rows so far."""
    return matches.where(F.col(value) != "").groupBy(value).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events of each type in windows of event time; rows later than `late` are dropped (an extension, for event streams)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a pause."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(spark, folder: str, schema: str) -> DataFrame:
    """A replica's side: changeset files of a folder as they appear."""
    return spark.readStream.schema(schema).parquet(folder)


def percolate(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Standing queries over a batch of documents (did, text): did, query where all terms of a query (query, term) occur."""
    from ..sources.catalog import words_of

    size = terms.distinct().groupBy("query").agg(F.count("*").alias("need"))
    x = docs.select("did", F.explode(F.array_distinct(words_of("text"))).alias("term")).join(terms.distinct(), "term")
    return x.groupBy("did", "query").agg(F.count("*").alias("have")).join(size, "query").where("have = need").select("did", "query")
