"""Index scripts over tables."""

from pyspark.sql import functions as F

from lumendex.sources import ingest


def test_records_of_one_file_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "RECORDS", 100, raising=False)
    spark.range(2000).select(F.col("id").alias("did"), F.create_map(F.lit("name"), F.array(F.concat(F.lit("word w"), "id"))).alias("fields")).coalesce(1).write.parquet(f"{tmp_path}/r")
    c = ingest.scripted(spark.read.parquet(f"{tmp_path}/r"), "name : index field\n")
    in_task = [r.n for r in c.documents.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(in_task) == 2000 and max(in_task) < 300
    assert c.termstats.where("term = 'word'").first().termfreq == 2000 and c.termstats.count() == 2001
