"""Changing a database: snapshots in a folder, a pointer to the newest, documents added, replaced and deleted."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import TABLES, Catalog, with_statistics


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    with_ = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(with_)).decode()
    finally:
        with_.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that a reader sees the old or the new."""
    fs, p, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(tmp, p)


@dataclass
class Database:
    """A folder of snapshots. Readers keep the snapshot they opened; reopen() takes the newest."""

    spark: SparkSession
    path: str
    revision: int = field(init=False, default=0)
    last_did: int = field(init=False, default=0)
    uuid: str = field(init=False, default="")
    catalog: Catalog = field(init=False)

    def __post_init__(self):
        if not self.reopen():
            self.catalog, self.uuid = Catalog.empty(self.spark), uuid.uuid4().hex

    def reopen(self) -> bool:
        """Whether there was a newer snapshot."""
        text = _read(self.spark, f"{self.path}/CURRENT")
        if text is None:
            return False
        now = json.loads(text)
        if now["revision"] == self.revision:
            return False
        self.revision, self.last_did, self.uuid = now["revision"], now["last_did"], now["uuid"]
        self.catalog = Catalog.open(self.spark, f"{self.path}/{now['snapshot']}")
        return True

    def commit(self, catalog: Catalog, last_did: int | None = None, batch: str | None = None) -> None:
        """catalog as the newest snapshot: all tables first, the pointer last. The same batch is committed once."""
        text = _read(self.spark, f"{self.path}/CURRENT")
        old = json.loads(text) if text else {}
        if batch is not None and old.get("batch") == batch:
            self.reopen()
            return
        name = f"r{self.revision + 1}-{uuid.uuid4().hex[:8]}"
        catalog.save(f"{self.path}/{name}")
        most = last_did if last_did is not None else catalog.documents.agg(F.max("did")).first()[0] or 0
        _write(self.spark, f"{self.path}/CURRENT", json.dumps({"revision": self.revision + 1, "last_did": max(self.last_did, most), "uuid": self.uuid, "snapshot": name, "batch": batch}))
        self.reopen()

    # ---- changes of a catalog, as DataFrames

    def added(self, docs: DataFrame, make, order: str = "key") -> Catalog:
        """docs (key, ...) as new documents with the ids after the last one ever used, in the order of their keys.

        make: a function of docs with did to a catalog. Ids are dealt by counts of ranges of the keys, not by one sort."""
        return merged(self.catalog, make(numbered(docs, order, self.last_did)))


def numbered(docs: DataFrame, order: str, after: int = 0) -> DataFrame:
    """docs with did = after + 1, after + 2, ... along a column: a range sort, and one number for each partition.

    The sorted rows are kept, as two sorts may cut the ranges differently."""
    x = docs.sort(order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).persist()
    counts = {r["__part"]: r["n"] for r in x.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    first, total = {}, after
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    rows = list(first.items()) or [(0, after)]
    side = docs.sparkSession.createDataFrame(rows, "__part int, __first long")  # a row a partition
    x = x.join(F.broadcast(side), "__part")
    return x.withColumn("did", F.col("__first") + (F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)) + 1).drop("__part", "__at", "__first")


def deleted(c: Catalog, dids: DataFrame) -> Catalog:
    """Without the documents of dids (did)."""
    gone = dids.select("did").distinct()
    out = c.with_tables(**{t: getattr(c, t).join(gone, "did", "left_anti") for t in ("documents", "postings", "values")})
    return out.with_docstats(c.docstats.join(gone, "did", "left_anti"))


def deleted_by_term(c: Catalog, term: str) -> Catalog:
    return deleted(c, c.postings.where(F.col("term") == term).select("did"))


def merged(c: Catalog, new: Catalog) -> Catalog:
    """The documents of both; those of new take the place of old ones with their ids."""
    old = deleted(c, new.documents)
    out = {t: getattr(old, t).unionByName(getattr(new, t)) for t in TABLES}
    out["synonyms"] = out["synonyms"].distinct()
    out["spelling"] = out["spelling"].groupBy("word").agg(F.sum("freq").alias("freq"))
    keys = new.metadata.select("key")
    out["metadata"] = old.metadata.join(keys, "key", "left_anti").unionByName(new.metadata).where("value != ''")
    return c.with_tables(**out).with_docstats(old.docstats.unionByName(new.docstats))


def replaced_by_term(c: Catalog, docs: DataFrame, term_prefix: str, make, last_did: int) -> Catalog:
    """docs (key, ...) by their unique term (prefix + key): each takes the lowest document with it, the others go; without one it is added."""
    owner = c.postings.where(F.col("term").startswith(term_prefix)).select(F.expr(f"substring(term, {len(term_prefix) + 1})").alias("key"), "did")
    low = owner.groupBy("key").agg(F.min("did").alias("old"))
    x = docs.join(low, "key", "left")
    kept = x.where("old is not null").withColumnRenamed("old", "did")
    fresh = numbered(x.where("old is null").drop("old"), "key", last_did)
    gone = owner.join(docs.select("key"), "key", "left_semi").select("did")
    return merged(deleted(c, gone), make(kept.unionByName(fresh)))


#: Of documents' bytes in files, for each task that groups their postings.
EDITED_BYTES = 8 << 20


def _parts(documents: DataFrame) -> int:
    """Partitions that grow with the documents, so that a task's memory does not: a number given is not joined to fewer by Spark."""
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // EDITED_BYTES) if size < 1 << 50 else least  # a size that Spark does not know is taken for more


def edited(c: Catalog, tokens: DataFrame) -> Catalog:
    """Postings (did, term, wdf_inc, pos) added to documents, their statistics made anew for those documents only."""
    touched = tokens.select("did").distinct()
    old = c.postings_of(touched).select("did", "term", "wdf", "positions")
    more = tokens.select("did", "term", F.col("wdf_inc").cast("long").alias("wdf"), F.array_compact(F.array(F.col("pos").cast("int"))).alias("positions"))
    new = old.unionByName(more).repartition(_parts(c.documents), "did").groupBy("did", "term").agg(F.sum("wdf").alias("wdf"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    out = c.with_tables(postings=c.postings.join(touched, "did", "left_anti").unionByName(with_statistics(new)))
    # a document that has no row here is none of the catalog
    stats = new.groupBy("did").agg(F.sum("wdf").alias("doclen"), F.count("*").alias("uniq"), F.max("wdf").alias("wdfmax")).join(c.documents.select("did"), "did", "left_semi")
    return out.with_docstats(c.docstats.join(touched, "did", "left_anti").unionByName(stats))


def removed_terms(c: Catalog, gone: DataFrame) -> Catalog:
    """Without the postings of gone (did, term)."""
    touched = gone.select("did").distinct()
    left = c.postings.join(touched, "did", "left_semi").join(gone.select("did", "term"), ["did", "term"], "left_anti")
    stats = left.groupBy("did").agg(F.sum("wdf").alias("doclen"), F.count("*").alias("uniq"), F.max("wdf").alias("wdfmax"))
    left = left.select("term", "did", "wdf", "positions").join(stats, "did").select("term", "did", "wdf", "positions", "doclen", "uniq", "wdfmax")
    return c.with_tables(postings=c.postings.join(touched, "did", "left_anti").unionByName(left))


def compacted(shards: list[Catalog], renumber: bool = True) -> Catalog:
    """One catalog of several: ids one after another (or as they are), frequencies of spelling added, postings in order."""
    out, after = None, 0
    for c in shards:
        moved = {t: getattr(c, t).withColumn("did", F.col("did") + after) if renumber and "did" in getattr(c, t).columns else getattr(c, t) for t in TABLES}
        new = c.with_tables(**moved)
        out = new if out is None else merged(out, new)
        after += (c.stats["last_did"] or 0) if renumber else 0
    return out
