"""Tables written once to the folder that driver and executors share.

A table stays while a DataFrame can read it. One that was not dropped by hand goes when a later table is written, once the
JVM has collected every plan over it (an RDD alone, taken from a DataFrame that is gone, does not hold a table)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_HELD: dict[str, object] = {}  # the JVM's weak reference to the list of files of each table's path; every plan over a table shares it
BATCH_ROWS = 1000
FILE_BYTES = 32 << 20
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FEWER = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder only for a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="lumendex-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumendex/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, narrow: bool = False, few: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and safe against lost executors.

    narrow: a few numbers a document, made by tasks that read whole texts; they are joined to files of a good size.
    few: a map over texts whose result is a fraction of them; a task takes the place of up to four, for the same reason.

    While it is written, Python gets rows in small batches, small partitions are joined to fewer files, and what the
    write shuffled goes when it is done: later jobs read the table."""
    spark = df.sparkSession
    sweep(spark)
    path = new_path(spark, name)
    rows = int(spark.conf.get(_BATCH, "10000"))
    bytes_ = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    size = max(FILE_BYTES, bytes_(spark.conf.get(_ADVISORY, "64m")))
    want = {_ADVISORY: f"{size}b", _CLEAN: "true", _FEWER: "false", _BATCH: str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in want}
    if few:
        parts = df._jdf.queryExecution().toRdd().getNumPartitions()
        df = df.coalesce(max(1, -(-parts // 4), min(parts, 2 * spark.sparkContext.defaultParallelism)))
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        (df.hint("rebalance") if narrow else df).write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    files = out._jdf.queryExecution().analyzed().relation().location()
    _HELD[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(files)
    return out


def small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_ROWS rows between Spark and Python for the session: documents are long rows."""
    rows = int(spark.conf.get(_BATCH, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that cut() or new_path() made, through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete the tables of cut() that no plan can read any more: what a query's or a stage's result was read from."""
    for path in [p for p, files in _HELD.items() if files.refersTo(None)]:
        del _HELD[path]
        delete(spark, path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() whose readers have all been written; other DataFrames are left alone."""
    for df in tables:
        if path := df.__dict__.pop("_cut_path", None):
            _HELD.pop(path, None)
            delete(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns own_0, own_1, ... in its order, clear of all other names; and the new name of each (the first of like names)."""
    names = {}
    for i, c in enumerate(df.columns):
        names.setdefault(c, f"own_{i}")
    return df.toDF(*[f"own_{i}" for i in range(len(df.columns))]), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
