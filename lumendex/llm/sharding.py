"""Hilbert-curve sharding: documents near each other in several metadata dimensions share a shard.

Language, source and text size are quantised to BITS bits each; the cell's place on the Hilbert curve orders the rows,
and runs of the order are the shards, so that a shard covers few values of every dimension and files are pruned by
any of them. The NAMED commonest languages, and sources, have a code each, the others share the rest by a hash; sizes
are cut at quantiles of a logarithmic histogram, so that each code holds about as many rows. Law `rows`: of N rows, row
number i goes to shard i * shards div N, so counts are at most one apart.

Row numbers are exact and nothing is sorted in one place: cells are counted; a cell of many rows (a hot source) is
dealt by a hash of doc_id into runs of about RUN rows, a run that is far longer (rows of one id) again by the rows' places
in the table of keys, and the number of a row is that of its run's first row plus its place in the run. The table of
cells has at most 2 ** (3 * BITS) rows, those of codes 2 ** BITS, of sizes about a thousand. Native throughout.

Defined results: a null text is empty (size 1, CRC 0), texts of any length count whole; a null language, source or id
counts as the empty string; rows alike in every key take consecutive slots, or if they fill several runs, any slots of
these; with fewer rows than shards some shards are empty; an empty table gives an empty result; columns of docs of any
name don't matter, and write_shards carries them (the folder's column is `shard`, or `shard_` if docs has one of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import cut, fresh, own, table

BITS = 4
SHARDS = 16
RUN = 4096
NAMED = 12
BINS_PER_E = 20
HOT_RUNS = 1 << 16
FILE_ROWS = 1 << 18


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a cell on the Hilbert curve through the cube of 2 ** bits cells a side.

    From the most significant bit down, each coordinate's bit says whether the axes below are mirrored or swapped with
    the first; the Gray code of what results is read off a bit of every coordinate at a time."""
    x, n = list(point), len(point)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        if x[n - 1] & q:
            t ^= q - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] ^ t) >> b & 1
    return out


def curve(bits: int = BITS) -> list[int]:
    """Index on the curve of cell (a, b, c), at a * 4**bits + b * 2**bits + c."""
    side = range(1 << bits)
    return [hilbert_index((a, b, c), bits) for a in side for b in side for c in side]


def _code(named: str, value: str) -> Column:
    """The code of a value: its own if it is named, else one of the rest by a hash."""
    return F.expr(f"cast(coalesce({named}[{value}], {NAMED} + pmod(crc32({value}), {(1 << BITS) - NAMED})) as int)")


def _named(x: DataFrame, column: str) -> DataFrame:
    """One row: `column`'s NAMED commonest values, each with its rank from 0."""
    top = x.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(NAMED)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))), lambda v, i: F.struct(v["v"].alias("v"), i.alias("i")))
    return top.agg(F.map_from_entries(ranked).alias(f"named_{column}"))


def _size_codes(x: DataFrame) -> DataFrame:
    """One row: the code of each bin of sizes, by the rows in the bins below."""
    bins = x.groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")  # over the bins
    below = bins.select("bin", (F.sum("n").over(w) - F.col("n")).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return below.agg(F.map_from_entries(F.collect_list(F.struct("bin", F.expr(f"cast({1 << BITS} * below div all as int)")))).alias("codes"))


def keyed(docs: DataFrame, *carry: str) -> DataFrame:
    """carry, doc_id, size, text_crc32, lang and source ('' for null), the three quantised dimensions and their cell's place on the curve."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    of = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    x = docs.select(*carry, "doc_id", *of, (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    x = cut(x.withColumn("bin", F.floor(F.log("size") * BINS_PER_E).cast("int")), "sharding-keys", narrow=True)
    one = _named(x, "lang").join(F.broadcast(_named(x, "source")), F.lit(True)).join(F.broadcast(_size_codes(x)), F.lit(True))
    x = x.join(F.broadcast(one), F.lit(True), "left")  # one row, of at most 2 * NAMED values and a thousand bins
    x = x.withColumns({"q_lang": _code("named_lang", "lang"), "q_source": _code("named_source", "source"), "q_size": F.expr("codes[bin]")})
    cell = F.col("q_lang") * (1 << 2 * BITS) + F.col("q_source") * (1 << BITS) + F.col("q_size")
    return x.withColumn("h", F.element_at(F.lit(curve()), cell + 1)).drop("bin", "codes", "named_lang", "named_source")


def place(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keys with `at`, their number in the order (h, run, part of the run, text_crc32, doc_id) from 0; and one row with the number of rows."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    cells = keys.groupBy("h").agg(F.count("*").alias("cell_rows"))
    cells = cells.withColumn("runs", F.ceil(F.col("cell_rows") / RUN))
    x = keys.join(F.broadcast(cells), "h").withColumn("run", F.pmod(F.crc32(own.cast("binary")), F.col("runs")).cast("long")).drop("cell_rows", "runs")
    # runs much longer than a hash of unlike ids makes them; any beyond the HOT_RUNS longest holds less than one row in HOT_RUNS
    long = x.groupBy("h", "run").agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * RUN).orderBy(F.desc("rows"), "h", "run").limit(HOT_RUNS)
    x = x.join(F.broadcast(long.select("h", "run", F.ceil(F.col("rows") / RUN).alias("parts"))), ["h", "run"], "left")
    x = x.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))).drop("parts")
    runs = x.groupBy("h", "run", "part").agg(F.count("*").alias("run_rows"))
    runs = runs.withColumn("in_cell", F.sum("run_rows").over(Window.partitionBy("h").orderBy("run", "part")) - F.col("run_rows"))
    first = cells.withColumn("cell_first", F.sum("cell_rows").over(Window.orderBy("h")) - F.col("cell_rows")).select("h", "cell_first")
    runs = runs.join(F.broadcast(first), "h").select("h", "run", "part", (F.col("cell_first") + F.col("in_cell")).alias("run_first"))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("h", "run", "part").orderBy("text_crc32", "doc_id")))
    x = x.join(runs, ["h", "run", "part"]).withColumn("at", F.col("run_first") + F.col("rn") - 1).drop("rn", "run_first")
    return x, cells.agg(F.sum("cell_rows").alias("all_rows"))


def assign(docs: DataFrame, shards: int = SHARDS, *carry: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law rows), and the quantised dimensions; and the columns to carry."""
    x, n = place(keyed(docs, *carry))
    x = x.join(F.broadcast(n), F.lit(True), "left")
    x = x.withColumn("shard", F.expr(f"cast(at * {shards} div all_rows as int)"))
    first = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")  # the least number whose shard this is
    return x.select(
        *carry, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("h").cast("int").alias("hilbert"), "q_lang", "q_source", "q_size", "lang", "source",
    )


def manifest(assigned: DataFrame) -> DataFrame:
    """What each shard covers: rows, bytes, least and greatest values, its languages' and sources' codes; and the codes of the named values."""
    out = assigned.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.sort_array(F.collect_set("q_lang")).alias("langs"), F.sort_array(F.collect_set("q_source")).alias("sources"),
        F.min("hilbert").alias("min_hilbert"), F.max("hilbert").alias("max_hilbert"),
    )
    for c in ("lang", "source"):
        named = assigned.where(F.col(f"q_{c}") < NAMED).groupBy(c).agg(F.first(f"q_{c}").alias("q"))
        out = out.join(F.broadcast(named.agg(F.map_from_entries(F.collect_list(F.struct(c, "q"))).alias(f"{c}_codes"))), F.lit(True))
    return out


def prune(manifest_: DataFrame, lang: str | None = None, source: str | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """The shards that can hold rows of the language, source and range of sizes (all that are given)."""
    out = manifest_
    for value, c in ((lang, "lang"), (source, "source")):
        if value is not None:
            name = fresh(out, "asked")
            out = out.withColumn(name, F.lit(value)).where(F.array_contains(f"{c}s", _code(f"{c}_codes", name))).drop(name)
    if sizes:
        out = out.where((F.col("max_size") >= sizes[0]) & (F.col("min_size") <= sizes[1]))
    return out


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """docs as one folder for each shard, in files of about FILE_ROWS rows along the curve.

    Rows are written once with a number of their own; keys are placed by it, and the texts go to their files in one shuffle after the join."""
    x, names = own(docs)
    x = cut(x.withColumn("number", F.monotonically_increasing_id()), "sharding-rows")
    at = assign(x.withColumnsRenamed({names[c]: c for c in ("doc_id", "lang", "source", "text")}), shards, "number").select("number", F.col("shard").alias("__shard"), "slot")
    parts = max(shards, 2 * (-(-x.count() // FILE_ROWS)))
    x = x.join(at, "number").withColumn("file", F.expr(f"slot div {FILE_ROWS}"))
    x = x.repartition(parts, "__shard", "file").sortWithinPartitions("__shard", "slot")
    x.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("__shard").alias(fresh(docs, "shard"))).write.partitionBy(fresh(docs, "shard")).parquet(path)


def op2(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert", "q_lang", "q_source", "q_size")
