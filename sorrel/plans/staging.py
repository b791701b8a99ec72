"""Staged tables, size-checked broadcasts and joins that survive hot keys.

A staged table is a Parquet table in the folder that ``spark.checkpoint.dir``
names.  It cuts lineage, outlives lost executors and, unlike a cached or
checkpointed RDD, keeps column pruning and filter pushdown for its readers.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

# A table of at most this many bytes may be broadcast, and of no more rows than this.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 500_000
# Bytes of text in a partition of documents: their n-grams take many times as much memory, and no task should write them to disk.
TEXT_BYTES = 8 * 1024 * 1024
# Bytes of an Arrow batch that Python workers get, unless the session has its own limit instead of Spark's.
ARROW, ARROW_DEFAULT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"
# Whether Spark removes a job's shuffle files when the job ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The largest number of keys that the hot part of a split join can hold.
HOT_KEYS = 20_000

_ROOTS: dict[str, str] = {}
_TABLES: dict[str, set] = {}
_SCRATCH: list = []


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's own, or a local one in tests."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="sorrel-")
        _ROOTS[app] = f"{base.rstrip('/')}/sorrel-{app}-{uuid.uuid4().hex[:8]}"
    return _ROOTS[app]


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this session."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, ()):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Deletes the tables staged inside its block when the block ends, but for those that are kept."""

    def __init__(self):
        self.tables, self.kept = [], set()

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {getattr(t, "_path", None) for t in tables}

    def __enter__(self) -> Scratch:
        _SCRATCH.append(self)
        return self

    def __exit__(self, *error) -> None:
        _SCRATCH.pop()
        for t in self.tables:
            if t._path not in self.kept:
                drop_stage(t)
            elif _SCRATCH:
                _SCRATCH[-1].tables.append(t)


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    where, name = getattr(df, "_path", None), getattr(df, "_table", None)
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        _TABLES.get(df.sparkSession.sparkContext.applicationId, set()).discard(name)
    if where:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "t", schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` once and return the written table.

    A table that is staged already is returned as it is.  ``schema`` reads the
    table back under other types with the same storage form.
    """
    if getattr(df, "_staged", False):
        return df
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._staged, out._path = True, path
    if _SCRATCH:
        _SCRATCH[-1].tables.append(out)
    return out


def stage_freed(df: DataFrame, name: str = "t") -> DataFrame:
    """:func:`stage`, and the shuffle files of ``df`` are removed at once; for tables whose plan nothing else uses."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES)
    conf.set(FREE_SHUFFLES, "true")
    try:
        return stage(df, name)
    finally:
        conf.set(FREE_SHUFFLES, before)


def staged_bytes(df: DataFrame) -> int:
    """Bytes of a staged table's files."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes per Arrow batch, unless it was set already; it is read when a job runs."""
    if spark.conf.get(ARROW, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(ARROW, ARROW_BYTES)


def stage_by_document(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once in buckets of ``doc_id``, so that later joins and groups by document leave its rows where they are.

    A table whose partitions are already those of its documents (``by_document``) is written as it lies.
    """
    if getattr(df, "_staged", False):
        return df
    spark = df.sparkSession
    parts = getattr(df, "_parts", None)
    if parts is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(parts, "doc_id")
    unique = f"{name}_{uuid.uuid4().hex[:10]}"
    path = f"{staging_root(spark)}/{unique}"
    # A partition is one bucket, so there is nothing to sort before its file is written.
    conf, name = spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, max(2, int(before)))
    try:
        df.write.format("parquet").bucketBy(parts, "doc_id").option("path", path).saveAsTable(unique)
    finally:
        conf.set(name, before)
    _TABLES.setdefault(spark.sparkContext.applicationId, set()).add(unique)
    out = spark.table(unique)
    out._staged, out._path, out._table = True, path, unique
    if _SCRATCH:
        _SCRATCH[-1].tables.append(out)
    return out


def join_documents(rows: DataFrame, docs: DataFrame, how: str = "inner", small: bool | None = None) -> DataFrame:
    """Join many ``rows`` by ``doc_id`` to the far fewer ``docs``; the rows are not sorted, and not shuffled if staged by document.

    ``small`` tells whether ``docs`` fit a broadcast, if that is known.
    """
    small = fits(docs) if small is None else small
    return rows.join(F.broadcast(docs) if small else docs.hint("shuffle_hash"), "doc_id", how)


def by_document(docs: DataFrame) -> DataFrame:
    """Partition documents by id while they are still plain text.

    All later counting inside a document then needs no shuffle.  The number of
    partitions is given, since one chosen by the size of the text would be too
    small for the rows that come out of it: it grows with the text, so that the
    rows of a partition keep to the memory of a task.
    """
    if getattr(docs, "_by_document", False):
        return docs
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = [F.octet_length(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        size = docs.agg(F.sum(sum((F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(0)))).first()[0] or 0
        parts = max(parts, math.ceil(size / TEXT_BYTES))
    return keeps_documents(docs.repartition(parts, "doc_id"), parts)


def keeps_documents(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Mark a table made row by row from documents partitioned by id, into ``parts`` partitions if that is known."""
    df._by_document, df._parts = True, parts
    return df


def row_bytes(df: DataFrame):
    """Bytes of a row in the driver's hash table, from its types and the lengths of its texts and lists."""

    def width(column, kind):
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 24
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
                inner = F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + width(x, kind.elementType))
                return F.coalesce(inner, F.lit(0)) + 32
            return F.greatest(F.size(column), F.lit(0)) * 8 + 32
        if isinstance(kind, T.MapType):
            return width(F.map_keys(column), T.ArrayType(kind.keyType)) + width(F.map_values(column), T.ArrayType(kind.valueType))
        if isinstance(kind, T.StructType):
            return sum((width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return F.lit(8)

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32)).cast("long")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes.

    A staged table is measured once; of any other table no more than
    ``rows + 1`` rows are looked at.
    """
    if getattr(df, "_staged", False):
        if getattr(df, "_size", None) is None:
            df._size = tuple(df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first())
        n, held = df._size
    else:
        n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return n <= rows and held <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, else without one."""
    return F.broadcast(df) if fits(df, rows) else df


def skew_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    freq: str = "df",
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join many ``rows`` to a ``table`` with one row per key (inner or semi).

    ``table[freq]`` counts the key's rows.  A small table is broadcast.  For a
    large one the keys are split: fewer than ``hot_keys`` keys can each hold
    ``total / hot_keys`` rows, so those are broadcast and their rows are never
    shuffled; the shuffle join sees only keys below that share.
    """
    if fits(table, broadcast_rows):
        side = table if how == "inner" else table.select(*on)
        return rows.join(F.broadcast(side), on, how)
    total = table.agg(F.sum(freq).alias("n")).first()["n"] or 0
    floor = max(1, math.ceil(total / hot_keys))
    hot = table.filter(F.col(freq) >= floor)
    cold = table.filter(F.col(freq) < floor)
    if how != "inner":
        hot, cold = hot.select(*on), cold.select(*on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on, how).unionByName(rest.join(cold, on, how))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group before this one by ``order``, whatever the group's size.

    One range sort spreads large groups over many tasks; sums run inside its partitions, and
    the groups' totals of earlier partitions, of which no more than one row per partition and group exist, are added.
    """
    by = [*group, *order]
    placed = stage(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), name)
    totals = placed.groupBy("_part", *group).agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *group, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(small_side(stage(offsets, "offsets")), ["_part", *group])
    return joined.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_offset", "_inside")


def assign_position(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Add a dense 0-based position by ``order`` without a one-partition window.

    Rows are range-partitioned and sorted, and written with their partition and
    place in it, so a retried task cannot change the numbers.  Only one row
    count per partition is summed up on the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ident = F.monotonically_increasing_id()
    placed = stage(
        ranged.withColumn("_part", F.shiftright(ident, 33)).withColumn(
            "_place", ident.bitwiseAND(F.lit((1 << 33) - 1))
        ),
        name,
    )
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, seen = [], 0
    for part, n in counts:
        offsets.append((part, seen))
        seen += n
    table = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    out = placed.join(F.broadcast(table), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def rank_within(df: DataFrame, group: list[str], order: list, name: str = "rank") -> DataFrame:
    """1-based rank by ``order`` inside each group, whatever the group's size.

    One global range sort numbers all rows; the first number of each group is
    taken off.  A group that holds most rows is so spread over many tasks.
    """
    placed = assign_position(df, [*[F.col(c).asc() for c in group], *order], "_pos")
    starts = stage(placed.groupBy(*group).agg(F.min("_pos").alias("_start")), "starts")
    ranked = placed.join(small_side(starts), group)
    return ranked.withColumn(name, F.col("_pos") - F.col("_start") + 1).drop("_pos", "_start")
