"""What several operators share: column picking, shared scratch tables, bounded filters, row numbers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python function handles at once, whatever the batches it is sent: texts are long.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words of 64 bits in the filter of ``maybe_in``: what it broadcasts never exceeds so many rows.
FILTER_WORDS = 1 << 16
_open: list[list[str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder. Where the session has Spark's default batch size for Python, BATCH_ROWS is set: at 10,000 long rows a batch fills 64 MB on either side."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by exact name and in this order.

    Works when ``df`` has further columns whose names repeat or differ from a wanted one
    in case only; of columns with the same name the first is taken.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def tidy() -> None:
    """Gives memory that Arrow and the allocator hold but do not use back to the system: Python workers are used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_batch(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for ``mapInArrow`` that hands ``work`` BATCH_ROWS rows at a time and tidies up after each, so that what one batch took is not held beside the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH_ROWS):
                    yield from work(batch.slice(lo, BATCH_ROWS))
                    tidy()
        finally:
            tidy()

    return run


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in the place the cluster shares.

    The place is ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets
    a temporary folder, set as the checkpoint directory; any other session is refused, since
    its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="filmcrate-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run in this block are deleted when it is done, not when the driver collects garbage. The setting is as before afterwards."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def settle(df: DataFrame, name: str, stays: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch place, compressed by ``codec`` (the session's if none), and read it back: lineage ends here.

    Inside ``passing`` the table is deleted at the end of that block, unless it ``stays``.
    """
    path = scratch(df.sparkSession, name)
    if _open and not stays:
        _open[-1].append(path)
    with freeing(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A scratch table, taken away wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled in this block are deleted when it ends; what leaves it must rest on one that stays."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` (long) is among ``ids`` (one long column), and by chance some others.

    A bit map of FILTER_WORDS words is broadcast, whatever the number of ids; the more ids there
    are, the more rows pass. It only spares the join that must follow the rows it would drop.
    """
    word = lambda h: h.bitwiseAND(F.lit(FILTER_WORDS - 1))
    bit = lambda h: F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")
    mark = F.xxhash64(F.col(ids.columns[0]), F.lit(1))
    words = ids.groupBy(word(mark).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(mark))).alias("_bits"))
    mine = F.xxhash64(F.col(column), F.lit(1))
    met = df.join(F.broadcast(words), word(mine) == F.col("_word"))
    return met.where(F.call_function("shiftrightunsigned", F.col("_bits"), bit(mine)).bitwiseAND(F.lit(1)) == 1).select(*df.columns)


def row_numbers(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``df`` with ``row_no``, 0 to n-1 in the given order, and n. No single task sees all rows.

    Rows are dealt by range and sorted in their range; a range's first number is the sum of
    the sizes of those before it, and only these sizes (one a partition) reach the driver.
    Rows equal in every order column are told apart by their place in the input, so that
    a value shared by many rows does not fill one range.
    """
    spark = df.sparkSession
    rows = df.withColumn("_at", F.monotonically_increasing_id())
    by = [*order, F.col("_at")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")
    low = F.lit((1 << 33) - 1)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(low))
    kept = settle(ranged, "ranged")
    sizes = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, first = 0, []
    for part, n in sizes:
        first.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(first, "_part int, _first long"))
    numbered = kept.join(offsets, "_part").withColumn("row_no", F.col("_first") + F.col("_nth"))
    return numbered.drop("_part", "_nth", "_first"), total
