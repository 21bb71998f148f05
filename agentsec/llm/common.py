"""Helpers that the training-data operators share: tables, shared storage, checked joins, gapless ranks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A join side of at most this many narrow rows (some MB) may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 100_000


def bound_batches(spark: SparkSession) -> None:
    """At most 1000 rows in an Arrow batch: texts are long, and a worker holds whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give memory that Arrow and the C library hold for no object back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def released(task: Callable) -> Callable:
    """A function over batches that gives memory back when its task ends: workers live on, and each would keep its largest task's."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def released_group(group: Callable) -> Callable:
    """The same for a function of one group's table."""

    @functools.wraps(group)
    def run(t: pa.Table) -> pa.Table:
        try:
            return group(t)
        finally:
            release_memory()

    return run


def map_arrow(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(released(task), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all of Spark is one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="agentsec-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/agentsec-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str] | str, how: str, small_rows: int) -> DataFrame:
    """Join whose right side is broadcast only if its counted rows stay under the bound."""
    return big.join(F.broadcast(small) if small_rows <= BROADCAST_ROWS else small, on, how)


def row_keys(docs: DataFrame, out: str = "_key", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(`docs` with the long `out`, if ids repeat with other texts): rows get one key if they agree in id and text, else different ones.

    A key is the id, but where an id has several texts only one of them keeps it and the others get hashes that no row has. A null id has a null
    key. Texts of one id are told apart by 64-bit hashes.
    """
    rows = docs.withColumns({out: F.col(id_col).cast("long"), "_th": F.xxhash64(F.col(text_col).cast("string"))})
    twice = rows.filter(F.col(out).isNotNull()).groupBy(out).agg(F.min("_th").alias("_lo"), F.max("_th").alias("_hi")).filter("_lo < _hi")
    twice = materialize(twice.select(out, "_lo"), "repeated")
    n = twice.count()
    if not n:
        return rows.drop("_th"), False
    for salt in range(64):
        other = F.xxhash64(out, F.col("_th"), F.lit(salt))
        keyed = join_small(rows, twice, out, "left", n).withColumn("_id", F.col(out)).withColumn(out, F.when(F.col("_lo") != F.col("_th"), other).otherwise(F.col(out)))
        clash = keyed.filter(F.col(out).isNotNull()).groupBy(out).agg(F.min(F.xxhash64("_id", "_th")).alias("a"), F.max(F.xxhash64("_id", "_th")).alias("b"))
        if not clash.filter("a < b").limit(1).count():
            break
    return keyed.drop("_th", "_lo", "_id"), True


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_block: int = 4096, rows: int | None = None, spread: str | None = None) -> DataFrame:
    """`out`: 0, 1, 2, ... within `group`, without bringing a group into one task.

    Rows are dealt to blocks by the hash of `order`, or by the column `spread` modulo their number, ranked inside (group, block), and shifted by the rows of the
    blocks before. `df` must be cheap to read twice. Equal `order` values get adjacent ranks in no set order.
    """
    blocks = max(1, -(-(df.count() if rows is None else rows) // rows_per_block))
    dealt = df.withColumn("_blk", F.pmod(F.col(spread) if spread else F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group, "_blk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_blk").orderBy(*order)
    ranked = dealt.withColumn("_rn", F.row_number().over(inside) - 1)
    return ranked.join(starts, [*group, "_blk"]).withColumn(out, (F.col("_start") + F.col("_rn")).cast("long")).drop("_blk", "_start", "_rn")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
