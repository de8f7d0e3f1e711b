"""What the operators share: reading tables, cutting lineage into the shared folder, document hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import shared_dir

#: Word of the contracts: a run of anything but space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What Python workers get at a time: whole texts are long, and workers' memory is short. Shuffle files go with the query
#: that made them, as every intermediate table is written and read again. A session that sets other values keeps them.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304"),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
    # a writer holds a row group in memory and a reader a column of it: whole texts make either large
    "parquet.block.size": ("134217728", "16777216"),
}


def settle(spark: SparkSession) -> None:
    """Give the session the settings above where it has Spark's own defaults; done once, by the first table that is read."""
    for key, (default, value) in SETTINGS.items():
        if spark.conf.get(key, default).removesuffix("b").lower() == default:
            spark.conf.set(key, value)


_libc = ctypes.CDLL(None)
_paths: dict[int, tuple[DataFrame, str]] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    settle(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    made = spark.read.schema(df.schema).parquet(path)
    _paths[id(made)] = made, path
    return made


def remove(*tables: DataFrame) -> None:
    """Empty tables that ``cut`` wrote, once nothing reads them any more: only an empty file of each stays."""
    for df in tables:
        _, path = _paths.pop(id(df))
        df.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def give_back(spark: SparkSession) -> None:
    """Return memory that the driver has freed: collected tables and broadcast arrays come and go from step to step, and what
    the allocators keep of them would add up beside the driver's JVM. That one keeps what plans leave behind until its heap is
    full; past half of it the garbage goes, and with it the broadcasts that nothing holds any more."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.java.lang.System.gc()


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % buckets


def words(text: Column) -> Column:
    """Array of the text's words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


#: Bytes in one part of a range sort, at most on average.
PART_BYTES = 64 << 20


def parts_of(spark: SparkSession, size: int) -> int:
    """How many parts to deal ``size`` bytes out to: as many as the session asks for, and more where these would be large."""
    return max(partitions(spark), -(-size // PART_BYTES))


def drawn(df: DataFrame, most: int, *key: str) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of their key. A filter on the hash leaves about twice as many where they lie,
    so that no task sorts or sends more than its share."""
    share, h = 2 * most / max(1, df.count()), F.xxhash64(*key)
    few = df.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else df
    return few.orderBy(h, *key).limit(most)
