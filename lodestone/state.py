"""Places that every executor can read, and checks of size before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast; beyond them a join shuffles. The driver holds some of them at once, so they are few.
BROADCAST_BYTES = 8 << 20
#: Bytes of tables for each partition of a shuffle; and, in MB, what a task reads at most of shuffles and of files, and what Spark may broadcast of
#: its own accord: that is measured as it was shuffled, packed, and takes many times as much in the driver.
SHUFFLE_BYTES, MOST_MB = 8 << 20, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 4, "spark.sql.files.maxPartitionBytes": 16, "spark.sql.autoBroadcastJoinThreshold": 1}
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, one is made if the session runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="checkpoint-"))
    return _own[0]


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder; 0 if it isn't there."""
    where, files = _place(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


def sized(spark: SparkSession, data_bytes: int) -> SparkSession:
    """A session with the settings of this one, but so many partitions of shuffles that the memory of a task doesn't grow with the data.

    A fixed number of partitions would give each task the more rows, the larger the tables are: sorts and hash tables then take all memory there is.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and own.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.shuffle.partitions", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-data_bytes // SHUFFLE_BYTES)))
    for k, mb in MOST_MB.items():
        if (now := spark.conf.get(k)) != "-1":
            own.conf.set(k, f"{min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now), mb << 20)}b")
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read again: no lineage, known size, safe from lost executors.

    The table goes when the session's JVM ends.
    """
    return write(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``checkpoint``, and the number of rows, which the write itself counts."""
    seen = Observation()
    kept = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept, seen.get["n"]


def write(df: DataFrame) -> tuple[DataFrame, str]:
    """``checkpoint``, and the path of the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where, files = _place(spark, path)
    files.delete(where, True)


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def numbered(df: DataFrame, name: str, *keys) -> DataFrame:
    """df with the numbers 0, 1, ... in the order of the keys: ranges are sorted apart, and only one count for each comes to the driver."""
    bits = 33  # of monotonically_increasing_id, for the place in a partition
    kept = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", bits)
    sizes = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base = [(p, sum(n for _, n in sizes[:k])) for k, (p, _) in enumerate(sizes)]
    before = df.sparkSession.createDataFrame(base, "_part long, _base long")
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << bits) - 1)).drop("_at", "_part", "_base")


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows take at most so many bytes, as it is otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
