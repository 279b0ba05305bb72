"""Shared-folder tables, bounded broadcasts and skew-safe joins used by the operators of this subpackage."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many rows; each such row is a few fixed-size values.
BROADCAST_ROWS = 200_000
BATCH_BYTES = "4m"
#: Bytes that a writer of stored() holds before it writes them.
ROW_GROUP_BYTES = 32 << 20
#: A key is hot if it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 1000
#: Partitions of an exchange at most; where there are more parts, a partition gets several, one after the other.
MOST_PARTS = 20_000


@functools.cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="terrier-")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_fallback()
    return f"{base.rstrip('/')}/terrier-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches between the JVM and Python hold at most BATCH_BYTES from here on: by default they hold up to 64 MB, twice a task."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, fixes the rows."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{work_dir(spark)}/{name}"
    schema = df.schema
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._terrier_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing will read again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._terrier_path).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """remove(), and the shuffle files of plans that are gone."""
    remove(*tables)
    collect_garbage(tables[0].sparkSession)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that the driver no longer holds, once its garbage is collected. What the last
    query held goes in a second round, after the references that the first has cleared.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def shrink_executors(spark: SparkSession) -> None:
    """Collects the executors' garbage, so that their heaps give back what an earlier stage filled, and a stage of a long job has the
    memory for its Python workers that it would have on its own. A task a core, each a call of System.gc().
    """
    if re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        return
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if df has at most ``limit`` rows (counts at most limit + 1)."""
    return df.limit(limit + 1).count() <= limit


def hash_line(rows: int, wanted: int) -> int:
    """A bound of signed 64-bit hashes that ``wanted`` of so many distinct ones, or slightly more, do not pass: a sample is chosen before anything leaves a task."""
    share = 1.0 if rows <= wanted else min(1.0, (wanted + 6 * wanted**0.5 + 10) / rows)
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


def narrow(df: DataFrame) -> DataFrame:
    """df, a table of a few fixed-size values a row, with a broadcast hint if it was counted to be few."""
    return F.broadcast(df) if few(df) else df


def restrict(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of df whose key is in keys (distinct): by broadcast if keys were counted to be few, else by shuffle."""
    return df.join(F.broadcast(keys) if few(keys) else keys, on, "left_semi")


def skew_safe_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left with right (one row per key, ``weight`` = number of left rows of the key).

    Keys holding over 1/HOT_SHARE of the ``total`` rows are fewer than HOT_SHARE, so they are broadcast; the other
    keys are shuffled, and none of them is hot.
    """
    if few(right):
        return left.join(F.broadcast(right), on)
    line = max(1000, total // HOT_SHARE)
    hot, cold = right.filter(F.col(weight) > line), right.filter(F.col(weight) <= line)
    keys = F.broadcast(hot.select(*on))
    return left.join(F.broadcast(hot), on).unionByName(left.join(keys, on, "left_anti").join(cold, on))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of the undirected edges; comp is the smallest node reachable.

    Alternates large-star and small-star, both are a grouped minimum and an equi join, until every component is a star
    around its smallest node; O(log^2 n) rounds. Each round is a table in the shared folder, and so is the result;
    nothing but one row of a check reaches the driver.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a <> b").distinct()
    e = stored(e, "edges")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        before, e = e, stored(small.distinct(), "edges")
        remove(before)
        if not _unsettled(e).take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    out = stored(e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select("b", "b").distinct().toDF("node", "comp")), "components")
    remove(e)
    return out


def _unsettled(e: DataFrame) -> DataFrame:
    """The nodes that have two smaller neighbours, or a smaller and a larger one; none if all components are stars."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1 and below > 0").select("node")
