"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="records-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or _local_folder()).rstrip('/')}/records-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, with its size known to the planner and no lineage behind it."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._path = path
    return out


def unbroadcast(df: DataFrame) -> DataFrame:
    """df for joins that shuffle both sides, unless the other one has a broadcast hint. Else the planner broadcasts through the driver what is small as a file,
    however many rows are exploded from it and however much they weigh in memory.
    """
    out = df.hint("merge")
    if hasattr(df, "_path"):
        out._path = df._path
    return out


def spread(df: DataFrame, *keys: str, rows: int = 100_000) -> DataFrame:
    """df dealt (by the keys, if any) into parts of about so many of its counted rows, at least spark.sql.shuffle.partitions. For work that is heavy for what its rows weigh in a file,
    which else falls to one task, and for memory that else grows with the share of a fixed number of tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-df.count() // rows)), *keys)


def once(df: DataFrame, columns: dict[str, Column], keep: Column) -> DataFrame:
    """df with the columns, of the rows to keep. The columns are computed once: no predicate is pushed below a projection that numbers its rows."""
    return df.withColumns(columns | {"_row": F.monotonically_increasing_id()}).filter((F.col("_row") >= 0) & keep).drop("_row")


def remove(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing will read again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._path).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
