"""Tables written between the steps of a plan, so that each step reads rows and not the steps before it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, deleted when the session's JVM ends; a temporary one only in a local session that names no folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='partloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the folder of spark.checkpoint.dir and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, about, where the number of tasks grows with the rows; and rows below which a task isn't worth it.
TASK_ROWS, LEAST_ROWS = 1 << 18, 1 << 14


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks to deal `rows` over: their number, not their memory, grows with the rows."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // LEAST_ROWS), 1 + rows // TASK_ROWS)
