"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local session without that setting gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: what follows plans from its columns alone, and lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """As `written`, dealt out by the keys: groups, windows and joins by them do not move these rows again. Only the plan that is returned names the table."""
    spark = df.sparkSession
    path, name = shared_folder(spark, "bucketed"), f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marks df for broadcasting only if it was counted to have at most so many (narrow) rows; otherwise joins with it shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
