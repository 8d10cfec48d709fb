"""Tables that end a lineage: written to the folder that all executors share, so that lost ones cost one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session on one machine that names none (tests) gets a temporary folder, any other an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='bidloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again: what uses it several times doesn't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/bidloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of joins by shuffle only: the planner takes exploded rows and packed files for smaller than they are, and would
    build them into one table in the driver's memory."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as a shuffle has: few bytes come as one task, however many rows are made of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
