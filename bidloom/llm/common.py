"""Scratch tables in the shared folder, size-checked semi joins and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when an aggregation proves that it has no more rows and bytes than this.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as Hadoop resolves it. Where none is set, a local session (tests) gets a
    temporary one; on a cluster that would scatter tables over the machines, so there it is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='bidloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; executors that are lost take nothing with them."""
    return f"{shared_dir(spark).rstrip('/')}/bidloom/{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def hinted(small: DataFrame) -> DataFrame:
    """small (saved, so that measuring it is cheap) with a broadcast hint if its rows and bytes are proven few."""
    width = F.lit(0)
    for c, kind in small.dtypes:
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map")):
            width += 32 * F.coalesce(F.size(c), F.lit(0))
        width += 16
    n, size = small.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(small) if n <= BROADCAST_KEYS and size <= BROADCAST_BYTES else small


def having(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is in keys (one column of that name, saved); broadcast only after measuring."""
    return df.join(hinted(keys), on, "left_semi")


def lacking(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` isn't in keys; nulls stay."""
    return df.join(hinted(keys), on, "left_anti")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each step is one aggregation with
    map-side combine and one equi join, never holds a component in one place, and the number of edges
    doesn't grow. Every step is written to the shared folder. Self loops and repeated edges do no harm.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e, before = e.where("u <> v"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = saved(small.where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
