"""Registering queries, and reading the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configured


def registrar() -> tuple[dict, dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def register(sql: str | None = None):
        def keep(fn: Callable[[Tables], DataFrame]):
            queries[fn.__name__] = lambda spark, sf_dir: fn(Tables(configured(spark), sf_dir))
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return keep

    return queries, oracles, register


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def micros(c: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone, taken as UTC."""
    return F.unix_micros(F.col(c).cast("timestamp"))
