"""Scores against answer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(hit: Column, of: Column, places: int = 3) -> Column:
    """Share rounded; null of nothing."""
    return F.round(F.try_divide(F.sum(F.when(hit & of, 1).otherwise(0)).cast("double"), F.sum(F.when(of, 1).otherwise(0))), places)


def recall(found: DataFrame) -> DataFrame:
    """all, marked and unmarked nodes: how many of the key were found. found: marked, hit."""
    return found.rollup("marked").agg(F.count("*").alias("nodes"), F.count_if("hit").alias("found"))


def bid_score(rows: DataFrame) -> DataFrame:
    """Values per letter: match, missed, mismatch, invented. rows: letter, expected, read."""
    e, r = F.col("expected"), F.col("read")
    return rows.groupBy("letter").agg(
        F.count_if(e.isNotNull() & (e == r)).alias("matched"),
        F.count_if(e.isNotNull() & r.isNull()).alias("missed"),
        F.count_if(e.isNotNull() & (e != r)).alias("mismatched"),
        F.count_if(e.isNull() & r.isNotNull()).alias("invented"),
    )


def similarity_stats(pairs: DataFrame) -> DataFrame:
    """mean, upper median and least similarity per group. The upper median is an element, not an interpolation."""
    # By rank, not by an array: a scope may hold any number of pairs.
    w = Window.partitionBy("scope")
    df = pairs.withColumns({"_i": F.row_number().over(w.orderBy("similarity")) - 1, "_n": F.count("*").over(w)})
    return df.groupBy("scope").agg(F.avg("similarity").alias("mean"), F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("similarity"))).alias("median"), F.min("similarity").alias("least"))


def outcome_counts(citations: DataFrame) -> DataFrame:
    return citations.groupBy("outcome").agg(F.count("*").alias("n"))
