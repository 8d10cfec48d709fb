"""Boxes on pages: cells of grids by centres, neighbours by overlap, unions. A box: x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import apart, spread


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def placed_in_grid(items: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(block, item, row, col) of items whose centre lies in a row, and the cell of it; null col between cells.

    items: block, item and a box; rows: block, row, y0, y1; cells: block, row, col, x0, x1. A grid that one of its items
    lies outside of is none: all of its block's items go. Items meet the rows of their own block only.
    """
    at = items.select("block", "item", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    r = rows.select(F.col("block").alias("_b"), "row", F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    c = cells.select(F.col("block").alias("_cb"), F.col("row").alias("_cr"), "col", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    j = at.join(r, (F.col("block") == F.col("_b")) & (F.col("cy") >= F.col("_y0")) & (F.col("cy") < F.col("_y1")), "left")
    void = j.groupBy("block").agg(F.count_if(F.col("row").isNull()).alias("_out")).where("_out = 0").select("block")
    j = j.join(void, "block", "left_semi").join(c, (F.col("block") == F.col("_cb")) & (F.col("row") == F.col("_cr")) & (F.col("cx") >= F.col("_x0")) & (F.col("cx") < F.col("_x1")), "left")
    return j.groupBy("block", "item").agg(F.min("row").alias("row"), F.min("col").alias("col"))


def beside(marks: DataFrame, blocks: DataFrame, left: bool = True) -> DataFrame:
    """(page, mark, block): the block left (or right) of a mark that shares most of its height, the nearest on ties.

    marks: page, mark and a box; blocks: page, block and a box. A mark without such a neighbour has none. Marks with equal
    edges have the same neighbour, and of blocks with equal edges only the first can be one: each set of edges is compared once.
    """
    edge, own = ("x0", "x1") if left else ("x1", "x0")
    b = blocks.groupBy(F.col("page").alias("_p"), F.col(own).alias("_x"), F.col("y0").alias("by0"), F.col("y1").alias("by1")).agg(F.min("block").alias("block"))
    m = marks.select("page", F.col(edge).alias("_m"), "y0", "y1").distinct()
    side = F.col("_x") <= F.col("_m") if left else F.col("_x") >= F.col("_m")
    gap = F.col("_m") - F.col("_x") if left else F.col("_x") - F.col("_m")
    j = spread(m, "page").join(apart(spread(b, "_p")), (F.col("page") == F.col("_p")) & side).withColumn("h", overlap(F.col("y0"), F.col("y1"), F.col("by0"), F.col("by1"))).where("h > 0")
    best = j.groupBy("page", "_m", "y0", "y1").agg(F.max_by("block", F.struct("h", -gap, -F.col("block"))).alias("block"))
    return marks.select("page", "mark", F.col(edge).alias("_m"), "y0", "y1").join(apart(best), ["page", "_m", "y0", "y1"], "left").select("page", "mark", "block")


def united(boxes: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """The box around all boxes of a key, and the same in percent of the page, to two places."""
    around = boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    share = {f"{c}_pct": F.round(100 * F.col(c) / (width if c[0] == "x" else height), 2) for c in ("x0", "y0", "x1", "y1")}
    return around.withColumns(share)
