"""Boxes on pages, made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()


def boxes(t: Tables, name: str, step: int) -> DataFrame:
    k = F.col("p_partkey") * step
    x, y = (k % 90).cast("double"), (k * 3 % 80).cast("double")
    return t.part.select((F.col("p_partkey") % 50).alias("page"), F.col("p_partkey").alias(name), x.alias("x0"), y.alias("y0"), (x + 4 + F.col("p_size") % 9).alias("x1"), (y + 3 + F.col("p_size") % 7).alias("y1"))


def _sql(step: int) -> str:
    return f"SELECT p_partkey % 50 AS page, p_partkey AS k, (p_partkey * {step} % 90)::DOUBLE AS x0, (p_partkey * {step} * 3 % 80)::DOUBLE AS y0, (p_partkey * {step} % 90 + 4 + p_size % 9)::DOUBLE AS x1, (p_partkey * {step} * 3 % 80 + 3 + p_size % 7)::DOUBLE AS y1 FROM part"


@query(f"""WITH i AS (SELECT page AS block, k AS item, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({_sql(7)})), h AS (SELECT *, CASE WHEN block % 5 = 0 THEN 60 ELSE 100 END AS lim FROM i),
 v AS (SELECT *, CASE WHEN cy < lim THEN floor(cy / 20)::INT END AS row FROM h) SELECT block, item, row, CASE WHEN cx < 80 THEN floor(cx / 40)::INT END AS col FROM v ANTI JOIN (SELECT DISTINCT block FROM v WHERE row IS NULL) USING (block)""")
def grid_cells(t: Tables) -> DataFrame:
    items = boxes(t, "item", 7).withColumnRenamed("page", "block")
    blocks = items.select("block").distinct()
    rows = blocks.select("block", F.explode(F.expr("sequence(0, if(block % 5 = 0, 2, 4))")).alias("row")).select("block", "row", (F.col("row") * 20.0).alias("y0"), (F.col("row") * 20.0 + 20).alias("y1"))
    cells = rows.select("block", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("col")).select("block", "row", "col", (F.col("col") * 40.0).alias("x0"), (F.col("col") * 40.0 + 40).alias("x1"))
    return geometry.placed_in_grid(items, rows, cells)


@query(f"""WITH m AS ({_sql(7)}), b AS ({_sql(11)}), j AS (SELECT m.page, m.k AS mark, b.k AS block, greatest(least(m.y1, b.y1) - greatest(m.y0, b.y0), 0) AS h, m.x0 - b.x1 AS gap FROM m JOIN b ON m.page = b.page AND b.x1 <= m.x0),
 r AS (SELECT page, mark, block, row_number() OVER (PARTITION BY page, mark ORDER BY h DESC, gap, block) AS n FROM j WHERE h > 0) SELECT m.page, m.k AS mark, r.block FROM m LEFT JOIN r ON r.page = m.page AND r.mark = m.k AND n = 1""")
def blocks_beside(t: Tables) -> DataFrame:
    return geometry.beside(boxes(t, "mark", 7), boxes(t, "block", 11))


@query(f"""SELECT *, round(100 * x0 / 120, 2) AS x0_pct, round(100 * y0 / 100, 2) AS y0_pct, round(100 * x1 / 120, 2) AS x1_pct, round(100 * y1 / 100, 2) AS y1_pct FROM (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_sql(7)}) GROUP BY page)""")
def united_boxes(t: Tables) -> DataFrame:
    return geometry.united(boxes(t, "item", 7), ["page"], 120.0, 100.0)
