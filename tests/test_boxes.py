"""Neighbours and overlaps of boxes against plain searches, and without comparing equal boxes again."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from bidloom.operators import geometry
from bidloom.operators import relational as rel


def _boxes(rng: random.Random, n: int, most: int) -> list[tuple]:
    out = []
    for i in range(n):
        x, y = rng.randrange(most), rng.randrange(most)
        out.append((rng.randrange(2), i, float(x), float(y), float(x + rng.randrange(1, 5)), float(y + rng.randrange(1, 5))))
    return out


def test_beside(spark):
    rng = random.Random(5)
    marks, blocks = _boxes(rng, 120, 9), _boxes(rng, 120, 9)
    shape = "page int, {} int, x0 double, y0 double, x1 double, y1 double"
    m, b = spark.createDataFrame(marks, shape.format("mark")), spark.createDataFrame(blocks, shape.format("block"))
    for left in (True, False):
        want = []
        for page, mark, x0, y0, x1, y1 in marks:
            gap = lambda r: x0 - r[4] if left else r[2] - x1
            high = lambda r: min(y1, r[5]) - max(y0, r[3])
            near = [r for r in blocks if r[0] == page and gap(r) >= 0 and high(r) > 0]
            want.append((page, mark, max(near, key=lambda r: (high(r), -gap(r), -r[1]))[1] if near else None))
        assert sorted(map(tuple, geometry.beside(m, b, left).collect())) == sorted(want)


def test_best_overlap(spark):
    rng = random.Random(6)
    blocks, grids = _boxes(rng, 120, 7), _boxes(rng, 120, 7)
    b = spark.createDataFrame(blocks, "page int, block int, bx0 double, by0 double, bx1 double, by1 double")
    g = spark.createDataFrame(grids, "page int, grid int, gx0 double, gy0 double, gx1 double, gy1 double")
    want = []
    for page, block, x0, y0, x1, y1 in blocks:
        share = lambda r: max(min(x1, r[4]) - max(x0, r[2]), 0.0) * max(min(y1, r[5]) - max(y0, r[3]), 0.0) / ((x1 - x0) * (y1 - y0))
        near = [r for r in grids if r[0] == page and share(r) >= 0.4]
        if near:
            best = max(near, key=lambda r: (share(r), -r[1]))
            want.append((page, block, best[1], share(best)))
    assert sorted(map(tuple, rel.best_overlap(b, g, 0.4).collect())) == sorted(want)


def test_equal_boxes_compared_once(spark):
    """Twelve billion pairs of equal boxes of a page take no longer than one."""
    k = spark.range(110_000)
    box = lambda name, x: k.select(F.lit(1).alias("page"), F.col("id").alias(name), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (x, 0.0, x + 1, 1.0), strict=True)])
    begin = time.time()
    assert geometry.beside(box("mark", 2.0), box("block", 0.0)).where("block = 0").count() == 110_000
    b, g = (box(n, 0.0).select("page", n, *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")]) for n, p in (("block", "b"), ("grid", "g")))
    assert rel.best_overlap(b, g).where("grid = 0 and share = 1").count() == 110_000
    assert time.time() - begin < 60
