"""Vector codes against plain Lloyd rounds that gather everything anew, and against SQL."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np

from bidloom.llm import queries, vector_codes

FOLDER = "/root/testdata/sf0.001"


def plain(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4):
    """{id: (code, error)} and codebooks by whole-number loops: each round sums all parts of each entry again."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort()
    width = len(kept[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in kept}
    books = [[cut[i][p] for i, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(v[p], c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own: dict[int, list] = {}
            for v in cut.values():
                own.setdefault(near(v, p)[1], []).append(v[p])
            new.append([[sum(x) // len(own[e]) for x in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])])
        books = new
    return {i: (bytes(near(v, p)[1] for p in range(parts)), sum(near(v, p)[0] for p in range(parts))) for i, v in cut.items()}, books


def test_equal_to_plain_rounds(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(c, 0.3) for c in rng.choices([-1, 0, 2], k=8)]) for i in range(200)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [math.nan] + [0.0] * 7), (303, [-math.inf] + [0.0] * 7), (304, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "cast(vec_id % 3 as string) as label", "1 as code", "2 as error", "3 as v").repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for entries in (7, 256):
        want, books = plain(single, entries=entries)
        codes, found = vector_codes.encoded(df, entries=entries)
        assert {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in codes.collect()} == want
        assert found.tolist() == books
    back = vector_codes.decoded(codes, found).where("vec_id = 304").first()
    assert back["vector"] == [x / 1024 for p, e in enumerate(want[304][0]) for x in books[p][e]]


def test_changes_only(spark):
    """Later rounds shuffle the entries that changed only, and running sums equal fresh ones."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(5 * (i % 4), 0.1) for _ in range(8)]) for i in range(400)]
    df = vector_codes.integers(spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<double>, label int"))
    _, _, changed = vector_codes.trained(df, entries=4, rounds=4)
    assert changed[0] == 16 and changed[-1] == 0


def test_large_components(spark):
    """Beyond what doubles hold, distances are whole numbers still; components stop at a stated size."""
    x = np.array([[1 << 27, -(1 << 27)], [(1 << 27) + 1, -(1 << 27)], [0, 0]], np.int64)
    at, d = vector_codes.nearest(x, x[[1, 2]])
    assert at.tolist() == [0, 0, 1] and d.tolist() == [1, 0, 0]
    df = spark.createDataFrame([(0, [1e30, 0.0, 0.0, 0.0], 1), (1, [0.5, 0.0, 0.0, 0.0], None)], "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.encoded(df)
    assert books[0].tolist() == [[vector_codes.limit(1)], [512]] and sorted(r["error"] for r in codes.collect()) == [0, 0]


def test_awkward_codes(spark):
    rows = [(None, [1.0, 2.0, 3.0, 4.0, 5.0], None), (5, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (5, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (6, [], 2), (7, [1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.with_label_errors(vector_codes.encoded(df)[0]).collect()
    assert sorted((str(r["vec_id"]), r["label"], r["label_error"]) for r in got) == [("5", 2, 0), ("5", 2, 0), ("None", None, 0)]
    assert vector_codes.encoded(df.limit(0))[0].count() == 0
    assert vector_codes.with_label_errors(vector_codes.encoded(df.where("vec_id > 5 and size(embedding) = 0"))[0]).count() == 0


def test_codes_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    got = queries.op12_delta_lloyd_codes(spark, FOLDER).toPandas().sort_values("vec_id").astype(str)
    want = db.execute(queries.ORACLE_SQL["op12_delta_lloyd_codes"]).df().sort_values("vec_id").astype(str)
    assert got.values.tolist() == want[got.columns].values.tolist()
