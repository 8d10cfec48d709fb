"""Shards against the laws they keep and against a plain differencing of whole groups."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb

from bidloom.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"


def plain(sizes: list[int], ways: int) -> int:
    """The spread that differencing reaches: lists of sums, searched anew for the two of largest spread in each step."""
    left = [(n, [s] + [0] * (ways - 1)) for n, s in enumerate(sorted(sizes, reverse=True))]
    while len(left) > 1:
        left.sort(key=lambda x: (-(max(x[1]) - min(x[1])), x[0]))
        (_, a), (_, b), *rest = left
        left = [*rest, (len(sizes) * 2 - len(left), sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b))), reverse=True))]
    return max(left[0][1]) - min(left[0][1])


def greedy(sizes: list[int], ways: int) -> int:
    loads = [0] * ways
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return max(loads) - min(loads)


def spread(sizes: list[int], to: list[int], ways: int) -> int:
    loads = [0] * ways
    for s, k in zip(sizes, to):
        loads[k] += s
    assert sum(loads) == sum(sizes)
    return max(loads) - min(loads)


def test_differencing():
    rng = random.Random(2)
    assert sharding.differenced([], 3) == []
    assert spread([8, 7, 6, 5, 4], sharding.differenced([8, 7, 6, 5, 4], 2), 2) == 2
    better = 0
    for _ in range(40):
        ways, sizes = rng.randrange(2, 7), [int(rng.paretovariate(1.2) * 50) for _ in range(rng.randrange(1, 120))]
        own = spread(sizes, sharding.differenced(sizes, ways), ways)
        assert own == plain(sizes, ways)
        better += own <= greedy(sizes, ways)
    assert better >= 36


def held(rows, ways: int = 24):
    """The laws: equal texts together, slots gapless; the bytes of each shard."""
    slots, loads, groups = defaultdict(list), Counter({k: 0 for k in range(ways)}), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        groups[r["size"], r["text_crc32"]].add(r["shard"])
    assert set(slots) <= set(range(ways)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in groups.values())
    return loads


def test_shards_of_documents(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    got = queries.op11_karmarkar_karp_shards(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for i, t in docs)
    loads, groups = held(got), Counter()
    for _, t in docs:
        groups[t or ""] += len((t or "").encode()) + 8
    assert max(loads.values()) - min(loads.values()) == plain(list(groups.values()), 24)


def test_bundles_level_what_large_groups_leave(spark):
    rng = random.Random(6)
    rows = [(i, "x" * int(rng.paretovariate(1.1) * 30) + str(i)) for i in range(3000)] + [(-i, "copy" * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    loads = held(sharding.sharded(df, 6, heads=100, bundles=500).collect(), 6)
    assert max(loads.values()) - min(loads.values()) <= 8
    one = spark.createDataFrame([(i, f"{i:04}") for i in range(600)], "doc_id long, text string")
    loads = held(sharding.sharded(one, 6, heads=10, bundles=200).collect(), 6)
    assert max(loads.values()) - min(loads.values()) <= 2 * 12


def test_awkward_shards(spark, tmp_path):
    big = [(1, "a third of all rows")] * 50
    rows = [*big, (None, None), (None, ""), (2, "ä" * 5000), (3, "b"), (3, "b")]
    df = spark.createDataFrame([(*r, 1, "g", 2) for r in rows], "doc_id long, text string, shard int, g string, size int")
    got = sharding.sharded(df).collect()
    held(got)
    assert sorted(r["size"] for r in got if r["doc_id"] is None) == [8, 8] and max(r["size"] for r in got) == 10_008
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert sharding.sharded(df.limit(0)).count() == 0
    name = sharding.written(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and set(back.columns) == {*df.columns, name} and back.count() == len(rows)
    assert back.groupBy("text").agg({name: "min"}).count() == len({r[1] for r in rows})
