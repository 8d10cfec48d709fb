"""Sharding by bytes: groups of equal texts stay whole, and Karmarkar-Karp differencing balances them."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, saved

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Groups that are differenced one by one, the largest; the others are dealt into bundles first.
HEADS, BUNDLES = 16_384, 16_384
#: Classes of size for each doubling, by which the largest groups are told apart.
CLASSES = 32


def differenced(sizes: list[int], ways: int = SHARDS) -> list[int]:
    """The shard of each size.

    Each size starts as a partial partition of its own, with all shards but one empty. The two partial partitions with the
    largest spread (most less least) are combined again and again, the fullest shard of one with the emptiest of the
    other, until one is left; shards are then followed back through the combinations. Ties: what was there first.
    """
    if not sizes:
        return []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    loads: dict[int, list[int]] = {n: [sizes[i]] + [0] * (ways - 1) for n, i in enumerate(order)}
    heap = [(-(x[0] - x[-1]), n) for n, x in loads.items()]
    heapq.heapify(heap)
    combined: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = [x + y for x, y in zip(loads.pop(a), reversed(loads.pop(b)), strict=True)]
        by = sorted(range(ways), key=both.__getitem__, reverse=True)
        n = len(sizes) + len(combined)
        loads[n] = [both[j] for j in by]
        combined.append((a, b, by))
        heapq.heappush(heap, (loads[n][-1] - loads[n][0], n))
    shard = {heap[0][1]: list(range(ways))}
    for n in range(len(sizes) + len(combined) - 1, len(sizes) - 1, -1):
        a, b, by = combined[n - len(sizes)]
        own, left, right = shard.pop(n), [0] * ways, [0] * ways
        for to, j in zip(own, by, strict=True):
            left[j] = right[ways - 1 - j] = to
        shard[a], shard[b] = left, right
    found = [0] * len(sizes)
    for n, i in enumerate(order):
        found[i] = shard[n][0]
    return found


def _group(text: Column) -> Column:
    """Equal for equal texts; null counts as empty. Unequal texts that share it are merely kept together."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _class(size: Column) -> Column:
    return F.floor(F.log2(size) * CLASSES).cast("int")


def planned(groups: DataFrame, shards: int = SHARDS, heads: int = HEADS, bundles: int = BUNDLES) -> tuple[DataFrame, DataFrame]:
    """(heads: g, shard; bundles: b, shard) for groups of g, bytes (saved).

    The largest groups, at most `heads` of them by classes of size counted exactly, are items of their own; each other
    group belongs to the bundle pmod(g, bundles), an item as well. The driver differences at most heads + bundles sums,
    however many groups there are; a shard's share is hundreds of bundles, so smaller groups level what larger ones leave.
    """
    spark = groups.sparkSession
    per = sorted(((r["c"], r["n"]) for r in groups.groupBy(_class(F.col("bytes")).alias("c")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, many = None, 0
    for c, n in per:
        many += n
        if many > heads:
            break
        least = c
    large = _class(F.col("bytes")) >= F.lit(least) if least is not None else F.lit(False)
    head = groups.where(large).select("g", "bytes").orderBy(F.desc("bytes"), "g").collect()
    bundle = groups.where(~large).groupBy(F.pmod("g", F.lit(bundles)).cast("int").alias("b")).agg(F.sum("bytes").alias("bytes")).orderBy("b").collect()
    to = differenced([*(r["bytes"] for r in head), *(r["bytes"] for r in bundle)], shards)
    of = lambda key, kind, rows, ks: spark.createDataFrame([(r[key], k) for r, k in zip(rows, ks, strict=True)], f"{key} {kind}, shard int")
    return of("g", "long", head, to[: len(head)]), of("b", "int", bundle, to[len(head) :])


def placed(rows: DataFrame, plan: tuple[DataFrame, DataFrame], bundles: int = BUNDLES) -> DataFrame:
    """rows (with g) and their shard: two lookups in tables of at most HEADS and BUNDLES rows, so nothing is shuffled."""
    heads, rest = plan
    df = rows.withColumn("b", F.pmod("g", F.lit(bundles)).cast("int"))
    df = df.join(F.broadcast(heads.withColumnRenamed("shard", "own")), "g", "left").join(F.broadcast(rest), "b", "left")
    return df.withColumn("shard", F.coalesce("own", "shard")).drop("own", "b")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, g, key (of the row: its place in the reading task's rows) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    return docs.select(F.col("doc_id").cast("long"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _group(F.col("text")).alias("g"), F.monotonically_increasing_id().alias("key"))


def sharded(docs: DataFrame, shards: int = SHARDS, heads: int = HEADS, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per row of docs.

    Texts are read once, for their length and hashes. Groups of equal texts are indivisible, so a group of more than a
    shard's share (a 24th of all bytes) fills a shard by itself and sets the largest size; nothing is gathered for it, since
    groups are sums and rows look their shard up. Slots count a shard's rows from 0 without gaps, in the order of the
    tasks that read them and of rows within those; each (shard, task) is numbered by itself and shifted by the counts of
    the tasks before.

    Null texts count as empty and share a group with empty ones; null and shared ids are rows like others; further columns
    are left out; an empty table gives no rows.
    """
    rows = saved(measured(docs), "sized")
    groups = saved(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    df = placed(rows, planned(groups, shards, heads, bundles), bundles).withColumn("task", F.shiftright("key", 33))
    per = df.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per = saved(per.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "slots")
    own = F.row_number().over(Window.partitionBy("shard", "task").orderBy("key")) - 1
    return df.withColumn("own", own).join(hinted(per), ["shard", "task"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).alias("slot"))


def written(docs: DataFrame, folder: str, shards: int = SHARDS) -> str:
    """docs with all columns, written as one folder of Parquet per shard; the name of the shard's column: "shard", with an
    underscore for as long as docs have such a column. Rows of a shard are dealt over many tasks."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    groups = saved(measured(docs).groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _group(F.col("text")).alias("g"))
    df = placed(rows, planned(groups, shards))
    df.select("row.*", F.col("shard").alias(name)).hint("rebalance", name).write.partitionBy(name).parquet(folder)
    return name
