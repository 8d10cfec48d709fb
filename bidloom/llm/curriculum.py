"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, saved

WEIGHTS = (3.0, 1.0, 2.0)
#: Of all sizes, so much is taken; of one source at most so many times its size.
SHARE, REPEATS = 1.5, 2
#: Relative to its mean, a source's rate runs from 1 - TILT to 1 + TILT for even ranks and back for odd ones.
TILT = 0.5
#: Rows of one source that are summed in order in one task, about.
BLOCK_ROWS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the words of the whole text; null texts have none. Columns row_key and mix_key are kept."""
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    return docs.select("doc_id", "source", n.alias("size"), *_key(docs))


def _key(df: DataFrame) -> list[str]:
    return [c for c in ("row_key", "mix_key") if c in df.columns]


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, rank, source_size, target: one row per source.

    Sources by code point, null last, have the weights in turn. A target stops at `repeats` times its source's
    size, and the excess is shared again by weight. In order of capacity per weight, the capped sources are a
    head of the list, so one running sum finds where it ends: no rounds. Windows without a key see one row per
    source. Sources without words have target 0.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns(
        {
            "total": share * F.sum("source_size").over(every),
            "weights": F.sum("weight").over(every),
            "full": F.coalesce(F.sum("cap").over(fill), F.lit(0)),
            "used": F.coalesce(F.sum("weight").over(fill), F.lit(0.0)),
        }
    )
    # The level if all sources before this one are capped; the first whose capacity lies above its share isn't, nor are those after it.
    by = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "rank")))
    by = by.withColumn("level", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("used")))
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    by = by.withColumn("first", F.min(open_).over(every))
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return by.select("source", "rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def starts(sized: DataFrame) -> DataFrame:
    """Adds start: the words of the same source before each document, in the order of md5(doc_id).

    Two levels: blocks of a source by leading digits of the hash, summed with map-side combine and accumulated
    over their short table; then a running sum within each block. A source of any size is dealt over many tasks.
    """
    rows = sized.count()
    digits = 0
    while 16**digits * BLOCK_ROWS < rows and digits < 8:
        digits += 1
    df = sized.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("block", F.substring("hash", 1, digits))
    sums = df.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "block").orderBy("hash", "doc_id", "size", *_key(sized)).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    s = sums.select(F.col("source").alias("its"), F.col("block").alias("bl"), "before")
    return df.join(s, F.col("source").eqNullSafe(F.col("its")) & (F.col("block") == F.col("bl"))).withColumn("start", F.col("before") + F.col("within")).select("doc_id", "source", "size", "hash", "start", *_key(sized))


def allotted(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, tilt: float = TILT) -> DataFrame:
    """doc_id, source, size, source_size, target, takes, hash: one row per row of docs, in no order.

    The words of a source, in hash order and again for each repeat, are one stream, and the mix takes its first
    floor(target) words; a document at the end of the stream is taken in part. takes: for each repeat with words
    the repeat, its words and its position in [0, 1). A source's rate at time t is linear, target * (1 - s + 2 s t)
    with s = tilt for even ranks, which start slow, and -tilt for odd ones; its integral is the demand up to t,
    and inverting it at the words of the stream before a document gives the document's position.

    Null texts count as empty and take nothing; repeated rows are rows of their own; a null source is a source.
    Columns row_key and mix_key of docs are kept.
    """
    sized = saved(sizes(docs), "sizes")
    t = targets(sized, weights, share, repeats).withColumnRenamed("source", "its")
    df = saved(starts(sized), "starts").join(t, F.col("source").eqNullSafe(F.col("its")))
    s = F.when(F.col("rank") % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))

    def take(j: Column) -> Column:
        at = F.col("start") + j * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.floor("target") - at, F.lit(0))).cast("long")
        x = F.try_divide(at.cast("double"), F.col("target"))
        # Demand (1 - s) t + s t^2 = x, solved for t.
        position = (F.sqrt(F.greatest((1 - s) * (1 - s) + 4 * s * x, F.lit(0.0))) - (1 - s)) / (2 * s) if tilt else x
        return F.struct(j.cast("int").alias("repeat"), words.alias("words"), position.alias("position"))

    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), take), lambda c: c["words"] > 0)
    return df.select("doc_id", "source", "size", "source_size", "target", takes.alias("takes"), "hash", *_key(df))


def scheduled(mix: DataFrame) -> DataFrame:
    """One row per document and repeat, range-sorted by position: the order of training."""
    return mix.select("*", F.explode("takes").alias("take")).select("doc_id", "source", "size", "hash", "take.*", *_key(mix)).orderBy("position", "hash", "repeat", *_key(mix))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, tilt: float = TILT) -> DataFrame:
    """doc_id, source, size, source_size, target, takes, taken, hash: one row per row of docs, in the order of training.

    The takes that `allotted` finds are range-sorted by position and written: that is the mix. Each has its place in the
    sorted files, so takes of all sources and repeats are in one order; a document's takes are read from there, first repeat
    first. Rows come by the place of their first take, those that the mix leaves out behind all others.
    A column row_key of docs is kept.
    """
    plan = saved(allotted(docs.withColumn("mix_key", F.monotonically_increasing_id()), weights, share, repeats, tilt), "allotted")
    mix = with_place(saved(scheduled(plan), "mix"))
    take = F.struct("repeat", "words", "position", "place")
    of = mix.groupBy(F.col("mix_key").alias("its")).agg(F.sort_array(F.collect_list(take)).alias("takes"), F.sum("words").alias("taken"))
    df = plan.drop("takes").join(of, F.col("mix_key") == F.col("its"), "left")
    df = df.withColumns({"takes": F.coalesce("takes", F.array().cast(of.schema["takes"].dataType)), "taken": F.coalesce("taken", F.lit(0).cast("long"))})
    df = df.orderBy(F.get("takes.place", F.lit(0)).asc_nulls_last(), "hash", "mix_key")
    return df.select("doc_id", "source", "size", "source_size", "target", "takes", "taken", "hash", *_key(docs.drop("mix_key")))


def remixed(docs: DataFrame) -> DataFrame:
    """docs in training order, a row for each time the mix takes a document; other columns as they came.

    docs: doc_id, text, source. Ids may be null or shared: a row's key is saved with it before the mix is made, so each
    meets its own takes only. The one document per source that is taken in part keeps the words that are taken.
    n_chars, where there is one, is counted anew. The takes, four numbers a row, are broadcast only
    if they are measured small; else texts are shuffled once to meet them and once to be sorted.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = saved(docs.select(row, F.monotonically_increasing_id().alias("row_key")), "keyed")
    takes = allotted(keyed.select("row.doc_id", "row.source", "row.text", "row_key"))
    takes = takes.select("row_key", "size", F.inline("takes"))
    takes = saved(takes.select(F.col("row_key").alias("its"), "repeat", F.when(F.col("words") < F.col("size"), F.col("words")).alias("words"), "position"), "takes")
    df = keyed.join(hinted(takes), F.col("row_key") == F.col("its"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, 1, F.col("words").cast("int")), "")
    df = df.withColumn("text", F.when(F.col("words").isNotNull(), head).otherwise(F.col("row.text"))).orderBy("position", "row_key", "repeat")
    out = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return df.select(*out)


def with_place(docs: DataFrame) -> DataFrame | None:
    """docs as a written mix is read again, with place: whole numbers in training order, from the sorted files' numbers and
    the places of rows in them. None where docs aren't read from files."""
    try:
        meta = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None
    part = F.regexp_extract("_file", r"part-([0-9]+)", 1)
    return meta.withColumn("place", F.coalesce(part.try_cast("long"), F.lit(0)) * (1 << 40) + F.col("_row")).drop("_file", "_row")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
b AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST(rank % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2 * source_size AS cap FROM b),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
      coalesce(sum(cap) OVER q, 0)::DOUBLE AS full_, coalesce(sum(weight) OVER q, 0)::DOUBLE AS used FROM w
      WINDOW q AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_) / (weights - used) AS level, row_number() OVER (ORDER BY cap / weight, rank) AS place FROM f),
k AS (SELECT min(place) AS k, arg_min(level, place) AS level FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CASE WHEN rank % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS s, coalesce(CASE WHEN k.k IS NULL OR place < k.k THEN cap::DOUBLE ELSE k.level * weight END, 0) AS target FROM l, k),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT doc_id, size, CASE WHEN least(size, floor(target) - start) > 0 THEN (sqrt((1 - s) * (1 - s) + 4 * s * (start::DOUBLE / target)) - (1 - s)) / (2 * s) END AS position, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(least(size, greatest(floor(target) - start, 0)) + least(size, greatest(floor(target) - start - source_size, 0)) AS BIGINT) AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
"""
