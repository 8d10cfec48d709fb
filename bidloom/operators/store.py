"""Versions, corrections, re-decision and audit over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_number
from ..functions.vocab import META_SUFFIXES
from .relational import latest


def with_corrections(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields as the rules should see them. fields: run_id, field_id, value, printed, verified; corrections: run_id, key,
    value, and optionally by and reason.

    A person's value replaces the read one, also where nothing was read; the verification falls away, and so does what was
    printed, unless the value is a bare number. A correction of `<field>_decision` is a reviewer's decision on the field,
    with who made it and why; other meta keys (`<field>_page`) correct no value and mark nothing.
    """
    have = lambda c: F.col(c) if c in corrections.columns else F.lit(None).cast("string")
    meta = F.regexp_extract("key", "_(" + "|".join(META_SUFFIXES) + ")$", 1)
    c = corrections.select("run_id", F.regexp_replace("key", "_(" + "|".join(META_SUFFIXES) + ")$", "").alias("field_id"), meta.alias("meta"), "value", have("by").alias("by"), have("reason").alias("reason"))
    own, decision = F.col("meta") == "", F.col("meta") == "decision"
    c = c.where(own | decision).groupBy("run_id", "field_id").agg(
        F.max(own).alias("_c"), F.max(F.when(own, F.col("value"))).alias("_new"), F.max(F.when(decision, F.struct("value", "by", "reason"))).alias("_d")
    )
    done = F.coalesce("_c", F.lit(False))
    out = fields.join(c, ["run_id", "field_id"], "full_outer")
    return out.withColumns(
        {
            "model_value": F.when(done, F.col("value")),
            "value": F.when(done, F.col("_new")).otherwise(F.col("value")),
            "printed": F.when(done & ~F.coalesce(bare_number("_new"), F.lit(False)), F.lit(None).cast("string")).otherwise(F.col("printed")),
            "verified": F.when(~done, F.col("verified")),
            "corrected": done,
            "decision": F.col("_d.value"),
            "decided_by": F.col("_d.by"),
            "decided_why": F.col("_d.reason"),
        }
    ).drop("_new", "_c", "_d")


def redecided(old: DataFrame, new: DataFrame, keep_confirmed: bool = False) -> DataFrame:
    """run_id, verdict, changed, confirmed: a changed verdict loses its confirmation, unless it is kept; the version alone is no change."""
    o = old.select("run_id", F.col("verdict").alias("was"), "confirmed")
    j = new.select("run_id", "verdict").join(o, "run_id", "left")
    changed = ~F.col("verdict").eqNullSafe(F.col("was"))
    return j.select("run_id", "verdict", changed.alias("changed"), (F.coalesce("confirmed", F.lit(False)) & (F.lit(keep_confirmed) | ~changed)).alias("confirmed"))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table after an upsert: per key the row of the highest version; rows win ties."""
    both = table.withColumn("_n", F.lit(0)).unionByName(rows.withColumn("_n", F.lit(1)))
    return latest(both, keys, F.desc(version), F.desc("_n")).drop("_n")


def versions(rulesets: DataFrame) -> DataFrame:
    """Per project the latest version, the latest confirmed one, and whether a draft is ahead."""
    return rulesets.groupBy("project").agg(F.max("version").alias("latest"), F.max(F.when(F.col("status") == "confirmed", F.col("version"))).alias("confirmed")).withColumn("draft_ahead", F.col("latest") > F.coalesce("confirmed", F.lit(0)))


def audit(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events with new rows appended in order of time and subject; ids go on from the last. at: a timestamp.

    Two levels: new rows are counted by hour, the short table of hours is summed, and each hour counts on from there.
    """
    last = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = rows.withColumn("_hour", F.date_trunc("hour", "at"))
    sums = new.groupBy("_hour").agg(F.count("*").alias("_n"))
    sums = sums.select("_hour", F.coalesce(F.sum("_n").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_hour").orderBy("at", "subject"))
    new = new.withColumn("_own", own).join(sums.withColumnRenamed("_hour", "_of"), F.col("_hour").eqNullSafe(F.col("_of")))
    new = new.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_before") + F.col("_own"))
    return events.unionByName(new.drop("_hour", "_of", "_own", "_before", "_last"))


def first_per_part(parts: DataFrame) -> DataFrame:
    """One row per part: the first title, and its clauses united in order of first sight. parts: part, ord, title, clause."""
    firsts = parts.groupBy("part", "clause").agg(F.min("ord").alias("ord"))
    clauses = firsts.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "clause"))), lambda x: x["clause"]).alias("clauses"))
    return parts.groupBy("part").agg(F.min_by("title", "ord").alias("title")).join(clauses, "part")
