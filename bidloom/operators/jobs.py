"""Runs, heartbeats, pacing, budgets and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stalled(jobs: DataFrame, workers: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """Jobs under way without a worker, or whose worker's heartbeat is older than so many seconds."""
    j = jobs.join(workers, "worker", "left")
    return j.where(F.col("heartbeat").isNull() | (F.unix_micros(F.col("heartbeat")) < F.unix_micros(now) - seconds * 1_000_000))


def stuck_reasons(runs: DataFrame, stalled_ids: DataFrame, failed_ids: DataFrame) -> DataFrame:
    """Runs with why they don't go on: failed before stalled before paused."""
    j = runs.join(stalled_ids.select("job_id", F.lit(True).alias("_s")), "job_id", "left").join(failed_ids.select("job_id", F.lit(True).alias("_f")), "job_id", "left")
    why = F.when(F.col("_f"), "failed").when(F.col("_s"), "stalled").when(F.col("state") == "paused", "paused")
    return j.withColumn("why", why).where("why is not null").drop("_s", "_f")


def slots(calls: DataFrame, gap_us: int) -> DataFrame:
    """Adds slot_us: a call starts when it comes or one gap after the one before. calls: key, t_us, ord.

    slot_i = i * gap + max over j <= i of (t_j - j * gap): one running maximum per key instead of a loop.
    """
    w = Window.partitionBy("key").orderBy("t_us", "ord")
    df = calls.withColumn("_i", (F.row_number().over(w) - 1).cast("long"))
    return df.withColumn("slot_us", F.col("_i") * gap_us + F.max(F.col("t_us") - F.col("_i") * gap_us).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i")


def peak_in_window(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """Per key the most calls in any [t, t + seconds)."""
    n = F.count("*").over(Window.partitionBy("key").orderBy("t_us").rangeBetween(0, seconds * 1_000_000 - 1))
    return calls.withColumn("n", n).groupBy("key").agg(F.max("n").alias("peak"))


def budget(calls: DataFrame) -> DataFrame:
    return calls.groupBy("project", "day").agg(F.count("*").alias("calls"), F.sum("usd").alias("usd"))


def within_budget(calls: DataFrame, cap: float) -> DataFrame:
    """Adds allowed: the sum before a call is below the cap, so the last one may overshoot."""
    before = F.sum("usd").over(Window.partitionBy("project", "day").orderBy("t_us", "ord").rowsBetween(Window.unboundedPreceding, -1))
    return calls.withColumn("allowed", F.coalesce(before, F.lit(0.0)) < cap)


def usage(calls: DataFrame) -> DataFrame:
    """Per entry and in total: calls, failed, tokens, dollars."""
    return calls.rollup("entry").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failed"), F.sum("tokens").alias("tokens"), F.round(F.sum("usd"), 6).alias("usd"))


def repeated(calls: DataFrame) -> DataFrame:
    """Calls made again with the same scope, kind and prompt, errors aside."""
    return calls.where("not failed").groupBy("scope", "kind", "prompt").agg(F.count("*").alias("n")).where("n > 1").groupBy("scope").agg(F.sum(F.col("n") - 1).alias("repeated"))


def cached_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Each distinct key is answered once; all who asked get the answer, null where there is none."""
    return asked.join(answers.dropDuplicates(["key"]), "key", "left")


def resumable(paused: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Paused runs whose project has a confirmed rule set."""
    return paused.join(rulesets.where("status = 'confirmed'").select("project").distinct(), "project", "left_semi")


def host_class(url: Column) -> Column:
    """local for loopback and private hosts, else the host."""
    host = F.parse_url(url, F.lit("HOST"))
    return F.when(host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"), "local").otherwise(host)


def allowed_endpoints(calls: DataFrame, cleared: DataFrame) -> DataFrame:
    """Calls whose data class may go to their endpoint: synthetic anywhere, confidential only locally, samples to cleared hosts too."""
    hosts = cleared.select(F.col("host").alias("_host"), F.lit(True).alias("_ok")).distinct()
    j = calls.withColumn("_at", host_class(F.col("url"))).join(hosts, F.col("_at") == F.col("_host"), "left")
    fine = (F.col("data_class") == "synthetic") | (F.col("_at") == "local") | ((F.col("data_class") == "redacted_sample") & F.col("_ok"))
    return j.where(fine).drop("_at", "_host", "_ok")
