"""Runs, pacing, budgets and scores on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evals, jobs
from .base import Tables, micros, registrar

QUERIES, ORACLE_SQL, query = registrar()


def calls(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("user_id").alias("key"), F.col("user_id").alias("project"), micros("ts").alias("t_us"), F.col("event_id").alias("ord"), F.col("ts").cast("date").alias("day"), F.col("value").cast("decimal(18,4)").alias("usd"),
        F.col("event_type").alias("entry"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 1000).alias("tokens"), F.col("event_type").alias("kind"), F.col("user_id").alias("scope"), (F.col("event_id") % 10).alias("prompt"),
    )


@query("""WITH w AS (SELECT user_id AS worker, max(ts) AS heartbeat FROM events WHERE event_type = 'view' GROUP BY user_id), j AS (SELECT event_id AS job_id, user_id + CASE WHEN event_id % 9 = 0 THEN 1000000 ELSE 0 END AS worker FROM events WHERE event_type = 'click')
 SELECT job_id, worker FROM j LEFT JOIN w USING (worker) WHERE heartbeat IS NULL OR heartbeat < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 30 SECOND""")
def stalled_jobs(t: Tables) -> DataFrame:
    w = t.events.where("event_type = 'view'").groupBy(F.col("user_id").alias("worker")).agg(F.max(F.col("ts").cast("timestamp")).alias("heartbeat"))
    j = t.events.where("event_type = 'click'").select(F.col("event_id").alias("job_id"), (F.col("user_id") + F.when(F.col("event_id") % 9 == 0, 1000000).otherwise(0)).alias("worker"))
    return jobs.stalled(j, w, F.lit("2024-01-29 00:00:00").cast("timestamp")).select("job_id", "worker")


@query("""WITH c AS (SELECT user_id AS key, event_id AS ord, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
 SELECT key, ord, (i * 60000000 + max(t - i * 60000000) OVER (PARTITION BY key ORDER BY t, ord ROWS UNBOUNDED PRECEDING))::BIGINT AS slot_us FROM c""")
def rate_limit_slots(t: Tables) -> DataFrame:
    return jobs.slots(calls(t), 60_000_000).select("key", "ord", "slot_us")


@query("SELECT key, max(n) AS peak FROM (SELECT user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 3599999999 FOLLOWING) AS n FROM events) GROUP BY key")
def peak_calls(t: Tables) -> DataFrame:
    return jobs.peak_in_window(calls(t), 3600)


@query("SELECT user_id AS project, ts::DATE AS day, count(*) AS calls, sum(value::DECIMAL(18,4))::DOUBLE AS usd FROM events GROUP BY ALL")
def budget_by_day(t: Tables) -> DataFrame:
    return jobs.budget(calls(t)).withColumn("usd", F.col("usd").cast("double"))


@query("SELECT coalesce(event_type, 'total') AS entry, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, sum(event_id % 1000)::BIGINT AS tokens FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(t: Tables) -> DataFrame:
    return jobs.usage(calls(t)).select(F.coalesce("entry", F.lit("total")).alias("entry"), "calls", "failed", "tokens")


@query("SELECT scope, sum(n - 1)::BIGINT AS repeated FROM (SELECT user_id AS scope, event_type, event_id % 10 AS p, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL HAVING count(*) > 1) GROUP BY scope")
def repeated_calls(t: Tables) -> DataFrame:
    return jobs.repeated(calls(t))


@query("""SELECT event_id, coalesce(sum(value::DECIMAL(18,4)) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 AS allowed FROM events""")
def budget_cap(t: Tables) -> DataFrame:
    return jobs.within_budget(calls(t), 100.0).select(F.col("ord").alias("event_id"), "allowed")


@query("SELECT coalesce(q::VARCHAR, 'all') AS marked, count(*) AS nodes, count(*) FILTER (hit) AS found FROM (SELECT quality AS q, toxic = 0 AS hit FROM labels) GROUP BY ROLLUP (q)")
def eval_recall(t: Tables) -> DataFrame:
    return evals.recall(t.labels.select(F.col("quality").alias("marked"), (F.col("toxic") == 0).alias("hit"))).withColumn("marked", F.coalesce(F.col("marked").cast("string"), F.lit("all")))


@query("SELECT scope, median, least FROM (SELECT user_id AS scope, list(value ORDER BY value) AS s FROM events GROUP BY user_id) x, LATERAL (SELECT s[len(s) // 2 + 1] AS median, s[1] AS least)")
def similarity_stats(t: Tables) -> DataFrame:
    return evals.similarity_stats(t.events.select(F.col("user_id").alias("scope"), F.col("value").alias("similarity"))).select("scope", "median", "least")


@query("SELECT event_type AS letter, count(*) FILTER (user_id % 3 > 0 AND user_id % 3 = event_id % 3) AS matched, count(*) FILTER (user_id % 3 > 0 AND event_id % 3 = 0) AS missed, count(*) FILTER (user_id % 3 > 0 AND event_id % 3 > 0 AND user_id % 3 <> event_id % 3) AS mismatched, count(*) FILTER (user_id % 3 = 0 AND event_id % 3 > 0) AS invented FROM events GROUP BY event_type")
def eval_bid(t: Tables) -> DataFrame:
    v = lambda c: F.when(F.col(c) % 3 > 0, F.col(c) % 3)
    return evals.bid_score(t.events.select(F.col("event_type").alias("letter"), v("user_id").alias("expected"), v("event_id").alias("read")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling(t: Tables) -> DataFrame:
    """Extension: hourly counts."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT ts - INTERVAL (epoch_us(ts) % 1800000000) MICROSECOND - INTERVAL (i * 30) MINUTE AS start, count(*) AS n FROM events, range(2) r(i) GROUP BY 1")
def ext_sliding(t: Tables) -> DataFrame:
    """Extension: hours that start every half hour."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes")
    return t.events.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query()
def ext_run_state(t: Tables) -> DataFrame:
    """Extension: the state machine over each user's events."""
    from ..streaming.runs import batch_transitions

    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "queued", "view": "running", "click": "paused", "purchase": "done", "error": "failed"}.items() for x in kv]), F.col("event_type"))
    return batch_transitions(t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), wanted.alias("wanted")))


@query("""SELECT e.event_id, CASE WHEN e.event_type = 'error' THEN 'failed' WHEN e.event_id % 3 = 0 THEN 'stalled' ELSE 'paused' END AS why FROM events e WHERE e.event_type = 'error' OR e.event_id % 3 = 0 OR e.event_type = 'view'""")
def stuck_reasons(t: Tables) -> DataFrame:
    e = t.events
    runs = e.select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "paused").otherwise("running").alias("state"))
    out = jobs.stuck_reasons(runs, e.where("event_id % 3 = 0").select(F.col("event_id").alias("job_id")), e.where("event_type = 'error'").select(F.col("event_id").alias("job_id")))
    return out.select(F.col("job_id").alias("event_id"), "why")


@query("SELECT event_id, least(120.0::DOUBLE, 2.0::DOUBLE * pow(2.0::DOUBLE, event_id % 9)) AS wait FROM events")
def retry_waits(t: Tables) -> DataFrame:
    from ..functions.dates import retry_wait

    return t.events.select("event_id", retry_wait(F.col("event_id") % 9).alias("wait"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages WHERE page_id % 2 = 0 OR regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) LIKE 'blog.%'")
def endpoint_policy(t: Tables) -> DataFrame:
    p = t.pages.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "synthetic").otherwise("redacted_sample").alias("data_class"))
    blogs = p.select(jobs.host_class(F.col("url")).alias("host")).where("host like 'blog.%'")
    return jobs.allowed_endpoints(p, blogs).select("page_id", jobs.host_class(F.col("url")).alias("host"))
