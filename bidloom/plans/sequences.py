"""Sequence logic, ordering, trees and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, relational as rel
from .base import Tables, micros, registrar

QUERIES, ORACLE_SQL, query = registrar()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return rel.latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0)
 SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def version_diff(t: Tables) -> DataFrame:
    old = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus")
    new = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return rel.full_diff(old, new, ["o_orderkey"], ["o_orderstatus"])


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0), b AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0)
 SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(o_orderstatus, o_orderpriority) AS v, CASE WHEN a.o_orderkey IS NULL THEN 'model' ELSE 'person' END AS origin, o_orderpriority AS suggestion FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def rebuild_merge(t: Tables) -> DataFrame:
    manual = t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return rel.merged(manual, t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("v")), ["o_orderkey"], "v")


@query("""WITH m AS (SELECT user_id, ts AS at, event_id AS page FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts AS at, event_id FROM events WHERE event_type = 'click')
 SELECT p.event_id, m.page FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.at >= m.at""")
def page_at_offset(t: Tables) -> DataFrame:
    e = t.events.select("user_id", micros("ts").alias("at"), "event_id", "event_type")
    marks = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("page"))
    return rel.as_of(e.where("event_type = 'click'").select("user_id", "at", "event_id"), marks, "user_id", "at", "page").select("event_id", "page")


@query("""WITH x AS (SELECT user_id, event_id, epoch_us(ts) AS mark, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events)
 SELECT user_id, event_id, sum(CASE WHEN mark - prior <= 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY mark, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM x""")
def edge_bands(t: Tables) -> DataFrame:
    return rel.gap_clusters(t.events.select("user_id", "event_id", micros("ts").alias("at")), ["user_id"], "at", 3_600_000_000).select("user_id", "event_id", "cluster")


@query("""SELECT user_id, event_id, sum(CASE WHEN event_type = 'signup' OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""")
def subdocument_segments(t: Tables) -> DataFrame:
    return rel.islands(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "signup").select("user_id", "event_id", "segment")


@query("SELECT o_orderkey, o_custkey::VARCHAR || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def unique_ids(t: Tables) -> DataFrame:
    return rel.unique_ids(t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("c")), [], "c", "o_orderkey").select("o_orderkey", F.col("unique").alias("name"))


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 6 AS batch FROM orders")
def batches_of_six(t: Tables) -> DataFrame:
    return rel.batches(t.orders, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "batch")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 51")
def keyset_page(t: Tables) -> DataFrame:
    return rel.page_after(t.orders.select(F.col("o_orderkey").alias("id")), 500, 50)


@query("SELECT l_orderkey, l_linenumber, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 99)::INT AS until FROM lineitem")
def span_to_next(t: Tables) -> DataFrame:
    return rel.next_or_end(t.lineitem.select("l_orderkey", "l_linenumber", F.lit(99).alias("end")), ["l_orderkey"], "l_linenumber", "end").select("l_orderkey", "l_linenumber", "until")


def _boxes(t: Tables, prefix: str, shift: int) -> DataFrame:
    k = F.col("p_partkey") * 7 + shift
    x, y = (k % 90).cast("double"), (k * 3 % 80).cast("double")
    p = prefix
    return t.part.select((F.col("p_partkey") % 500).alias("page"), F.col("p_partkey").alias({"b": "block", "g": "grid"}[p]), x.alias(f"{p}x0"), y.alias(f"{p}y0"), (x + 20 + F.col("p_size") % 9).alias(f"{p}x1"), (y + 15 + F.col("p_size") % 7).alias(f"{p}y1"))


@query("""WITH k AS (SELECT *, p_partkey * 7 AS a, p_partkey * 7 + 1 AS c FROM part), b AS (SELECT p_partkey % 500 AS page, p_partkey AS block, (a % 90)::DOUBLE AS x0, (a * 3 % 80)::DOUBLE AS y0, (a % 90 + 20 + p_size % 9)::DOUBLE AS x1, (a * 3 % 80 + 15 + p_size % 7)::DOUBLE AS y1 FROM k),
 g AS (SELECT p_partkey % 500 AS page, p_partkey AS grid, (c % 90)::DOUBLE AS x0, (c * 3 % 80)::DOUBLE AS y0, (c % 90 + 20 + p_size % 9)::DOUBLE AS x1, (c * 3 % 80 + 15 + p_size % 7)::DOUBLE AS y1 FROM k),
 j AS (SELECT page, block, grid, greatest(least(b.x1, g.x1) - greatest(b.x0, g.x0), 0) * greatest(least(b.y1, g.y1) - greatest(b.y0, g.y0), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS share FROM b JOIN g USING (page))
 SELECT page, block, grid, share FROM (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY share DESC, grid) AS n FROM j WHERE share >= 0.1) WHERE n = 1""")
def spatial_overlap_best(t: Tables) -> DataFrame:
    return rel.best_overlap(_boxes(t, "b", 0), _boxes(t, "g", 1), 0.1)


@query("""WITH i AS (SELECT l_orderkey AS block, l_linenumber AS item, l_quantity AS y FROM lineitem), r(row, lo, hi) AS (VALUES (0, 0, 10), (1, 10, 20), (2, 20, 40)), j AS (SELECT block, item, row FROM i LEFT JOIN r ON y >= lo AND y < hi)
 SELECT block, item, row FROM j ANTI JOIN (SELECT DISTINCT block FROM j WHERE row IS NULL) USING (block)""")
def cell_placement(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("item"), F.col("l_quantity").alias("y"))
    bands = items.select(F.col("block").alias("of")).distinct().select("of", F.inline(F.expr("array(named_struct('row', 0, 'lo', 0, 'hi', 10), named_struct('row', 1, 'lo', 10, 'hi', 20), named_struct('row', 2, 'lo', 20, 'hi', 40))")))
    return rel.cells(items, bands)


def nodes(t: Tables) -> DataFrame:
    """Regions, nations and suppliers as a tree with path ids."""
    r = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.lit("region").alias("kind"), F.col("r_name").alias("ident"))
    n = t.nation.select(F.concat(F.lit("R"), "n_regionkey", F.lit(":N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.lit("nation").alias("kind"), F.col("n_name").alias("ident"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    up = F.concat(F.lit("R"), "n_regionkey", F.lit(":N"), "n_nationkey")
    s = s.select(F.concat(up, F.lit(":S"), "s_suppkey").alias("id"), up.alias("parent"), F.col("s_suppkey").alias("ord"), F.lit("supplier").alias("kind"), F.col("s_name").alias("ident"))
    return r.unionByName(n).unionByName(s)


NODES = """nodes AS (SELECT 'R' || r_regionkey AS id, NULL AS parent, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT 'R' || n_regionkey || ':N' || n_nationkey, 'R' || n_regionkey, n_nationkey FROM nation
 UNION ALL SELECT 'R' || n_regionkey || ':N' || n_nationkey || ':S' || s_suppkey, 'R' || n_regionkey || ':N' || n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"WITH RECURSIVE {NODES}, w AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT w.root, n.id, depth + 1 FROM w JOIN nodes n ON n.parent = w.id) SELECT root, id, depth::INT AS depth FROM w")
def subtree(t: Tables) -> DataFrame:
    return graph.subtree(nodes(t), nodes(t).where("parent is null").select("id")).select("root", "id", "depth")


@query(f"WITH {NODES} SELECT a.id, b.id AS ancestor, (len(string_split(a.id, ':')) - len(string_split(b.id, ':')))::INT AS steps FROM nodes a JOIN nodes b ON a.id = b.id OR starts_with(a.id, b.id || ':')")
def ancestors(t: Tables) -> DataFrame:
    return graph.ancestor_table(nodes(t).select("id"))


@query(f"WITH {NODES}, s AS (SELECT id FROM nodes WHERE ord % 3 <> 0) SELECT id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE starts_with(a.id, b.id || ':'))")
def minimal_roots(t: Tables) -> DataFrame:
    return rel.minimal(nodes(t).where("ord % 3 <> 0").select("id"))


@query(f"WITH {NODES} SELECT DISTINCT a.id AS start, b.id FROM nodes a JOIN nodes b ON b.id = a.id OR b.id = a.parent OR b.parent = a.id OR b.parent = a.parent WHERE a.ord % 5 = 0")
def neighbourhood(t: Tables) -> DataFrame:
    n = nodes(t)
    return graph.neighbourhood(n, n.where("ord % 5 = 0").select("id"))


@query("SELECT n_regionkey::VARCHAR AS cite, 'R' || n_regionkey || ':N' || n_nationkey AS id, 'unique' AS outcome FROM nation WHERE n_nationkey IN (SELECT min(n_nationkey) FROM nation GROUP BY n_regionkey)")
def citation_chains(t: Tables) -> DataFrame:
    first = t.nation.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("n"))
    cites = first.select(F.col("n_regionkey").cast("string").alias("cite"), F.concat(F.lit("R"), "n_regionkey").alias("scope"), F.array(F.struct(F.lit("nation").alias("kind"), F.col("n").alias("ident"))).alias("path"))
    return graph.resolved(cites, nodes(t).select("id", "kind", "ident"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 1 THEN 1 WHEN p_size % 4 = 2 THEN 2 ELSE 4 END AS place FROM part")
def problems_first(t: Tables) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, ("disqualified", "needs_review", "pass", "unchecked"))), (F.col("p_size") % 4 + 1).cast("int"))
    return t.part.withColumn("s", s).select("p_partkey", rel.problems_first("s").alias("place"))
