"""Reports and blockers on stand-ins made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import NEUTRAL_KEYS
from ..operators import reports
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()


@query("""WITH o AS (SELECT n_regionkey AS project, n_name AS tenderer, CASE n_nationkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'disqualified' ELSE 'dormant' END AS s, n_nationkey AS k FROM nation),
 l AS (SELECT *, CASE s WHEN 'needs_review' THEN 1 WHEN 'dormant' THEN 2 WHEN 'disqualified' THEN 3 END AS p, tenderer || CASE s WHEN 'needs_review' THEN ' awaits a reviewer''s decision on ' WHEN 'dormant' THEN ' has items the Authority may request: ' ELSE ' is not considered further: ' END || CASE WHEN k % 3 = 0 THEN 'see the record' ELSE 'item (a) Fee, item (b)' END AS line FROM o),
 g AS (SELECT project, list(tenderer ORDER BY tenderer) FILTER (s = 'pass') AS passed, string_agg(line, '; ' ORDER BY p, tenderer) FILTER (s <> 'pass') AS rest FROM l GROUP BY project)
 SELECT project, 'Stage I: ' || concat_ws('; ', CASE WHEN len(passed) = 1 THEN passed[1] || ' passed Stage I' WHEN len(passed) > 1 THEN array_to_string(passed[:-2], ', ') || ' and ' || passed[-1] || ' passed Stage I' END, rest) || '.' AS conclusion FROM g""")
def stage_conclusions(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    status = F.element_at(F.array(*map(F.lit, ("pass", "needs_review", "disqualified", "dormant"))), (k % 4 + 1).cast("int"))
    item = lambda a, b, s: F.struct(F.lit(a).alias("letter"), F.lit(b).cast("string").alias("title"), s.alias("status"))
    items = F.when(k % 3 == 0, F.array(item("a", "Fee", F.lit("pass")))).otherwise(F.array(item("a", "Fee", status), item("b", None, status), item("c", "x", F.lit("other"))))
    return reports.stage_conclusion(t.nation.select(F.col("n_regionkey").alias("project"), F.col("n_name").alias("tenderer"), status.alias("status"), items.alias("items")), "Stage I")


@query("""WITH b AS (SELECT s_nationkey AS project, min(s_name) AS best FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY s_nationkey) SELECT DISTINCT s_nationkey AS project, CASE WHEN best IS NULL THEN 'No offer is recommended.' ELSE 'recommended acceptance of ' || best || '''s offer with ' ||
 CASE WHEN s_nationkey % 2 = 0 THEN 'a cost-effectiveness of HK$' || format('{:,.2f}', s_nationkey * 1000.5) ELSE 'a total estimated amount of HK$7.00' END || '.' END AS line FROM supplier LEFT JOIN b ON project = s_nationkey""")
def recommendations(t: Tables) -> DataFrame:
    s = t.supplier
    best = s.where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("n")).agg(F.min("s_name").alias("best"))
    rows = s.join(best, F.col("n") == F.col("s_nationkey"), "left").select(F.col("s_nationkey").alias("project"), F.col("s_name").alias("tenderer"), F.coalesce(F.col("s_name") == F.col("best"), F.lit(False)).alias("recommended"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") * 1000.5).alias("cost_effectiveness"), F.lit(7.0).alias("estimated"))
    return reports.recommendation(rows, "HK$")


@query("""SELECT o_orderkey AS run_id, o_orderstatus AS letter, '(' || o_orderstatus || ') ' || CASE o_orderstatus WHEN 'F' THEN 'Fee' WHEN 'O' THEN 'Offer' ELSE '' END || ' | ' || CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE '-' END || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN 'pass' ELSE 'needs_review' END || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE 'look' END
 || ' | ' || CASE WHEN o_orderkey % 3 = 0 THEN 'fee by r1; sign decided by -' ELSE '-' END AS line FROM orders""")
def evaluation_records(t: Tables) -> DataFrame:
    o, k = t.orders, F.col("o_orderkey")
    verdicts = o.select(k.alias("run_id"), F.col("o_orderstatus").alias("letter"), F.when(k % 2 == 0, "pass").otherwise("needs_review").alias("outcome"), F.when(k % 2 == 0, "").otherwise("look").alias("reasons"))
    items = t.spark.createDataFrame([("F", "Fee", "A"), ("O", "Offer", "B")], "letter string, title string, part string")
    made = F.array(F.struct(F.lit("s.sign_decision").alias("key"), F.lit(None).cast("string").alias("by")), F.struct(F.lit("s.fee").alias("key"), F.lit("r1").alias("by")))
    return reports.evaluation_record(verdicts, items, o.where("o_orderkey % 3 = 0").select(k.alias("run_id"), F.col("o_orderstatus").alias("letter"), F.inline(made)))


@query("""WITH i AS (SELECT p_partkey::VARCHAR AS letter, CASE p_size % 5 WHEN 0 THEN 'needs_input' WHEN 1 THEN 'gap' ELSE 'confirmed' END AS status, CASE p_size % 3 WHEN 0 THEN 't' WHEN 1 THEN 'gone' END AS template, p_size AS z FROM part)
 SELECT letter, 'item_status' AS kind, status AS what FROM i WHERE status <> 'confirmed' UNION ALL SELECT letter, 'unknown_template', 'gone' FROM i WHERE template = 'gone' UNION ALL SELECT letter, 'empty_required_slot', 'least' FROM i WHERE template = 't' AND z % 2 = 0
 UNION ALL SELECT letter, 'unknown_tier', 'r odd' FROM i WHERE template = 't' AND z % 7 = 0 UNION ALL SELECT letter, 'undeclared_slot', 'r most' FROM i WHERE template = 't' UNION ALL SELECT letter, 'undeclared_slot', CASE WHEN z % 2 = 0 THEN 'r least, most' ELSE 'r most' END FROM i WHERE template IS NULL
 UNION ALL SELECT NULL, 'gap_without_reason', s_name FROM supplier WHERE s_suppkey % 2 = 0""")
def draft_blockers(t: Tables) -> DataFrame:
    z, letter = F.col("p_size"), F.col("p_partkey").cast("string").alias("letter")
    status = F.when(z % 5 == 0, "needs_input").when(z % 5 == 1, "gap").otherwise("confirmed")
    template = F.when(z % 3 == 0, "t").when(z % 3 == 1, "gone")
    values = F.when(z % 2 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("least"), F.lit("5")))
    items = t.part.select(letter, status.alias("status"), template.alias("template"), values.alias("values"))
    rules = t.part.select(letter, F.lit("r").alias("rule_id"), F.when(z % 7 == 0, "odd").otherwise("critical").alias("tier"), F.lit(None).cast("string").alias("outcomes"), F.array(F.lit("most"), F.lit("least")).alias("refs"))
    templates = t.spark.createDataFrame([("t", ["critical"])], "template string, tiers array<string>")
    slots = t.spark.createDataFrame([("t", "least", True), ("t", "spare", False)], "template string, name string, required boolean")
    gaps = t.supplier.select(F.col("s_name").alias("node_id"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("seen").alias("reason"))
    return reports.confirm_blockers(items, templates, slots, rules, gaps)


@query("""SELECT p_partkey, p_name AS value, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_brand ELSE p_type END AS model_value, 'manual' AS origin, p_size % 3 = 1 AND p_brand = p_name AS verified, 'r1' AS "by",
 CASE p_size % 3 WHEN 0 THEN 'miss' WHEN 1 THEN 'within' ELSE 'hit' END AS pages, CASE WHEN p_size % 2 = 0 THEN 'odd' ELSE '' END AS unknown FROM part""")
def corrected_slots(t: Tables) -> DataFrame:
    z = F.col("p_size")
    slot = lambda value, model, origin: F.struct(value.alias("value"), model.alias("model_value"), F.lit(origin).alias("origin"), F.lit(True).alias("verified"), F.lit("r0").alias("by"))
    old = F.when(z % 3 == 1, slot(F.col("p_brand"), F.lit(None).cast("string"), "model")).when(z % 3 == 2, slot(F.lit("x"), F.col("p_type"), "manual"))
    pages = reports.page_sets(F.array(F.lit(1), F.lit(2)), F.when(z % 3 == 0, F.array(F.lit(9))).when(z % 3 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(2), F.lit(9))))
    unknown = reports.unknown_keys(F.when(z % 2 == 0, F.array(F.lit("odd"), F.lit("na"))).otherwise(F.array(F.lit("na"))), NEUTRAL_KEYS)
    return t.part.withColumn("old", old).select("p_partkey", reports.corrected_slot(F.col("old"), F.col("p_name"), F.lit("r1")).alias("s"), pages.alias("pages"), F.array_join(unknown, ",").alias("unknown")).select("p_partkey", "s.*", "pages", "unknown")
