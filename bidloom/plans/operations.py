"""Operations named by rules over order lines, and the outcomes that their buckets choose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import operations, rules
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()

RULES = (
    ("product", "total", "arithmetic_product", {"inputs": "unit|quantity"}),
    ("least", "quantity", "min_value_check", {"min": "10"}),
    ("range", "quantity", "value_in_range", {"min_kg": "5", "max": "40"}),
    ("same", "flag", "text_match", {"inputs": "flag|status", "condition": "odd"}),
    ("both", "quantity", "threshold_checks", {"checks": "min:10|max:4"}),
    ("due", "quantity", "add_calendar_days", {"offset": "30"}),
    ("lower", "quantity", "resolve_range_to_lower_bound", {}),
)
OUTCOMES = {"compliant": "pass", "noncompliant": "disqualified", "not_applicable": "dormant"}


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_linenumber % 2 = 1 AS odd, l_returnflag AS a, l_linestatus AS b, l_shipdate::DATE AS d, l_orderkey % 3 = 0 AS broken FROM lineitem),
 r AS (SELECT l_orderkey, l_linenumber, 'product' AS rule_id, CASE WHEN broken THEN 'negative' ELSE 'positive' END AS bucket FROM l UNION ALL SELECT l_orderkey, l_linenumber, 'least', CASE WHEN q >= 10 THEN 'positive' ELSE 'negative' END FROM l
 UNION ALL SELECT l_orderkey, l_linenumber, 'range', CASE WHEN q BETWEEN 5 AND 40 THEN 'positive' ELSE 'negative' END FROM l UNION ALL SELECT l_orderkey, l_linenumber, 'same', CASE WHEN NOT odd THEN 'neutral' WHEN a = b THEN 'positive' ELSE 'negative' END FROM l
 UNION ALL SELECT l_orderkey, l_linenumber, 'both', CASE WHEN q >= 10 AND l_linenumber <= 4 THEN 'positive' ELSE 'negative' END FROM l UNION ALL SELECT l_orderkey, l_linenumber, 'due', CASE WHEN d <= DATE '1995-06-30' THEN 'positive' ELSE 'negative' END FROM l
 UNION ALL SELECT l_orderkey, l_linenumber, 'lower', NULL FROM l)
 SELECT *, CASE bucket WHEN 'positive' THEN 'compliant' WHEN 'negative' THEN 'noncompliant' WHEN 'neutral' THEN 'not_applicable' END AS outcome FROM r""")
def rule_operations(t: Tables) -> DataFrame:
    """Seven operations on each order line, and the declared outcome that each bucket chooses."""
    q, text = F.col("l_quantity"), lambda c: c.cast("string")
    field = {
        "quantity": text(q), "quantity_max": text(q + 5), "unit": F.lit("2.5"), "total": text(F.round(q * 2.5, 2) + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)), "flag": F.col("l_returnflag"), "status": F.col("l_linestatus"),
        "odd": F.when(F.col("l_linenumber") % 2 == 1, "yes").otherwise("false"), "both__values": F.concat(text(q), F.lit("|"), text(F.col("l_linenumber"))), "due__base_date": F.lit("1995-05-31"), "due__actual_date": F.date_format("l_shipdate", "yyyy-MM-dd"),
    }
    items = t.lineitem.select("l_orderkey", "l_linenumber", F.create_map(*[x for k, v in field.items() for x in (F.lit(k), v)]).alias("f"))
    table = t.spark.createDataFrame(list(RULES), "rule_id string, field_id string, operation string, params map<string,string>")
    declared = F.create_map(*[x for k, v in OUTCOMES.items() for x in (F.lit(k), F.struct(F.lit(v).alias("status"), F.lit(None).cast("string").alias("note")))])
    out = operations.operated(items, table)
    return out.select("l_orderkey", "l_linenumber", "rule_id", "bucket", rules.outcome_key(declared, F.lit("filled"), F.col("bucket")).alias("outcome"))
