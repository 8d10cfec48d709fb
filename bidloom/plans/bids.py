"""Offers, prices, rules and verdicts on stand-ins made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import pricing, reviews, rules, store
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()


def offers(t: Tables) -> DataFrame:
    """Suppliers as tenderers, regions as projects, their lines as prices."""
    total = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("p"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"))
    df = total.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    sign = F.element_at(F.array(*map(F.lit, ("HK$ 1", "US$ 2", "EUR 3", "$ 4", ""))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return df.select(
        F.col("n_regionkey").alias("project"), F.col("s_name").alias("tenderer"), (F.col("p") / F.col("q")).alias("unit_price"), (1000.0 + F.col("n_regionkey")).alias("quantity"),
        ((F.col("s_suppkey") % 997 * 10 + 3) / 1000.0).alias("dosage"), (F.col("s_suppkey") % 3 != 0).alias("conforming"), sign.alias("printed"), F.col("s_suppkey").alias("k"), F.lit("HKD").alias("base"),
    )


OFFERS = """offers AS (SELECT n_regionkey AS project, s_name AS tenderer, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS unit_price,
  (1000.0::DOUBLE + n_regionkey) AS quantity, (s_suppkey % 997 * 10 + 3) / 1000.0::DOUBLE AS dosage, s_suppkey % 3 <> 0 AS conforming, s_suppkey AS k, n_nationkey % 5 AS cur,
  CASE n_nationkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 7.8 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 END::DOUBLE AS rate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


def rated(t: Tables) -> DataFrame:
    rates = t.spark.createDataFrame([("USD", 7.8)], "code string, to_base double")
    return pricing.converted(offers(t).withColumn("reading", pricing.read_currency(F.col("printed"))), rates)


@query(f"""WITH {OFFERS}, m AS (SELECT *, round(unit_price * rate, 4) AS b FROM offers), r AS (SELECT *, round(printf('%.1e', dosage)::DOUBLE * b, 2) AS metric FROM m),
 k AS (SELECT *, CASE WHEN metric IS NOT NULL THEN row_number() OVER (PARTITION BY project, metric IS NULL ORDER BY metric, tenderer) END AS rank FROM r),
 f AS (SELECT project, arg_min(tenderer, rank) AS best FROM k WHERE conforming AND rank IS NOT NULL GROUP BY project)
 SELECT k.project, tenderer, b AS unit_price_base, metric, rank::INT AS rank, coalesce(tenderer = best, false) AS recommended FROM k LEFT JOIN f USING (project)""")
def price_summary_ce(t: Tables) -> DataFrame:
    return pricing.price_rows(rated(t)).select("project", "tenderer", "unit_price_base", "metric", "rank", "recommended")


@query(f"""WITH {OFFERS}, m AS (SELECT *, round(round(unit_price * rate, 4) * quantity, 2) AS metric, round(round(unit_price, 4) * quantity, 2) + k % 2 AS quoted FROM offers)
 SELECT project, tenderer, metric, abs(quoted - round(round(unit_price, 4) * quantity, 2)) <= 0.5 AS arithmetic_ok,
 (CASE WHEN metric IS NOT NULL THEN row_number() OVER (PARTITION BY project, metric IS NULL ORDER BY metric, tenderer) END)::INT AS rank FROM m""")
def price_summary_qty(t: Tables) -> DataFrame:
    df = rated(t).withColumn("quoted_total", F.round(F.round("unit_price", 4) * F.col("quantity"), 2) + F.col("k") % 2)
    return pricing.price_rows(df, "quantity").select("project", "tenderer", "metric", "arithmetic_ok", "rank")


@query(f"""WITH {OFFERS} SELECT project, tenderer, CASE cur WHEN 0 THEN 'HKD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'HKD' END AS code, rate,
 CASE cur WHEN 0 THEN '' WHEN 1 THEN 'converted from USD' WHEN 2 THEN 'no exchange rate from EUR to HKD' ELSE 'taken as HKD' END AS note FROM offers""")
def currency_convert(t: Tables) -> DataFrame:
    return rated(t).select("project", "tenderer", "code", "rate", "note")


@query(f"""WITH {OFFERS}, c AS (SELECT project, CASE cur WHEN 0 THEN 'HKD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'HKD' END AS code FROM offers)
 SELECT project, CASE WHEN count(DISTINCT code) = 1 AND count(*) = count(code) THEN max(code) END AS settled FROM c GROUP BY project""")
def settle_currency(t: Tables) -> DataFrame:
    return pricing.settled_currency(rated(t))


@query("SELECT p_partkey, printf('%.2e', p_retailprice + 0.001)::DOUBLE AS rounded FROM part")
def sig_figs_half_up(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", numbers.significant(F.col("p_retailprice") + 0.001, 3).alias("rounded"))


def fields(t: Tables) -> DataFrame:
    """Orders as runs with four fields each, of which the total has no row in every thirteenth."""
    o = t.orders
    value = lambda f, v, red=F.lit(False): F.struct(F.lit(f).alias("field_id"), v.cast("string").alias("value"), red.alias("redacted"))
    rows = F.array(
        value("form.priority", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "N/A").otherwise(F.col("o_orderpriority"))),
        value("form.status", F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.col("o_orderstatus")), F.col("o_orderkey") % 11 == 0),
        value("form.total", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice").cast("decimal(18,2)"))),
        value("form.date", F.date_format("o_orderdate", "yyyy-MM-dd")),
    )
    rows = F.filter(rows, lambda r: r["value"].isNotNull())
    return o.select(F.col("o_orderkey").alias("run_id"), F.inline(rows)).withColumns({"printed": F.lit(None).cast("string"), "corrected": F.lit(False), "verified": F.col("run_id") % 17 != 0})


FIELDS = """fields AS (SELECT o_orderkey AS run_id, 'form.priority' AS field_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'N/A' ELSE o_orderpriority END AS value, false AS redacted FROM orders
 UNION ALL SELECT o_orderkey, 'form.status', CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderstatus END, o_orderkey % 11 = 0 FROM orders
 UNION ALL SELECT o_orderkey, 'form.total', o_totalprice::DECIMAL(18,2)::VARCHAR, false FROM orders WHERE o_orderkey % 13 <> 0
 UNION ALL SELECT o_orderkey, 'form.date', strftime(o_orderdate, '%Y-%m-%d'), false FROM orders),
 states AS (SELECT *, CASE WHEN redacted THEN 'redacted' WHEN value IS NULL OR trim(value) = '' THEN 'blank' WHEN lower(trim(value)) IN ('n/a', 'na') THEN 'not_applicable' ELSE 'filled' END AS state FROM fields)"""

RULES = """SELECT rule_id, field_id, check, tier, stage, parent, letter, row_ord, cast(null as map<string,struct<status:string,note:string>>) AS outcomes, params, true AS evaluable FROM VALUES
 ('priority_given','form.priority','filled','critical','I',null,'a',1,map('x','')), ('status_given','form.status','filled','mandatory','I','priority_given','a',2,map('x','')),
 ('total_in_range','form.total','range','critical','II','status_given','b',1,map('min','1000','max','300000')), ('total_given','form.total','filled','critical','I',null,'b',2,map('x','')),
 ('date_bounds','form.date','date','mandatory','II','total_given','c',1,map('after','1 January 1993','before','1997-12-31'))
 AS r(rule_id,field_id,check,tier,stage,parent,letter,row_ord,params)"""
TIERS = """SELECT * FROM VALUES ('critical', map('blank', named_struct('status','disqualified','note','{field} is blank'), 'filled', named_struct('status','pass','note',cast(null as string)), 'redacted', named_struct('status','needs_review','note',cast(null as string)))),
 ('mandatory', map('blank', named_struct('status','dormant','note','{field} on request'), 'filled', named_struct('status','pass','note',cast(null as string)), 'not_applicable', named_struct('status','pass','note',cast(null as string)))) AS t(tier,outcomes)"""


def outcome_rows(t: Tables) -> DataFrame:
    return rules.evaluated(fields(t), rule_table(t))


def rule_table(t: Tables) -> DataFrame:
    return rules.resolved_outcomes(t.spark.sql(RULES), t.spark.sql(TIERS))


ROWS = FIELDS + r""", r(rule_id, field_id, kind, tier, stage, parent, letter, row_ord) AS (VALUES ('priority_given','form.priority','filled','critical','I',NULL,'a',1), ('status_given','form.status','filled','mandatory','I','priority_given','a',2),
 ('total_in_range','form.total','range','critical','II','status_given','b',1), ('total_given','form.total','filled','critical','I',NULL,'b',2), ('date_bounds','form.date','date','mandatory','II','total_given','c',1)),
 j AS (SELECT o_orderkey AS run_id, r.*, coalesce(s.state, 'blank') AS state, s.value, split_part(r.field_id, '.', 2) AS label, CASE WHEN s.value IS NULL THEN NULL WHEN kind = 'range' THEN CASE WHEN s.value::DOUBLE BETWEEN 1000 AND 300000 THEN 'match' ELSE 'mismatch' END
   WHEN kind = 'date' THEN CASE WHEN s.value::DATE BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' THEN 'match' ELSE 'mismatch' END END AS result FROM orders CROSS JOIN r LEFT JOIN states s ON s.run_id = o_orderkey AND s.field_id = r.field_id),
 rows_ AS MATERIALIZED (SELECT run_id, rule_id, field_id, stage, letter, row_ord, CASE WHEN result = 'match' THEN 'pass' WHEN result IS NOT NULL THEN 'needs_review'
   WHEN state = 'filled' THEN 'pass' WHEN state = 'blank' THEN CASE tier WHEN 'critical' THEN 'disqualified' ELSE 'dormant' END
   WHEN state = 'not_applicable' AND tier = 'mandatory' THEN 'pass' ELSE 'needs_review' END AS status,
   CASE WHEN kind = 'range' AND result IS NOT NULL THEN label || ': read ''' || value || ''', allowed 1000 to 300000'
   WHEN result IS NOT NULL THEN label || ': ' || value || CASE WHEN result = 'match' THEN '' WHEN value < '1993-01-01' THEN ' is before 1993-01-01' ELSE ' is after 1997-12-31' END
   WHEN state = 'filled' THEN NULL WHEN state = 'blank' THEN label || CASE tier WHEN 'critical' THEN ' is blank' ELSE ' on request' END
   WHEN state = 'redacted' AND tier = 'critical' THEN NULL WHEN state = 'not_applicable' AND tier = 'mandatory' THEN NULL
   ELSE label || ' reads ''' || value || ''', an answer this rule has no outcome for; a reviewer decides' END AS note FROM j)"""
VISIBLE = ROWS + """, anc(rule_id, ancestor) AS (VALUES ('status_given','priority_given'), ('total_in_range','status_given'), ('total_in_range','priority_given'), ('date_bounds','total_given')),
 wide AS (SELECT run_id, list(rule_id) FILTER (status NOT IN ('disqualified','dormant')) AS open_ FROM rows_ GROUP BY run_id), above AS (SELECT rule_id, list(ancestor) AS above FROM anc GROUP BY rule_id),
 vis AS MATERIALIZED (SELECT x.* FROM rows_ x JOIN wide USING (run_id) LEFT JOIN above USING (rule_id) WHERE above IS NULL OR list_has_all(coalesce(open_, []), above))"""
_SEV = "CASE status WHEN 'pass' THEN 0 WHEN 'dormant' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END"


def visible_rows(t: Tables) -> DataFrame:
    return rules.visible(outcome_rows(t), t.spark.sql(RULES))


@query(f"WITH {FIELDS} SELECT field_id, count(*) FILTER (state = 'blank') AS n_blank, count(*) FILTER (state = 'filled') AS n_filled, count(*) FILTER (state = 'not_applicable') AS n_na, count(*) FILTER (state = 'redacted') AS n_redacted FROM states GROUP BY field_id")
def presence_classes(t: Tables) -> DataFrame:
    s = rules.presence(F.col("value"), F.col("redacted"))
    return fields(t).withColumn("s", s).groupBy("field_id").agg(*[F.count_if(F.col("s") == k).alias(n) for k, n in (("blank", "n_blank"), ("filled", "n_filled"), ("not_applicable", "n_na"), ("redacted", "n_redacted"))])


@query(f"WITH {ROWS} SELECT run_id, rule_id, status, note, stage FROM rows_")
def outcome_choice(t: Tables) -> DataFrame:
    return outcome_rows(t).select("run_id", "rule_id", "status", "note", "stage")


@query(f"WITH {VISIBLE} SELECT run_id, rule_id, status FROM vis")
def dependency_visibility(t: Tables) -> DataFrame:
    return visible_rows(t).select("run_id", "rule_id", "status")


@query(f"""WITH {VISIBLE} SELECT run_id, letter, coalesce(arg_max(status, {_SEV}) FILTER (status <> 'dormant'), 'dormant') AS outcome, arg_max(status, {_SEV}) AS worst,
 count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'dormant') AS n_dormant, count(*) FILTER (status = 'needs_review') AS n_needs_review, count(*) FILTER (status = 'disqualified') AS n_disqualified,
 coalesce(string_agg(note, '; ' ORDER BY row_ord) FILTER (status <> 'pass'), '') AS reasons FROM vis GROUP BY run_id, letter""")
def item_verdicts(t: Tables) -> DataFrame:
    return rules.item_verdicts(visible_rows(t))


STAGES = VISIBLE + f""", items AS (SELECT run_id, stage, letter, coalesce(arg_max(status, {_SEV}) FILTER (status <> 'dormant'), 'dormant') AS status FROM vis GROUP BY ALL),
 st AS (SELECT run_id, stage, coalesce(arg_max(status, {_SEV}) FILTER (status <> 'dormant'), 'dormant') AS outcome, count(*) AS items, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'dormant') AS n_dormant,
 count(*) FILTER (status = 'needs_review') AS n_needs_review, count(*) FILTER (status = 'disqualified') AS n_disqualified FROM items GROUP BY ALL)"""


@query(f"WITH {STAGES} SELECT * FROM st")
def stage_summary(t: Tables) -> DataFrame:
    return rules.stage_summary(visible_rows(t))


@query(f"WITH {STAGES} SELECT run_id, max(outcome) FILTER (stage = 'I') AS verdict, max(outcome) FILTER (stage = 'II') AS stage2 FROM st GROUP BY run_id")
def tender_verdicts(t: Tables) -> DataFrame:
    return rules.tender_verdicts(rules.stage_summary(visible_rows(t)))


RULE_SETS = """SELECT ruleset, rule_id, field_id, check, tier, 'I' AS stage, parent, letter, 1 AS row_ord, cast(null as map<string,struct<status:string,note:string>>) AS outcomes, params, true AS evaluable FROM VALUES
 ('p1:1','total','form.total','range','critical','status','b',map('min','1000','max','150000')), ('p1:1','status','form.status','filled','mandatory',null,'a',map('x','')),
 ('p1:2','total','form.total','range','critical',null,'b',map('min','{least}','max','300000')), ('p1:2','status','form.status','filled','critical','total','a',map('x','')),
 ('p2:1','total','form.total','filled','mandatory',null,'b',map('x',''))
 AS r(ruleset,rule_id,field_id,check,tier,parent,letter,params)"""


@query(f"""WITH {FIELDS}, r AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'p1:1' WHEN 1 THEN 'p1:2' ELSE 'p2:1' END AS ruleset FROM orders),
 s AS (SELECT r.*, t.state IS NOT NULL AS there, t.value::DOUBLE AS total, x.state FROM r LEFT JOIN states t ON t.run_id = r.run_id AND t.field_id = 'form.total' JOIN states x ON x.run_id = r.run_id AND x.field_id = 'form.status'),
 v AS (SELECT *, CASE state WHEN 'filled' THEN 'pass' WHEN 'blank' THEN CASE ruleset WHEN 'p1:1' THEN 'dormant' ELSE 'disqualified' END ELSE 'needs_review' END AS status,
  CASE ruleset WHEN 'p1:1' THEN CASE WHEN NOT there THEN 'disqualified' WHEN total BETWEEN 1000 AND 150000 THEN 'pass' ELSE 'needs_review' END
   WHEN 'p1:2' THEN CASE WHEN NOT there THEN 'disqualified' WHEN total BETWEEN 50000 AND 300000 THEN 'pass' ELSE 'needs_review' END ELSE CASE WHEN there THEN 'pass' ELSE 'dormant' END END AS of_total FROM s)
 SELECT run_id, ruleset, 'status' AS rule_id, status FROM v WHERE ruleset = 'p1:1' OR ruleset = 'p1:2' AND of_total <> 'disqualified'
 UNION ALL SELECT run_id, ruleset, 'total', of_total FROM v WHERE ruleset <> 'p1:1' OR status <> 'dormant'""")
def verdicts_by_ruleset(t: Tables) -> DataFrame:
    """Runs of two projects, one with two versions of its rules: each is held against its own, in one call."""
    table = t.spark.createDataFrame([("p1", 1, "p1:1"), ("p1", 2, "p1:2"), ("p2", 1, "p2:1"), ("p3", 1, "p3:1")], "project string, version int, ruleset string")
    k = F.col("o_orderkey") % 3
    results = t.orders.select(F.col("o_orderkey").alias("run_id"), F.when(k == 2, "p2").otherwise("p1").alias("project"), F.when(k == 1, 2).otherwise(1).alias("version"))
    slots = t.spark.createDataFrame([("p1:2", "b", "least", "50,000"), ("p1:1", "b", "least", "9")], "ruleset string, letter string, name string, value string")
    own = t.spark.sql(RULE_SETS)
    rows = rules.evaluated(fields(t), rules.resolved_outcomes(own, t.spark.sql(TIERS)), slots, reviews.with_ruleset(results, table))
    return rules.visible(rows, own).select("run_id", "ruleset", "rule_id", "status")


KINDS = """SELECT rule_id, field_id, check, 'critical' AS tier, 'I' AS stage, cast(null as string) AS parent, 'a' AS letter, row_ord, cast(null as map<string,struct<status:string,note:string>>) AS outcomes, params, true AS evaluable FROM VALUES
 ('is_open','s.status','value',1,map('expected','O')), ('bounds','s.total','range',2,map('min','{least}','max','')), ('urgency','s.priority','unit',3,map('allowed','HIGH|URGENT')),
 ('no_medium','s.priority','contains',4,map('phrases','medium','absent','yes')), ('ordered','s.date','date',5,map('before','1st January 1996')), ('sum_right','s.total','math',6,map('inputs','half|half','op','sum')),
 ('copies_agree','s.priority','cross_document_match',7,map('other','copy.priority')), ('judgement','s.total','human_only',8,map('x','')), ('given','s.total','filled',9,map('x','')) AS r(rule_id,field_id,check,row_ord,params)"""


@query("""WITH f AS (SELECT o_orderkey AS run_id, o_orderstatus AS s, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS t, o_orderpriority AS p, o_orderdate::DATE AS d,
  CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice::DECIMAL(18,2)::DOUBLE / 2 + (o_orderkey % 2) * 9999, 2) END AS h, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END END AS c FROM orders),
 r AS (SELECT run_id, 'is_open' AS rule_id, CASE WHEN s = 'O' THEN 'match' ELSE 'mismatch' END AS res, t FROM f
  UNION ALL SELECT run_id, 'bounds', CASE WHEN t IS NULL THEN 'blank' WHEN t >= 20000 THEN 'match' ELSE 'mismatch' END, t FROM f UNION ALL SELECT run_id, 'urgency', CASE WHEN p LIKE '%HIGH' OR p LIKE '%URGENT' THEN 'match' ELSE 'mismatch' END, t FROM f
  UNION ALL SELECT run_id, 'no_medium', CASE WHEN p LIKE '%MEDIUM' THEN 'mismatch' ELSE 'match' END, t FROM f UNION ALL SELECT run_id, 'ordered', CASE WHEN d > DATE '1996-01-01' THEN 'mismatch' ELSE 'match' END, t FROM f
  UNION ALL SELECT run_id, 'sum_right', CASE WHEN t IS NULL THEN 'blank' WHEN h IS NULL THEN 'unstated' WHEN abs(t::DOUBLE - (h + h)) <= greatest(0.01, 0.005 * abs(h + h)) THEN 'match' ELSE 'mismatch' END, t FROM f
  UNION ALL SELECT run_id, 'copies_agree', CASE WHEN c IS NULL THEN 'unstated' WHEN c = p THEN 'match' ELSE 'mismatch' END, t FROM f UNION ALL SELECT run_id, 'judgement', CASE WHEN t IS NULL THEN 'blank' ELSE 'unstated' END, t FROM f
  UNION ALL SELECT run_id, 'given', CASE WHEN t IS NULL THEN 'blank' ELSE 'match' END, t FROM f)
 SELECT run_id, rule_id, CASE res WHEN 'match' THEN 'pass' WHEN 'blank' THEN 'disqualified' ELSE 'needs_review' END AS status FROM r""")
def rules_of_all_kinds(t: Tables) -> DataFrame:
    """All eight comparison kinds and a presence rule over fields some of which have no row; slots and inputs are wired."""
    o = t.orders
    k, total = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    one = lambda f, v: F.struct(F.lit(f).alias("field_id"), v.cast("string").alias("value"))
    half = F.round(total.cast("double") / 2 + (k % 2) * 9999, 2)
    rows = F.array(
        one("s.status", F.col("o_orderstatus")), one("s.total", F.when(k % 13 != 0, total)), one("s.priority", F.col("o_orderpriority")), one("s.date", F.date_format("o_orderdate", "d MMMM yyyy")),
        one("s.half", F.when(k % 3 != 0, half.cast("decimal(18,2)"))), one("copy.priority", F.when(k % 5 != 0, F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("none"))),
    )
    made = o.select(k.alias("run_id"), F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))
    slots = t.spark.createDataFrame([("a", "least", "20,000")], "letter string, name string, value string")
    found = rules.evaluated(made, rules.resolved_outcomes(t.spark.sql(KINDS), t.spark.sql(TIERS)), slots)
    return found.select("run_id", "rule_id", "status")


@query(f"""WITH {VISIBLE}, x AS (SELECT v.*, v.run_id % 17 <> 0 AS verified, f.run_id IS NOT NULL AS read FROM vis v LEFT JOIN fields f USING (run_id, field_id)),
 a AS (SELECT *, CASE WHEN read AND NOT verified AND status IN ('pass','disqualified') THEN 'needs_review' ELSE status END AS s1, CASE WHEN read AND NOT verified AND status IN ('pass','disqualified') THEN 'unverified: the two readings differ' ELSE note END AS n1 FROM x),
 b AS (SELECT *, CASE WHEN NOT read THEN 'needs_review' ELSE s1 END AS s2, CASE WHEN NOT read THEN 'unextracted: no form reads ' || split_part(field_id, '.', 2) || '; a reviewer decides' ELSE n1 END AS n2 FROM a),
 c AS (SELECT *, s2 = 'needs_review' AND field_id = 'form.status' AND run_id % 5 = 0 AS d FROM b)
 SELECT run_id, rule_id, CASE WHEN d THEN 'dormant' ELSE s2 END AS status, CASE WHEN d THEN 'decided by r7: later' ELSE n2 END AS note FROM c""")
def verdicts_after_engine(t: Tables) -> DataFrame:
    """Unverified values, unread fields and reviewers' decisions, after the rules."""
    late = (F.col("field_id") == "form.status") & (F.col("run_id") % 5 == 0)
    f = fields(t).withColumns({"decision": F.when(late, "dormant"), "decided_by": F.lit("r7"), "decided_why": F.lit("later")})
    rows = rules.visible(rules.evaluated(f, rule_table(t)), t.spark.sql(RULES))
    return rules.after_engine(rows).select("run_id", "rule_id", "status", "note")


def _compared(kind: str, value, params: dict, **more) -> F.Column:
    p = F.create_map(*[F.lit(x).cast("string") if not isinstance(x, F.Column) else x.cast("string") for kv in params.items() for x in kv])
    none = F.lit(None).cast("string")
    return rules.compare(kind, value, none, F.lit(False), p, **more)


@query("SELECT o_orderkey, CASE WHEN o_totalprice::DECIMAL(18,2) BETWEEN 5000 AND 150000 THEN 'match' ELSE 'mismatch' END AS result FROM orders")
def check_range(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", _compared("range", F.col("o_totalprice").cast("decimal(18,2)").cast("string"), {"min": 5000, "max": 150000}).alias("result"))


@query("SELECT p_partkey, CASE WHEN abs(p_size - 25) <= 0.125 THEN 'match' ELSE 'mismatch' END AS result FROM part")
def check_value(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", _compared("value", F.col("p_size").cast("string"), {"expected": "25"}).alias("result"))


@query("""SELECT p_partkey, CASE WHEN ' ' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || ' ' SIMILAR TO '.* (steel|brass) .*' THEN 'match' ELSE 'mismatch' END AS unit,
 CASE WHEN ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' LIKE '% part %' THEN 'match' ELSE 'mismatch' END AS phrase FROM part""")
def check_unit_contains(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", _compared("unit", F.col("p_type"), {"allowed": "steel|brass"}).alias("unit"), _compared("contains", F.col("p_name"), {"phrase": "part"}).alias("phrase"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate::DATE BETWEEN DATE '1994-06-01' AND DATE '1996-03-31' THEN 'match' ELSE 'mismatch' END AS result FROM orders")
def check_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", _compared("date", F.date_format("o_orderdate", "d MMMM yyyy"), {"after": "1st June 1994", "before": "1996-03-31"}).alias("result"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_extendedprice::DECIMAL(18,2)::DOUBLE - l_quantity::DECIMAL(18,2)::DOUBLE * 1500) <= greatest(0.01, 0.005 * abs(l_quantity::DECIMAL(18,2)::DOUBLE * 1500)) THEN 'match' ELSE 'mismatch' END AS result FROM lineitem""")
def check_math(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    return t.lineitem.select("l_orderkey", "l_linenumber", _compared("math", F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), {"op": "product"}, first=q, second=F.lit("1500")).alias("result"))


@query("""SELECT o_orderkey, (SELECT d FROM (SELECT o_orderdate::DATE + CAST(i AS INT) AS d FROM range(1, 15) x(i)) WHERE isodow(d) < 6 ORDER BY d LIMIT 1 OFFSET 4) AS due, o_orderdate::DATE + 10 AS calendar,
 (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE AS months FROM orders""")
def deadlines(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", dates.add_working_days(d, 5).alias("due"), dates.add_calendar_days(d, 10).alias("calendar"), F.add_months(d, -3).alias("months"))


def corrections(t: Tables) -> DataFrame:
    """Every fifth run's total, also where none was read, and decisions on the status of every tenth."""
    value = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("form.total").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, "1234.50").otherwise("none stated").alias("value"))
    decision = t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("form.status_decision").alias("key"), F.lit("pass").alias("value"))
    page = t.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("form.date_page").alias("key"), F.lit("3").alias("value"))
    return value.unionByName(decision).unionByName(page).withColumns({"by": F.lit("r1"), "reason": F.lit("seen")})


@query(f"""WITH {FIELDS}, c AS (SELECT o_orderkey AS run_id, 'form.total' AS field_id, CASE WHEN o_orderkey % 2 = 0 THEN '1234.50' ELSE 'none stated' END AS new FROM orders WHERE o_orderkey % 5 = 0)
 SELECT run_id, field_id, CASE WHEN new IS NOT NULL THEN new ELSE value END AS value, CASE WHEN new IS NOT NULL THEN value END AS model_value, CASE WHEN new IS NULL THEN run_id % 17 <> 0 END AS verified, new IS NOT NULL AS corrected,
 CASE WHEN field_id = 'form.status' AND run_id % 10 = 0 THEN 'pass' END AS decision, CASE WHEN field_id = 'form.status' AND run_id % 10 = 0 THEN 'r1' END AS decided_by FROM fields FULL JOIN c USING (run_id, field_id)""")
def corrections_applied(t: Tables) -> DataFrame:
    return store.with_corrections(fields(t), corrections(t)).select("run_id", "field_id", "value", "model_value", "verified", "corrected", "decision", "decided_by")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_totalprice > 100000 THEN 'pass' ELSE 'needs_review' END AS verdict, (o_totalprice > 100000) <> (o_totalprice > 120000) AS changed,
 o_orderkey % 2 = 0 AND (o_totalprice > 100000) = (o_totalprice > 120000) AS confirmed FROM orders""")
def redecide_changed(t: Tables) -> DataFrame:
    v = lambda x: F.when(F.col("o_totalprice") > x, "pass").otherwise("needs_review").alias("verdict")
    old = t.orders.select(F.col("o_orderkey").alias("run_id"), v(120000), (F.col("o_orderkey") % 2 == 0).alias("confirmed"))
    return store.redecided(old, t.orders.select(F.col("o_orderkey").alias("run_id"), v(100000)))


@query("""SELECT o_custkey AS project, max(o_orderkey) AS latest, max(o_orderkey) FILTER (o_orderstatus = 'F') AS confirmed, max(o_orderkey) > coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), 0) AS draft_ahead FROM orders GROUP BY o_custkey""")
def draft_vs_confirmed(t: Tables) -> DataFrame:
    return store.versions(t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("draft").alias("status")))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'off' ELSE 'on' END AS state FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, 'off' FROM part WHERE p_size % 3 = 0")
def switched_off_rules(t: Tables) -> DataFrame:
    made = t.part.select(F.col("p_partkey").alias("rule_id"), F.create_map(F.lit("expected"), F.when(F.col("p_size") % 3 == 0, "{optional_empty}").otherwise("{required_set}")).alias("params"))
    slots = t.spark.createDataFrame([("optional_empty", False, ""), ("required_set", True, "5")], "name string, required boolean, value string")
    off = rules.switched_off(made, slots).select("rule_id")
    on = rules.excluded(made, off)
    return off.select(F.col("rule_id").alias("p_partkey"), F.lit("off").alias("state")).unionByName(on.select(F.col("rule_id").alias("p_partkey"), F.lit("on").alias("state")))


@query("""SELECT o_orderkey, CASE WHEN s = 'needs_review' AND o_orderkey % 5 = 0 THEN 'dormant' ELSE s END AS status FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND b IN ('pass','disqualified') THEN 'needs_review' ELSE b END AS s
 FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'disqualified' ELSE 'needs_review' END AS b FROM orders))""")
def overrides_and_decisions(t: Tables) -> DataFrame:
    no, yes = F.lit(False), F.lit(True)
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "disqualified").otherwise("needs_review")
    out = rules.overridden(status, F.col("o_orderkey") % 3 != 0, yes, yes, no, F.when(F.col("o_orderkey") % 5 == 0, "dormant"), no, no, no, no, no)
    return t.orders.select("o_orderkey", out.alias("status"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS normal, substr(sha1(p_name), 1, 12) AS path_id, regexp_extract(p_brand, '[0-9]+')::DOUBLE AS number FROM part")
def text_functions(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.normalise(F.concat("p_name", F.lit(" / "), "p_type")).alias("normal"), text.path_id("p_name").alias("path_id"), text.number("p_brand").alias("number"))
