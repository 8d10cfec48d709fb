"""Gates, routing, merges, scores and marks on stand-ins made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import reviews
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()


@query("""SELECT o_orderkey AS run_id, o_custkey % 100 AS project, o_orderkey % 5 AS version, (o_custkey % 100) % 3 = 0 AS confirmed FROM orders WHERE o_orderkey % 5 < 4 AND (o_custkey % 100) % 7 <> 0""")
def results_with_ruleset(t: Tables) -> DataFrame:
    results = t.orders.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 100).alias("project"), (F.col("o_orderkey") % 5).alias("version"))
    sets = t.spark.range(100).where("id % 7 <> 0").select(F.col("id").alias("project"), (F.col("id") % 3 == 0).alias("confirmed"), F.explode(F.expr("sequence(0L, 3L)")).alias("version"))
    return reviews.with_ruleset(results, sets).select("run_id", "project", "version", "confirmed")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'own ' || p_size WHEN p_size % 2 = 0 THEN 'library ' || p_size END AS body FROM part")
def template_fallback(t: Tables) -> DataFrame:
    sizes = t.part.select(F.col("p_size").alias("template")).distinct()
    own = sizes.where("template % 3 = 0").select("template", F.concat(F.lit("own "), F.col("template").cast("string")).alias("body"))
    library = sizes.where("template % 2 = 0").select("template", F.concat(F.lit("library "), F.col("template").cast("string")).alias("body"))
    return reviews.with_template(t.part.select("p_partkey", F.col("p_size").alias("template")), own, library).select("p_partkey", "body")


@query("SELECT o_orderkey AS page, CASE WHEN o_orderkey % 4 = 0 OR o_orderstatus = 'P' THEN 'other' ELSE o_orderstatus END AS label FROM orders")
def page_labels(t: Tables) -> DataFrame:
    pages = t.orders.select(F.col("o_orderkey").alias("page"))
    labels = t.orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("label"))
    return reviews.labelled_pages(pages, labels, t.spark.createDataFrame([("F",), ("O",)], "label string"))


@query("SELECT o_orderkey AS page, CASE o_orderstatus WHEN 'F' THEN 'form F' WHEN 'O' THEN 'form O' ELSE 'reader' END AS goes_to FROM orders")
def routed_pages(t: Tables) -> DataFrame:
    pages = t.orders.select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("label"))
    known, ask = reviews.routed(pages, t.spark.createDataFrame([("F", "form F"), ("O", "form O")], "label string, form string"))
    return known.select("page", F.col("form").alias("goes_to")).unionByName(ask.select("page", F.lit("reader").alias("goes_to")))


@query("SELECT n_regionkey AS project, s_suppkey AS tenderer FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT (s_suppkey % 3 = n_regionkey % 3)")
def missing_offers(t: Tables) -> DataFrame:
    offers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("project"), F.col("s_suppkey").alias("tenderer"))
    version = t.region.select(F.col("r_regionkey").alias("project"), (F.col("r_regionkey") % 3).alias("version"))
    return reviews.missing_offers(offers, offers.withColumn("version", F.col("tenderer") % 3), version)


@query("""WITH runs AS (SELECT DISTINCT o_custkey AS run_id FROM orders), f(form) AS (VALUES ('F'), ('O'), ('X')) SELECT run_id, form FROM runs CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = run_id AND o_orderstatus = form)""")
def forms_without_pages(t: Tables) -> DataFrame:
    items = t.spark.createDataFrame([("A", "F"), ("A", "O"), ("A", "X"), ("B", "P")], "part string, form string")
    return reviews.forms_without_pages(items, t.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("form"))).select("run_id", "form")


@query("""WITH n AS (SELECT s_suppkey AS id, -1 - s_nationkey AS parent FROM supplier UNION ALL SELECT -1 - n_nationkey, NULL FROM nation), c AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 = 0), v AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0)
 SELECT n.id, n.parent FROM n WHERE parent IN (SELECT parent FROM n JOIN c USING (id)) AND id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT id FROM v)""")
def uncovered_nodes(t: Tables) -> DataFrame:
    leaves = t.supplier.select(F.col("s_suppkey").cast("long").alias("id"), (-1 - F.col("s_nationkey")).cast("long").alias("parent"))
    nodes = leaves.unionByName(t.nation.select((-1 - F.col("n_nationkey")).cast("long").alias("id"), F.lit(None).cast("long").alias("parent")))
    return reviews.uncovered(nodes, leaves.where("id % 10 = 0").select("id"), leaves.where("id % 3 = 0").select("id"))


@query("""WITH x AS (SELECT o_orderkey AS run_id, o_orderstatus AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'ZZ' ELSE o_orderstatus END AS b, (o_orderkey % 10) / 10.0::DOUBLE AS c1, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 4) / 5.0::DOUBLE END AS c2 FROM orders)
 SELECT run_id, coalesce(a = b, false) AS verified, round(CASE WHEN a = b THEN (c1 + c2) / 2 ELSE least(c1, c2) / 2 END, 2) AS confidence, CASE WHEN a = b THEN 'a second, independent read agrees' ELSE 'the two readings differ' END AS note FROM x""")
def second_readings(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    first = t.orders.select(k.alias("run_id"), F.lit("status").alias("name"), F.col("o_orderstatus").alias("value"), F.lit(None).cast("string").alias("printed"), ((k % 10) / 10.0).alias("confidence"))
    second = t.orders.where("o_orderkey % 5 <> 0").select(k.alias("run_id"), F.lit("status").alias("name"), F.when(k % 3 == 0, "ZZ").otherwise(F.col("o_orderstatus")).alias("value"), ((k % 4) / 5.0).alias("confidence"))
    return reviews.second_readings(first, second).select("run_id", "verified", "confidence", "note")


@query("""WITH r AS (SELECT o_custkey AS project, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY o_custkey) SELECT c_custkey AS project, CASE WHEN open IS NULL THEN 'no review' ELSE open || ' unconfirmed' END AS reason FROM customer LEFT JOIN r ON project = c_custkey WHERE open IS NULL OR open > 0""")
def report_gates(t: Tables) -> DataFrame:
    return reviews.report_gate(t.customer.select(F.col("c_custkey").alias("project")), t.orders.select(F.col("o_custkey").alias("project"), (F.col("o_orderstatus") == "F").alias("confirmed")))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 1 AND contains(lower(s_name), '#00000000')")
def vendor_list(t: Tables) -> DataFrame:
    v = t.supplier.select("s_suppkey", F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 1, "pass").otherwise("fail").alias("status"))
    return reviews.listed(v, "pass", "#00000000").select("s_suppkey")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'disqualified' WHEN 1 THEN 'dormant' ELSE 'pass' END AS blank, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'own' END AS inputs, 'x' AS kept,
 CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS shown, (CASE WHEN p_size % 3 = 0 THEN 9 ELSE 1 END)::INT AS page FROM part""")
def drafted_defaults(t: Tables) -> DataFrame:
    size = F.col("p_size")
    part = F.element_at(F.array(*map(F.lit, "ABCD")), (size % 4 + 1).cast("int"))
    merged = reviews.merged_params(F.expr("map('inputs', 'own', 'kept', 'x')"), F.when(size % 2 == 0, F.col("p_brand")), F.lit(None).cast("string"))
    shown, page = reviews.displayed(F.col("p_name"), F.lit(1), F.when(size % 3 == 0, F.col("p_type")), F.when(size % 3 == 0, 9))
    return t.part.select("p_partkey", reviews.blank_outcome(part).alias("blank"), F.try_element_at(merged, F.lit("inputs")).alias("inputs"), F.try_element_at(merged, F.lit("kept")).alias("kept"), shown.alias("shown"), page.alias("page"))


@query("""WITH o AS (SELECT p_partkey AS letter, p_name AS title, CASE WHEN p_size % 5 = 0 THEN 'person' ELSE 'model' END AS by, CASE WHEN p_size % 7 = 0 THEN 'later' END AS reason FROM part WHERE p_partkey % 3 <> 0),
 n AS (SELECT p_partkey AS letter, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS title, 'model' AS by FROM part WHERE p_partkey % 4 <> 0)
 SELECT letter, CASE WHEN o.by = 'person' THEN o.title ELSE n.title END AS title, CASE WHEN o.by = 'person' THEN 'person' ELSE n.by END AS by, CASE WHEN o.by = 'person' AND n.title <> o.title THEN n.title END AS suggested, reason
 FROM o FULL JOIN n USING (letter) WHERE n.title IS NOT NULL OR o.by = 'person'""")
def rebuilt_ruleset(t: Tables) -> DataFrame:
    size = F.col("p_size")
    old = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("letter"), F.col("p_name").alias("title"), F.when(size % 5 == 0, "person").otherwise("model").alias("by"), F.when(size % 7 == 0, "later").alias("reason"))
    new = t.part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("letter"), F.when(size % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("title"), F.lit("model").alias("by"))
    return reviews.rebuilt(old, new)


@query("SELECT o_custkey, 'x' || (max(o_orderkey % 40) + 1) AS next_letter, string_agg(o_orderstatus || CASE WHEN n = 2 THEN '!' ELSE '' END, ',' ORDER BY n) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def edits(t: Tables) -> DataFrame:
    by = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("l"))
    letters = F.transform("l", lambda x: F.concat(F.lit("x"), (x["o_orderkey"] % 40).cast("string")))
    notes = F.transform("l", lambda x: F.struct(x["o_orderstatus"].alias("text"), F.lit(None).cast("string").alias("model"), F.lit("model").alias("by")))
    after = reviews.edited(notes, F.lit(1), F.concat(F.get("l", F.lit(1))["o_orderstatus"], F.lit("!")), F.lit("r1"))
    return by.select("o_custkey", reviews.next_added(letters).alias("next_letter"), F.array_join(F.transform(after, lambda x: x["text"]), ",").alias("notes"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AS same FROM orders")
def verdicts_equal(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    v = lambda version, x: F.struct(version.alias("ruleset_version"), x.alias("outcome"), F.lit(None).cast("string").alias("stage2"))
    df = t.orders.withColumn("a", v(F.lit(1), F.lit("pass"))).withColumn("b", v(k, F.when((k % 3 == 0) | (k % 2 == 0), "pass").otherwise("fail")))
    return df.select("o_orderkey", reviews.same_verdict("a", "b").alias("same"))


@query("""WITH x AS (SELECT l_orderkey AS run_id, CASE l_linenumber % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'disqualified' ELSE 'dormant' END AS s, CASE WHEN l_linenumber > 4 THEN 'II' ELSE 'I' END AS g, CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS v FROM lineitem)
 SELECT run_id, count(*) FILTER (s = 'pass') AS passed, count(*) FILTER (s = 'needs_review') AS review, count(*) FILTER (s = 'disqualified') AS failed, arg_max(s, v) FILTER (g = 'I' AND v IS NOT NULL) AS stage1, arg_max(s, v) FILTER (g = 'II' AND v IS NOT NULL) AS stage2, count(*) FILTER (g = 'II') AS stage2_rows FROM x GROUP BY run_id""")
def tenderer_rows(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("pass", "needs_review", "disqualified", "dormant"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return reviews.tenderer_row(t.lineitem.select(F.col("l_orderkey").alias("run_id"), status.alias("status"), F.when(F.col("l_linenumber") > 4, "II").otherwise("I").alias("stage")))


@query("""WITH e AS (SELECT p_partkey AS letter, p_size % 3 AS part, CASE WHEN p_size % 5 <> 0 THEN p_size END AS page FROM part), f AS (SELECT p_partkey AS letter, p_size % 3 AS part, CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_size END AS page FROM part WHERE p_partkey % 6 <> 0),
 j AS (SELECT e.*, f.letter IS NOT NULL AS hit, f.part AS fp, f.page AS fg FROM e LEFT JOIN f USING (letter)),
 s AS (SELECT count(*) AS items, count(*) FILTER (hit) AS found, count(*) FILTER (hit AND part = fp) AS part_right, count(*) FILTER (hit AND page = fg) AS page_right, count(page) AS paged, count(*) FILTER (hit) AS template_right, (sum(CASE WHEN hit THEN 1 ELSE 0 END))::BIGINT AS checks_found, (2 * count(*))::BIGINT AS checks FROM j)
 SELECT *, round(100.0 * found / items, 1)::DOUBLE AS found_pct, round(100.0 * part_right / items, 1)::DOUBLE AS part_pct, round(100.0 * checks_found / checks, 1)::DOUBLE AS checks_pct FROM s""")
def ruleset_scores(t: Tables) -> DataFrame:
    size, same = F.col("p_size"), (F.col("p_partkey").alias("letter"), (F.col("p_size") % 3).alias("part"), F.lit("t").alias("template"))
    expected = t.part.select(*same, F.when(size % 5 != 0, size).alias("page"), F.array(F.lit("range"), F.lit("unit")).alias("checks"))
    found = t.part.where("p_partkey % 6 <> 0").select(*same, F.when(size % 4 == 0, -1).otherwise(size).alias("page"), F.array(F.lit("range"), F.lit("date")).alias("checks"))
    return reviews.ruleset_score(expected, found)


@query("""WITH x AS (SELECT o_orderpriority AS letter, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice::DECIMAL(18,2)::DOUBLE END AS e, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice::DECIMAL(18,2)::DOUBLE * CASE WHEN o_orderkey % 3 = 0 THEN 1.1 ELSE 1.001 END::DOUBLE END AS r, o_orderkey % 4 = 0 AS v, o_orderkey % 2 = 0 AS hit, o_orderkey % 6 <> 0 AS within FROM orders),
 y AS (SELECT *, e IS NOT NULL AS he, r IS NOT NULL AS hr, coalesce(abs(e - r) <= 0.005 * greatest(abs(e), abs(r)), false) AS m FROM x)
 SELECT letter, count(*) FILTER (he = hr) AS presence, count(*) FILTER (hit) AS page_hit, count(*) FILTER (hit AND within) AS page_within, count(*) FILTER (m) AS matched, count(*) FILTER (he AND NOT hr) AS missed, count(*) FILTER (he AND hr AND NOT m) AS mismatched, count(*) FILTER (NOT he AND hr) AS invented,
 count(*) FILTER (m AND v) AS right_verified, count(*) FILTER (hr AND NOT m AND v) AS wrong_verified, count(*) FILTER (m AND NOT v) AS right_unverified, round(count(*) FILTER (m)::DOUBLE / nullif(count(*) FILTER (he), 0), 3) AS match_rate, round(count(*) FILTER (NOT he AND hr)::DOUBLE / nullif(count(*) FILTER (hr), 0), 3) AS invented_rate FROM y GROUP BY ROLLUP (letter)""")
def bid_scores(t: Tables) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("double")
    none = F.array().cast("array<int>")
    rows = t.orders.select(
        F.col("o_orderpriority").alias("letter"), F.when(k % 7 != 0, price.cast("string")).alias("expected"), F.when(k % 5 != 0, (price * F.when(k % 3 == 0, 1.1).otherwise(1.001)).cast("string")).alias("read"), (k % 4 == 0).alias("verified"),
        F.when(k % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(8))).alias("key_pages"), F.when(k % 6 == 0, F.array(F.lit(1), F.lit(9))).when(k % 2 == 0, F.array(F.lit(1))).otherwise(none).alias("read_pages"),
    )
    return reviews.bid_score(rows)


@query("""WITH x AS (SELECT l_partkey AS block, l_quantity::INT // 10 AS cluster, l_quantity::INT AS x FROM lineitem), n AS (SELECT block, count(*) AS n FROM x GROUP BY block), c AS (SELECT block, cluster, min(x) AS x, count(*) AS members FROM x GROUP BY ALL),
 k AS (SELECT c.* FROM c JOIN n USING (block) WHERE members >= greatest(2, floor(n * 0.08))) SELECT block, cluster, x, members FROM (SELECT *, count(*) OVER (PARTITION BY block) AS k FROM k) WHERE k >= 2""")
def strong_bands(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return reviews.strong_bands(t.lineitem.select(F.col("l_partkey").alias("block"), F.expr("cast(l_quantity as int) div 10").cast("int").alias("cluster"), q.alias("x")), ["block"])


def marks(t: Tables) -> DataFrame:
    """Order lines as marks: documents are orders, several marks may begin at one place."""
    n = F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, reviews.MARK_ORDER)), (F.col("l_partkey") % 6 + 1).cast("int"))
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), (n.cast("int") * 140 - (n % 2 == 0).cast("int") * 140).alias("offset"), kind.alias("kind"), F.when(F.col("l_suppkey") % 2 == 0, F.concat((n % 3).cast("string"), F.lit("."), (n % 2).cast("string"))).otherwise((n % 3).cast("string")).alias("number"), n.cast("int").alias("title"))


MARKS = """marks AS (SELECT l_orderkey AS doc, l_linenumber::INT * 140 - CASE WHEN l_linenumber % 2 = 0 THEN 140 ELSE 0 END AS "offset", ['part','part_inline','annex','clause','subclause','subitem'][CAST(l_partkey % 6 + 1 AS INT)] AS kind,
 CASE WHEN l_suppkey % 2 = 0 THEN (l_linenumber % 3) || '.' || (l_linenumber % 2) ELSE (l_linenumber % 3)::VARCHAR END AS number, l_linenumber::INT AS title, row_number() OVER () AS rn FROM lineitem)"""


@query(f"""WITH {MARKS} SELECT doc, "offset", kind, number FROM (SELECT *, row_number() OVER (PARTITION BY doc, "offset" ORDER BY list_position(['part','part_inline','annex','clause','subclause','subitem'], kind), number) AS r FROM marks) WHERE r = 1""")
def one_mark_per_place(t: Tables) -> DataFrame:
    return reviews.one_mark(marks(t)).select("doc", "offset", "kind", "number")


@query(f"""WITH {MARKS}, m AS (SELECT *, (SELECT min(b."offset") FROM marks b WHERE b.doc = a.doc AND b.kind IN ('part','part_inline','annex') AND b."offset" > a."offset") AS "end" FROM marks a)
 SELECT doc, "offset", CASE WHEN kind = 'part_inline' THEN 'part' ELSE kind END AS kind, number FROM m WHERE kind <> 'part_inline' OR EXISTS (SELECT 1 FROM marks c WHERE c.doc = m.doc AND c.kind IN ('clause','subclause','subitem') AND c."offset" > m."offset" AND (m."end" IS NULL OR c."offset" < m."end"))""")
def parts_with_content(t: Tables) -> DataFrame:
    return reviews.parts_with_content(marks(t)).select("doc", "offset", "kind", "number")


@query(f"""WITH {MARKS} SELECT doc, "offset", kind, number FROM marks a WHERE kind <> 'subclause' OR (split_part(number, '.', 1) <> '0' AND EXISTS (SELECT 1 FROM marks b WHERE b.doc = a.doc AND b.kind = 'clause' AND b.number = split_part(a.number, '.', 1)))""")
def real_subclauses(t: Tables) -> DataFrame:
    return reviews.real_subclauses(marks(t)).select("doc", "offset", "kind", "number")


@query(f"""WITH {MARKS} SELECT doc, "offset", kind, number, title FROM marks a WHERE kind <> 'annex' OR NOT EXISTS (SELECT 1 FROM marks b WHERE b.doc = a.doc AND b.kind = 'annex' AND b.rn <> a.rn AND abs(b."offset" - a."offset") < 300)""")
def annexes_apart(t: Tables) -> DataFrame:
    return reviews.apart_annexes(marks(t))


@query("""SELECT doc, page, quote, ord, first FROM (SELECT l_partkey AS doc, l_linenumber AS page, CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag END AS quote, l_orderkey AS ord, min(l_orderkey) OVER (PARTITION BY l_partkey, l_linenumber) AS first,
 row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END, l_orderkey, l_returnflag) AS r FROM lineitem) WHERE r = 1""")
def citations_once(t: Tables) -> DataFrame:
    return reviews.cited_once(t.lineitem.select(F.col("l_partkey").alias("doc"), F.col("l_linenumber").alias("page"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_returnflag")).alias("quote"), F.col("l_orderkey").alias("ord")))


@query("""WITH j AS (SELECT o_custkey AS project, o_orderkey::VARCHAR AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) AS n FROM orders), a AS (SELECT *, coalesce(max(n) FILTER (job_id = '7') OVER (PARTITION BY project), 0) AS k FROM j)
 SELECT project, job_id FROM a WHERE n > k AND n <= k + 3""")
def jobs_page(t: Tables) -> DataFrame:
    j = t.orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderdate").alias("created"))
    return reviews.jobs_after(j, "7", 3).select("project", "job_id")


@query("""WITH d AS (SELECT o_custkey AS run_id, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY o_custkey)
 SELECT run_id, CASE WHEN f = 0 THEN 'F' WHEN o = 0 THEN 'O' WHEN p = 0 THEN 'P' END AS step FROM d""")
def next_steps(t: Tables) -> DataFrame:
    steps = t.spark.createDataFrame([("O", 2), ("F", 1), ("P", 3)], "step string, ord int")
    return reviews.next_steps(steps, t.orders.select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("step")))


@query("""WITH a AS (SELECT l_orderkey AS key, ['big','small','local'][CAST(l_linenumber % 3 + 1 AS INT)] AS model, max(CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END) AS answer FROM lineitem GROUP BY ALL), p AS (SELECT *, list_position(['small','local','big'], model) AS n FROM a)
 SELECT key, arg_min(answer, n) FILTER (answer IS NOT NULL) AS answer, arg_min(model, n) FILTER (answer IS NOT NULL) AS model, count(*) FILTER (answer IS NULL) AS failed FROM p GROUP BY key""")
def model_chain(t: Tables) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, ("big", "small", "local"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    tries = t.lineitem.groupBy(F.col("l_orderkey").alias("key"), model.alias("model")).agg(F.max(F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey"))).alias("answer"))
    return reviews.first_answer(tries, ["small", "local", "big"])


@query("SELECT c_custkey AS run_id, (c_custkey + coalesce(n, 0))::DOUBLE AS usd FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def run_costs(t: Tables) -> DataFrame:
    return reviews.running_cost(t.customer.select(F.col("c_custkey").alias("run_id"), F.col("c_custkey").cast("double").alias("usd")), t.orders.select(F.col("o_custkey").alias("run_id"), F.lit(1.0).alias("usd")))


@query("""WITH a AS (SELECT l_orderkey AS run_id, min(l_linenumber * 10000000 + l_partkey) AS ord, l_partkey % 40 AS id FROM lineitem GROUP BY l_orderkey, l_partkey % 40)
 SELECT run_id, ord, id, CASE WHEN id >= 30 THEN 'unknown' WHEN ord % 4 < 2 THEN 'verified' ELSE 'unverified' END AS state FROM a""")
def checked_choices(t: Tables) -> DataFrame:
    menu = t.spark.range(30).select(F.col("id"), F.concat(F.lit("Item  "), F.col("id").cast("string"), F.lit(" is supplied")).alias("text"))
    ord_ = F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    quote = F.when(ord_ % 4 < 2, F.concat(F.lit(" ITEM "), (F.col("l_partkey") % 40).cast("string"))).otherwise("nothing of the kind")
    answers = t.lineitem.select(F.col("l_orderkey").alias("run_id"), ord_.alias("ord"), (F.col("l_partkey") % 40).cast("long").alias("id"), quote.alias("quote"))
    return reviews.checked_choices(answers, menu).select("run_id", "ord", "id", "state")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(e - round(q * 2.5, 2)) <= 0.01 THEN 'positive' ELSE 'negative' END AS product, least(q, e) AS low, CASE WHEN q >= 20 THEN 'positive' ELSE 'negative' END AS least, CASE WHEN l_linenumber = 1 THEN NULL WHEN q BETWEEN 10 AND 30 THEN 'positive' ELSE 'negative' END AS ranged,
 CASE WHEN abs(q - 25) <= 5 THEN 'neutral' END AS share, CASE WHEN q > 40 OR l_linenumber > 3 THEN 'negative' ELSE 'positive' END AS every, CASE WHEN l_linenumber % 2 = 0 THEN 'neutral' WHEN l_returnflag = 'R' THEN 'positive' ELSE 'negative' END AS texts
 FROM (SELECT *, l_quantity::DOUBLE AS q, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::DOUBLE * 2.5 ELSE l_extendedprice::DOUBLE END AS e FROM lineitem)""")
def engine_transforms(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("double")
    e = F.when(F.col("l_linenumber") % 2 == 0, q * 2.5).otherwise(F.col("l_extendedprice").cast("double"))
    lo = F.when(F.col("l_linenumber") != 1, 10.0)
    every = numbers.thresholds(F.array(q, F.col("l_linenumber").cast("double")), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(40.0), F.lit(3.0)))
    same = numbers.text_match(F.col("l_linenumber") % 2 == 1, F.concat(F.lit(" "), F.lower("l_returnflag")), F.lit("R "))
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.product_matches(e, q, F.lit(2.5)).alias("product"), numbers.lower_bound(q, e).alias("low"), numbers.at_least(q, F.lit(20.0)).alias("least"), numbers.in_range(q, lo, F.lit(30.0)).alias("ranged"), numbers.percentage_threshold(q - 25, F.lit(5.0)).alias("share"), every.alias("every"), same.alias("texts"))


@query("""SELECT o_orderkey, d >= (DATE '1996-06-30' - INTERVAL 4 MONTH)::DATE AS recent, DATE '1995-01-01' BETWEEN d AND d + 100 AS valid, CASE WHEN d <= DATE '1995-06-17' THEN 'positive' ELSE 'negative' END AS on_time, strftime(to_timestamp(o_orderkey), '%Y-%m-%dT%H:%M:%SZ') AS iso,
 least(120.0, 2.0 * pow(2, o_orderkey % 9))::DOUBLE AS wait FROM (SELECT *, o_orderdate::DATE AS d FROM orders)""")
def date_checks(t: Tables) -> DataFrame:
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    return t.orders.select("o_orderkey", dates.not_earlier_than(d, F.lit("1996-06-30").cast("date"), 4).alias("recent"), dates.within(d, F.lit("1995-01-01").cast("date"), F.date_add(d, 100)).alias("valid"), dates.on_time(d, F.lit("1995-06-17").cast("date")).alias("on_time"), dates.iso_utc(k).alias("iso"), dates.retry_wait(k % 9).alias("wait"))


TEXTS = ("[REDACTED]", "blacked-out", "████", "XXXX", "masked", " hidden ", "xx", "12 345.60 kg", "N/A.", "(Nil)", "-", "2.50% and 12,000", "30.06.2026", "2,505%", "The Conditions of Tenders", "Clause 3. It shall do so; then", "no modal here.", "form.fee_printed", "form.fee", "7-day: 2.505%")


@query("""WITH v(i, x) AS (VALUES """ + ", ".join(f"({i}, '{x}')" for i, x in enumerate(TEXTS)) + """),
 e(i, covered, number, blank, places, obligation, meta) AS (VALUES (0, true, NULL, 'redacted', '', NULL, false), (1, true, NULL, 'blackedout', '', NULL, false), (2, true, NULL, '', '', NULL, false), (3, true, NULL, 'xxxx', '', NULL, false), (4, true, NULL, 'masked', '', NULL, false), (5, true, NULL, 'hidden', '', NULL, false),
 (6, false, NULL, 'xx', '', NULL, false), (7, false, 12345.6, '12 34560 kg', '0,2', NULL, false), (8, false, NULL, 'na', '', NULL, false), (9, false, NULL, 'nil', '', NULL, false), (10, false, NULL, '', '', NULL, false), (11, false, 2.5, '250 and 12000', '2,0', NULL, false), (12, false, 30.06, '30062026', '', NULL, false), (13, false, 2505.0, '2505', '3', NULL, false),
 (14, false, NULL, 'the conditions of tenders', '', NULL, false), (15, false, 3.0, 'clause 3 it shall do so then', '0', 'It shall do so;', false), (16, false, NULL, 'no modal here', '', NULL, false), (17, false, NULL, 'formfeeprinted', '', NULL, true), (18, false, NULL, 'formfee', '', NULL, false), (19, false, 7.0, '7day 2505', '0,3', NULL, false))
 SELECT p_partkey, covered, number::DOUBLE AS number, blank, places, obligation, meta FROM v JOIN e USING (i) JOIN part ON p_partkey % (SELECT count(*) FROM v) = i""")
def text_edges(t: Tables) -> DataFrame:
    """Readings on the edge of their definitions: covered values, spaced thousands, answers for nothing, decimal places."""
    df = t.part.select("p_partkey", F.element_at(F.array(*[F.lit(x).cast("string") for x in TEXTS]), (F.col("p_partkey") % len(TEXTS) + 1).cast("int")).alias("x"))
    return df.select("p_partkey", text.redacted_reading("x").alias("covered"), text.coerced_number("x").alias("number"), text.blank_key("x").alias("blank"), F.array_join(F.transform(text.decimal_places("x"), lambda n: n.cast("string")), ",").alias("places"), text.obligation_sentence("x").alias("obligation"), text.is_meta("x").alias("meta"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS squashed, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS bare, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, ceil(length(p_name) / 3.5)::BIGINT AS tokens,
 substr(sha256(p_name || chr(31) || p_brand), 1, 12) AS content, split_part(p_brand, '#', 2) AS short, lower(trim(p_brand)) IN ('yes', 'true', '1') AS flag, 'HK$' || format('{:,.2f}', p_retailprice::DECIMAL(18,2)) AS money FROM part""")
def text_keys(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.squash("p_name").alias("squashed"), text.letters_digits("p_type").alias("bare"), text.slug("p_type").alias("slug"), text.token_estimate("p_name").alias("tokens"), text.content_id("p_name", "p_brand").alias("content"), text.short_name(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("short"), text.flag("p_brand").alias("flag"), text.money(F.col("p_retailprice").cast("decimal(18,2)")).alias("money"))
