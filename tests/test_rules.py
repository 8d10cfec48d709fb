"""The rule engine's wiring on small runs: chains of normalising rules, notes, reviewers, blocked items, deadlines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bidloom.operators import rules, store

ENTRY = "map<string,struct<status:string,note:string>>"
RULE = f"rule_id string, field_id string, check string, tier string, stage string, parent string, letter string, row_ord int, outcomes {ENTRY}, params map<string,string>, evaluable boolean, steps array<struct<op:string,figures:int>>, entered_by string"
PLAIN = {"blank": ("disqualified", "{field} is blank"), "filled": ("pass", None), "redacted": ("needs_review", None)}


def made(spark, *rows):
    """rule_id, field_id, check, params, and further columns by name."""
    out = []
    for i, (rule, field, check, params, more) in enumerate(rows):
        have = {"tier": "critical", "stage": None, "parent": None, "letter": "a", "outcomes": PLAIN, "evaluable": True, "steps": [], "entered_by": None} | more
        out.append((rule, field, check, have["tier"], have["stage"], have["parent"], have["letter"], i, have["outcomes"], params, have["evaluable"], have["steps"], have["entered_by"]))
    return spark.createDataFrame(out, RULE)


def fields(spark, rows):
    return spark.createDataFrame(rows, "run_id int, field_id string, value string, printed string, redacted boolean, corrected boolean")


def said(df):
    return {(r["run_id"], r["rule_id"]): (r["status"], r["note"]) for r in df.collect()}


def test_fields_without_rows_are_blank(spark):
    f = fields(spark, [(1, "s.a", "5", None, False, False), (2, "s.b", "x", None, False, False)])
    r = made(spark, ("a_given", "s.a", "filled", {}, {}), ("a_small", "s.a", "range", {"max": "4.5"}, {"outcomes": {"filled": ("pass", None)}}), ("b_is", "s.b", "value", {"expected": "y"}, {}))
    assert said(rules.evaluated(f, r)) == {
        (1, "a_given"): ("pass", None), (1, "a_small"): ("needs_review", "a: read '5', allowed at most 4.5"), (1, "b_is"): ("disqualified", "b is blank"),
        (2, "a_given"): ("disqualified", "a is blank"), (2, "b_is"): ("needs_review", "b: read 'x', expected 'y'"),
    }


def test_chains_of_normalising_rules(spark):
    rows = [(1, "5.1 - 4.36 kg/t", None), (2, "4.36", "5.1 - 4.36 kg/t"), (3, "2.855 kg/t", None), (4, "Nil.", None), (5, "None noted", None), (6, "about", None)]
    f = fields(spark, [(i, "s.dose", v, p, False, False) for i, v, p in rows])
    steps = [("resolve_range_to_lower_bound", None), ("round_significant_figures", 2)]
    r = made(spark, ("nothing", "s.dose", "filled", {"blank_if": "nil|none"}, {}), ("rounded", "s.dose", "range", {"max": "4.4"}, {"steps": steps}), ("in_kg", "s.dose", "unit", {"allowed": "kg/t"}, {}))
    got = said(rules.evaluated(f, r))
    assert got[1, "rounded"] == ("pass", "dose: read '5.1 - 4.36 kg/t', allowed at most 4.4") and got[1, "in_kg"][0] == "pass"
    assert got[2, "rounded"][0] == "pass" and got[3, "rounded"][0] == "pass"
    assert got[4, "nothing"] == ("disqualified", "dose is blank")
    assert got[5, "nothing"][0] == "needs_review" and "could not be settled" in got[5, "nothing"][1]
    assert got[6, "rounded"][0] == "needs_review" and got[6, "nothing"][0] == "pass"
    made_of = {(x["run_id"], x["was"], x["value"]) for x in rules.adjustments(f, r).collect()}
    assert {(1, "5.1 - 4.36 kg/t", "4.4"), (2, "4.36", "4.4"), (3, "2.855 kg/t", "2.9")} == made_of


def test_explicit_outcomes_and_cycles(spark):
    import pytest

    own = PLAIN | {"compliant": ("pass", "{field} said so")}
    f = fields(spark, [(1, "s.a", None, None, True, False), (1, "look__outcome", "compliant", None, False, False), (2, "s.a", "x", None, False, False), (2, "look__outcome", "unheard", None, False, False)])
    r = made(spark, ("look", "s.a", "filled", {}, {"outcomes": own}), ("silent", "s.a", "filled", {}, {"outcomes": {"blank": ("dormant", None)}}))
    got = said(rules.evaluated(f, r))
    assert got[1, "look"] == ("pass", "a said so") and got[2, "look"][0] == "pass"
    assert got[2, "silent"] == ("needs_review", "a reads 'x', an answer this rule has no outcome for; a reviewer decides")
    loop = spark.createDataFrame([("a", "b", True), ("b", "a", True)], "rule_id string, parent string, evaluable boolean")
    with pytest.raises(ValueError, match="cycle"):
        rules.ancestors(loop)
    chain = spark.createDataFrame([(f"r{i:02}", f"r{i - 1:02}" if i else None, True) for i in reversed(range(30))], "rule_id string, parent string, evaluable boolean")
    assert rules.ancestors(chain).where("rule_id = 'r29'").count() == 29
    assert rules.resolution_order(chain.drop("evaluable")) == [f"r{i:02}" for i in range(30)]


def test_what_follows_the_engine(spark):
    rows = [
        (1, "s.document", "yes", None, None, None, None, None), (1, "s.sign", None, None, None, None, None, None), (1, "s.fee", "5", False, "2 and 5", None, None, None),
        (2, "s.document", None, None, None, "p.3, p.4", None, None), (2, "s.sign", None, None, None, None, "pass", "r7"), (3, "s.document", None, None, None, None, None, None),
    ]
    f = spark.createDataFrame(rows, "run_id int, field_id string, value string, verified boolean, verify_note string, located string, decision string, decided_by string")
    r = made(spark, ("doc", "s.document", "document_present", {}, {}), ("sign", "s.sign", "signature", {}, {}), ("fee", "s.fee", "filled", {}, {}), ("late", "s.late", "filled", {}, {"entered_by": "reviewer", "outcomes": {"filled": ("pass", None)}, "parent": "doc"}))
    rows = rules.after_engine(rules.visible(rules.evaluated(f, r), r.select("rule_id", "parent", "evaluable")))
    got = said(rows)
    assert got[1, "sign"][0] == "needs_review" and "on a form that is there" in got[1, "sign"][1]
    assert got[1, "fee"] == ("needs_review", "unverified: 2 and 5")
    assert got[2, "doc"][0] == "needs_review" and "p.3, p.4" in got[2, "doc"][1]
    assert got[3, "doc"][0] == "disqualified"
    assert got[2, "fee"] == ("needs_review", "unextracted: no form reads fee; a reviewer decides")
    every = said(rules.with_reviewer_rows(rows, f, r))
    assert every[1, "late"] == ("dormant", "late is entered by a reviewer once it arrives; not recorded yet") and (3, "late") not in every
    assert set(got) == set(every) - {(1, "late"), (2, "late")}


def test_items_that_rules_cannot_decide(spark):
    r = made(spark, ("x", "s.a", "filled", {}, {"letter": "b", "tier": "odd", "outcomes": None}), ("y", "s.a", "filled", {"min": "{limit}"}, {"letter": "c"}), ("z", "s.a", "filled", {}, {"letter": "d", "outcomes": None}))
    items = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("d", "gone"), ("e", None)], "letter string, template string")
    blocked = rules.blocked_items(items, r, spark.createDataFrame([("t",)], "template string"), spark.createDataFrame([("t", "critical")], "template string, tier string"))
    why = {x["letter"]: x["reason"] for x in blocked.collect()}
    assert set(why) == {"a", "b", "d", "e"} and "no rules" in why["a"] and "'odd'" in why["b"] and "'gone'" in why["d"]
    off = rules.off_reasons(r, spark.createDataFrame([("limit", False, "")], "name string, required boolean, value string"))
    rows = spark.createDataFrame([(1, "c", 1, "needs_review", "look")], "run_id int, letter string, row_ord int, status string, note string")
    out = rules.completed_verdicts(rules.item_verdicts(rows), spark.createDataFrame([(1,), (2,)], "run_id int"), items, blocked, off).collect()
    got = {(x["run_id"], x["letter"]): (x["outcome"], x["reasons"]) for x in out}
    line = "rule y not checked: the tender sets no limit"
    assert len(got) == 10 and got[1, "c"] == ("needs_review", f"look; {line}") and got[2, "c"] == ("pass", line) and got[2, "a"] == ("needs_review", why["a"])


def test_deadlines_of_dormant_rows(spark):
    f = fields(spark, [(1, "authority_request_date", "2026-08-14", None, False, False), (2, "y__base_date", "3 March 2026", None, False, False)])
    rows = spark.createDataFrame([(1, "y", "dormant", "later"), (2, "y", "dormant", "soon"), (2, "z", "pass", "later"), (3, "y", "dormant", "later")], "run_id int, rule_id string, status string, tier string")
    tiers = spark.createDataFrame([("later", "add_working_days", 5), ("soon", "add_calendar_days", 10)], "tier string, op string, days int")
    got = {(x["run_id"], x["rule_id"]): x["deadline"] for x in rules.follow_ups(rows, f, tiers).collect()}
    assert got == {(1, "y"): dt.date(2026, 8, 21), (2, "y"): dt.date(2026, 3, 13)}


def test_corrections_of_fields_that_were_not_read(spark):
    f = spark.createDataFrame([(1, "a", "5", "5 mg", True)], "run_id int, field_id string, value string, printed string, verified boolean")
    c = spark.createDataFrame([(1, "b", "7", "r1", "seen"), (1, "a_decision", "pass", "r2", "fine"), (1, "a_page", "3", "r2", None)], "run_id int, key string, value string, by string, reason string")
    got = {r["field_id"]: (r["value"], r["corrected"], r["decision"], r["decided_by"], r["decided_why"]) for r in store.with_corrections(f, c).collect()}
    assert got == {"a": ("5", False, "pass", "r2", "fine"), "b": ("7", True, None, None, None)}


def test_audit_goes_on_from_the_last_id(spark):
    events = spark.createDataFrame([("2026-01-01 00:00:00", "a", 7)], "at string, subject string, id long").withColumn("at", F.to_timestamp("at"))
    new = spark.createDataFrame([(f"2026-01-0{1 + i % 3} 0{i % 5}:00:00", f"s{i}") for i in range(20)], "at string, subject string").withColumn("at", F.to_timestamp("at"))
    got = store.audit(events, new).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(7, 28)) and [(r["at"], r["subject"]) for r in got[1:]] == sorted((r["at"], r["subject"]) for r in new.collect())
