from __future__ import annotations

import pytest

from bidloom.operators import operations


def test_operations(spark):
    f = {"v": "12.35", "v_max": "15", "d": "1 March 2024", "tender_closing_date": "2024-03-31", "v_issue_date": "2024-03-01", "v_expiry_date": "2024-03-30", "w__base_date": "2024-03-01", "w__actual_date": "2024-03-08", "p__deviation_pct": "-4", "t__values": "3|40"}
    rules = [
        ("s", "round_significant_figures", {"max_sig_figs": "3"}, None, "12.4"), ("l", "resolve_range_to_lower_bound", {}, None, "12.35"), ("w", "add_working_days", {"offset": "5"}, "positive", "2024-03-08"), ("x", "add_calendar_days", {"offset": "5"}, None, None),
        ("n", "date_not_earlier_than", {"inputs": "d", "max_age_value": "1"}, "positive", None), ("r", "date_within_range", {}, "negative", None), ("p", "percentage_threshold", {"max_deviation_pct": "5"}, "neutral", "-4"), ("t", "threshold_checks", {"checks": "min:3|max:39"}, "negative", None),
        ("u", "threshold_checks", {"checks": "min:3"}, None, None), ("m", "min_value_check", {}, None, "12.35"), ("g", "range_check", {"min": "1", "max_kg": "12.35"}, "positive", "12.35"), ("q", "text_match", {"inputs": "d|gone"}, None, None), ("a", "arithmetic_product", {"inputs": "v|v"}, "negative", "152.52"),
    ]
    table = spark.createDataFrame([(r, "v", o, p) for r, o, p, _, _ in rules], "rule_id string, field_id string, operation string, params map<string,string>")
    items = spark.createDataFrame([(1, f)], "item int, f map<string,string>")
    got = {r["rule_id"]: (r["bucket"], r["value"]) for r in operations.operated(items, table).collect()}
    assert got == {r: (b, v) for r, _, _, b, v in rules}
    bad = spark.createDataFrame([("r", "v", "no_such", {})], "rule_id string, field_id string, operation string, params map<string,string>")
    with pytest.raises(KeyError, match="no_such"):
        operations.operated(items, bad)


def test_params_are_read_once(spark):
    """Numbers of a rule are read with the rule, and each item's field once: fewer patterns in the plan than operations read fields."""
    table = spark.createDataFrame([("g", "v", "range_check", {"min": "1,000", "max": "x"}), ("h", "v", "range_check", {"min": "1,000", "max": "2000 kg"})], "rule_id string, field_id string, operation string, params map<string,string>")
    items = spark.createDataFrame([(1, {"v": "1,500"})], "item int, f map<string,string>")
    df = operations.operated(items, table)
    assert {r["rule_id"]: r["bucket"] for r in df.collect()} == {"g": None, "h": "positive"}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 2


def test_dates_by_marks(spark):
    """Every form of a date, and texts with the marks of several, are read as by trying all forms in order."""
    from pyspark.sql import functions as F

    from bidloom.functions import dates
    from bidloom.functions.vocab import DATE_FORMATS

    said = ["3rd March 2026", "3 Mar 2026", "2026-3-3", "03/03/2026", "3.3.2026", "March 3, 2026", "3 March, 2026", "3-3-2026", "2026-03-03 x", "3/3.2026", "", "x", "3,3", "1 2 3, 4-5/6.7", None]
    t = F.regexp_replace(F.trim(F.col("value")), r"(\d)(st|nd|rd|th)\b", "$1")
    got = spark.createDataFrame([(x,) for x in said], "value string").select(dates.parse_date("value").alias("a"), F.coalesce(*[F.try_to_date(t, f) for f in DATE_FORMATS]).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and sum(r["a"] is not None for r in got) >= 8
