from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidloom.functions import dates, numbers, text
from bidloom.operators import pricing, relational, rules


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("x", "want"), [(2.849, 2.8), (2.85, 2.9), (5.678, 5.7), (0.02349, 0.023), (0.0255, 0.026), (3.0, 3.0), (57.5, 58.0), (0.0, 0.0)])
def test_significant_figures(spark, x, want):
    assert one(spark, numbers.significant(F.lit(x), 2))[0] == want


def test_presence(spark):
    cases = [(None, False, "blank"), ("", False, "blank"), ("  ", False, "blank"), ("N/A", False, "not_applicable"), (" na ", False, "not_applicable"), ("Nil", False, "filled"), ("0", False, "filled"), ("x", True, "redacted")]
    for value, red, want in cases:
        assert one(spark, rules.presence(F.lit(value).cast("string"), F.lit(red)))[0] == want


def test_dates(spark):
    for printed in ("3rd March 2026", "3 Mar 2026", "2026-03-03", "03/03/2026", "3.3.2026", "March 3, 2026"):
        assert one(spark, dates.parse_date(F.lit(printed)))[0] == dt.date(2026, 3, 3), printed
    assert one(spark, dates.parse_date(F.lit("noon on 30 June")))[0] is None
    assert one(spark, dates.add_working_days(F.to_date(F.lit("2026-08-14")), 5))[0] == dt.date(2026, 8, 21)


def test_text(spark):
    row = one(spark, text.decimal_places(F.lit("2.50%, 1,000 and 30.06.2026 or 2,505%")), text.number(F.lit("HK$ 1,234.5 net")), text.normalise(F.lit("1st September, 2026")), text.agree(F.lit("12 mg/L"), F.lit("mg/l")), text.contains_words(F.lit("steel plate"), F.lit("eel")))
    assert list(row) == [[2, 0, 3], 1234.5, "1st sep 2026", True, False]
    row = one(spark, text.longest_run(F.lit("a b c d"), F.lit("x a b c y")), text.longest_run(F.lit("a b c d"), F.lit("x a y")), text.quote_on_page(F.lit("p q r s t u v w"), F.lit("q r s t u v")), text.obligation_sentence(F.lit("Some text. You shall do it; or not.")))
    assert list(row) == [0.75, 0.0, True, "You shall do it;"]


def test_currency(spark):
    want = {"HK$ 4.4": ("HKD", None), "U.S.$ 7": ("USD", None), "HK$ 5 (US$ 0.6)": (None, "mixed"), "$ 5": (None, "ambiguous"), "": (None, "not stated"), "Zloty 3": (None, "unknown"), "two euros": ("EUR", None)}
    for printed, (code, problem) in want.items():
        r = one(spark, pricing.read_currency(F.lit(printed)).alias("r"))["r"]
        assert (r["code"], r["problem"]) == (code, problem), printed


def test_price_summary_of_four_offers(spark):
    df = spark.createDataFrame([("A", 4.40, 4.3, "HK$", True), ("B", 4.86, 4.3, "HK$", True), ("C", 5.89, 3.3, "HK$", False), ("D", 7.22, 3.0, "US$", True)], "tenderer string, unit_price double, dosage double, printed string, conforming boolean")
    df = df.withColumns({"project": F.lit(1), "base": F.lit("HKD"), "quantity": F.lit(875000.0), "reading": pricing.read_currency(F.col("printed"))})
    rows = pricing.price_rows(pricing.converted(df, spark.createDataFrame([("USD", 7.8)], "code string, to_base double"))).collect()
    got = {r["tenderer"]: (r["unit_price_base"], r["metric"], r["rank"], r["recommended"]) for r in rows}
    assert got == {"A": (4.4, 18.92, 1, True), "B": (4.86, 20.9, 3, False), "C": (5.89, 19.44, 2, False), "D": (56.316, 168.95, 4, False)}


def test_outcomes_by_dependency(spark):
    r = spark.createDataFrame([("p", None, True), ("c", "p", True), ("g", "c", True), ("n", None, False), ("m", "n", True)], "rule_id string, parent string, evaluable boolean")
    rows = spark.createDataFrame([(1, "p", "pass"), (1, "c", "disqualified"), (1, "g", "pass"), (1, "m", "pass"), (2, "g", "pass"), (2, "p", "pass")], "run_id int, rule_id string, status string")
    got = {(x["run_id"], x["rule_id"]) for x in rules.visible(rows, r).collect()}
    assert got == {(1, "p"), (1, "c"), (1, "m"), (2, "p")}
    assert rules.cyclic(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "rule_id string, parent string")).count() == 2


def test_water_fill_and_normalised_steps(spark):
    assert [tuple(x) for x in one(spark, relational.water_fill(F.array(F.lit(10), F.lit(2), F.lit(50)), 30))[0]] == [(0, 10), (1, 2), (2, 18)]
    steps = F.array(F.struct(F.lit("round_significant_figures").alias("op"), F.lit(2).alias("figures")))
    assert one(spark, rules.normalised_steps(F.lit("2.85 mg"), steps))[0] == 2.9
    assert one(spark, rules.range_low_end(F.lit("5"), F.lit("3 - 5 mg"), F.lit(False)))[0] == 3.0


def test_water_fill(spark):
    from pyspark.sql import functions as F

    from bidloom.operators import relational as rel

    cases = [((10, 2, 50), 30, [10, 2, 18]), ((5, 5, 5), 9, [3, 3, 3]), ((100,), 30, [30]), ((1, 1, 1, 97), 50, [1, 1, 1, 47]), ((7, 7), 100, [7, 7])]
    for lengths, total, want in cases:
        row = spark.range(1).select(rel.water_fill(F.array(*map(F.lit, lengths)), total).alias("r")).first()
        assert [x["share"] for x in row["r"]] == want
