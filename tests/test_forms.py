from __future__ import annotations

from bidloom.operators import forms


def test_forms(spark):
    f = spark.createDataFrame([("price", "price schedule"), ("parts", "Price Schedule Parts C & D"), ("offer", "offer to be bound")], "form string, phrase string")
    t = spark.createDataFrame([("The PRICE-SCHEDULE, parts C & D",), ("Price schedule; offer to be bound",), ("nothing",)], "title string")
    assert {r["title"]: r["form"] for r in forms.form_of_title(t, f).collect()} == {"The PRICE-SCHEDULE, parts C & D": "parts", "Price schedule; offer to be bound": "price", "nothing": None}


def test_corrections_and_blockers(spark):
    req = spark.createDataFrame([(1, "f.a", "5", True, None), (1, "f.b", "x", False, 3)], "run_id int, key string, value string, present boolean, page int")
    assert sorted((r["key"], r["value"]) for r in forms.correction_entries(req).collect() if r["value"]) == [("f.a", "5"), ("f.b_page", "3")]
    slots = spark.createDataFrame([("a", "x", True, ""), ("a", "y", False, "")], "letter string, name string, required boolean, value string")
    refs = spark.createDataFrame([("a", "y"), ("a", "z")], "letter string, name string")
    items = spark.createDataFrame([("a", 2), ("b", 0)], "letter string, rules int")
    got = {tuple(r) for r in forms.confirm_blockers(slots, refs, items).collect()}
    assert got == {("a", "slot not filled: x"), ("a", "no such slot: z"), ("b", "no rules")}
