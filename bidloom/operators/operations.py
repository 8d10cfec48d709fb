"""Operations that rules name: a registry of column builders, refused while planning where a name is unknown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from .rules import few


class Item:
    """What an operation reads: the item's own field, other fields, those named after the rule, and the rule's params."""

    def at(self, name: Column | str) -> Column:
        return F.try_element_at("f", F.lit(name) if isinstance(name, str) else name)

    @property
    def own(self) -> Column:
        return self.at(F.col("field_id"))

    def beside(self, tail: str) -> Column:
        return self.at(F.concat("field_id", F.lit(tail)))

    def of_rule(self, tail: str) -> Column:
        return self.at(F.concat("rule_id", F.lit("__" + tail)))

    def param(self, *names: str) -> Column:
        return F.coalesce(*[F.try_element_at("params", F.lit(n)) for n in names])

    def limit(self, *names: str) -> Column:
        """A param's number, read once per rule."""
        return F.coalesce(*[F.try_element_at("_numbers", F.lit(n)) for n in names])

    def input(self, i: int) -> Column:
        return self.at(F.coalesce(F.get(F.split(self.param("inputs"), r"\|"), F.lit(i)), F.lit("")))


def _said(bucket: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((none if bucket is None else bucket).alias("bucket"), (none if value is None else value.cast("string")).alias("value"))


def _passed(ok: Column) -> Column:
    return text.once(ok, lambda x: F.when(x, "positive").when(~x, "negative"))


_num = text.number


def _product(x: Item) -> Column:
    expected = F.round(_num(x.input(0)) * _num(x.input(1)), 2)
    return text.once(expected, lambda e: _said(_passed(F.abs(_num(x.own) - e) <= F.coalesce(x.limit("tolerance"), F.lit(0.01))), e))


def _deadline(step: Callable[[Column, Column], Column]) -> Callable[[Item], Column]:
    def build(x: Item) -> Column:
        said = lambda due: _said(_passed(dates.parse_date(x.of_rule("actual_date")) <= due), F.date_format(due, "yyyy-MM-dd"))
        return text.once(step(dates.parse_date(x.of_rule("base_date")), x.limit("offset").cast("int")), said)

    return build


def _range(x: Item) -> Column:
    return _said(text.once(_num(x.own), lambda v: numbers.in_range(v, x.limit("min", "min_kg"), x.limit("max", "max_kg"))), x.own)


def _thresholds(x: Item) -> Column:
    """values "3|40" against checks "min:2|max:50", of which there must be as many."""
    both = F.struct(F.split(x.of_rule("values"), r"\|").alias("v"), F.split(x.param("checks"), r"\|").alias("c"))
    limit = lambda c: _num(F.substring_index(c, ":", -1))
    fails = lambda n: F.exists(F.zip_with(n["v"], n["c"], lambda v, c: F.when(c.startswith("max:"), _num(v) > limit(c)).otherwise(_num(v) < limit(c))), lambda b: F.coalesce(b, F.lit(False)))
    return _said(text.once(both, lambda n: F.when(F.size(n["v"]) == F.size(n["c"]), _passed(~fails(n)))))


def _same_text(x: Item) -> Column:
    asked = x.param("condition").isNotNull() & (F.coalesce(x.at(F.coalesce(x.param("condition"), F.lit(""))), F.lit("")).isin("", "false"))
    return _said(F.when(asked, "neutral").otherwise(_passed(F.when(x.input(0).isNotNull() & x.input(1).isNotNull(), text.normalise(x.input(0)) == text.normalise(x.input(1))))))


OPERATIONS: dict[str, Callable[[Item], Column]] = {
    "round_significant_figures": lambda x: _said(None, numbers.significant_any(_num(x.own), x.limit("max_sig_figs").cast("int"))),
    "resolve_range_to_lower_bound": lambda x: _said(None, F.least(_num(x.own), F.coalesce(_num(x.beside("_max")), _num(x.own)))),
    "arithmetic_product": _product,
    "add_working_days": _deadline(dates.add_working_days_by),
    "add_calendar_days": _deadline(F.date_add),
    "date_not_earlier_than": lambda x: _said(_passed(dates.parse_date(x.input(0)) >= F.add_months(dates.parse_date(x.at("tender_closing_date")), -x.limit("max_age_value").cast("int")))),
    "date_within_range": lambda x: _said(_passed(dates.parse_date(F.coalesce(x.at("original_tender_closing_date"), x.at("tender_closing_date"))).between(dates.parse_date(x.beside("_issue_date")), dates.parse_date(x.beside("_expiry_date"))))),
    "min_value_check": lambda x: _said(_passed(_num(x.own) >= x.limit("min_kg", "min")), x.own),
    "value_in_range": _range,
    "range_check": _range,
    "percentage_threshold": lambda x: _said(F.when(F.abs(_num(x.of_rule("deviation_pct"))) <= x.limit("max_deviation_pct"), "neutral"), x.of_rule("deviation_pct")),
    "threshold_checks": _thresholds,
    "text_match": _same_text,
}


def operated(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Each item with each rule: all columns of both but params, f and operation, and bucket and value.

    items: f, a map of fields; rules: rule_id, field_id, operation, params, few. The names that rules ask for are read first, and
    one without a builder raises before any item is; only the builders asked for are in the plan. A bucket is positive,
    negative or neutral, or null where an input is missing or the operation only makes a value.
    """
    asked = sorted(r["operation"] for r in rules.select("operation").distinct().collect())
    if unknown := [x for x in asked if x not in OPERATIONS]:
        raise KeyError(f"no such operation: {', '.join(map(str, unknown))}")
    df = items.crossJoin(few(rules.withColumn("_numbers", F.transform_values("params", lambda _, x: _num(x)))))
    one = F.coalesce(*[F.when(F.col("operation") == name, OPERATIONS[name](Item())) for name in asked], _said())
    # One generated method with all operations is too long to be compiled; in a lambda, one row's operation is evaluated, and by a generator once.
    said = F.transform(F.array(F.lit(True)), lambda _: one)
    return df.select(*[c for c in df.columns if c not in ("params", "f", "operation", "_numbers")], F.inline(said))
