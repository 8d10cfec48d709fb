"""Which form a title names, tiers by Part, and defaults that depend on the Part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import few

#: The tier of a form that must be submitted, by Part of the schedule.
PART_TIER = {"A": "critical", "B": "mandatory_on_request", "C": "discretionary"}


def form_of_title(titles: DataFrame, forms: DataFrame) -> DataFrame:
    """(title, form): the form whose phrase comes first in the title, the longest on ties; letters and digits only.

    forms: form, phrase; a short dimension, which is counted, so a broadcast nested loop of titles and phrases is what is meant.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    f = few(forms.select("form", bare(F.col("phrase")).alias("p")).where("p <> ''"))
    j = titles.select("title", bare(F.col("title")).alias("t")).join(f, F.contains(F.col("t"), F.col("p")), "left")
    place = F.struct(F.instr("t", F.col("p")), -F.length("p"), F.col("form"))
    return j.groupBy("title").agg(F.min_by("form", F.when(F.col("form").isNotNull(), place)).alias("form"))


def tier_of(part: Column, rule: Column, declared: Column, template: Column) -> Column:
    """A template's own "submitted" rule without a tier takes that of its Part; others keep theirs."""
    tiers = F.create_map(*[F.lit(x) for kv in PART_TIER.items() for x in kv])
    return F.when(declared.isNull() & (rule == F.concat(template, F.lit(".submitted"))), F.try_element_at(tiers, part)).otherwise(declared)


def correction_entries(requests: DataFrame) -> DataFrame:
    """(run_id, key, value) of a request: absent blanks the field, a moved page corrects the page. requests: run_id, key, value, present, page."""
    value = F.when(F.col("present") == False, F.lit(None).cast("string")).otherwise(F.col("value"))  # noqa: E712
    rows = F.array(F.struct(F.col("key").alias("key"), value.alias("value")), F.when(F.col("page").isNotNull(), F.struct(F.concat("key", F.lit("_page")).alias("key"), F.col("page").cast("string").alias("value"))))
    return requests.select("run_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def open_reviews(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'needs_review'")


def confirm_blockers(slots: DataFrame, references: DataFrame, items: DataFrame) -> DataFrame:
    """(letter, problem): required slots without a value, references without a slot, items without rules.

    slots: letter, name, required, value; references: letter, name; items: letter, rules.
    """
    empty = slots.where(F.col("required") & (F.coalesce("value", F.lit("")) == "")).select("letter", F.concat(F.lit("slot not filled: "), "name").alias("problem"))
    unknown = references.join(slots.select("letter", "name"), ["letter", "name"], "left_anti").select("letter", F.concat(F.lit("no such slot: "), "name").alias("problem"))
    bare = items.where("rules = 0").select("letter", F.lit("no rules").alias("problem"))
    return empty.unionByName(unknown).unionByName(bare)
