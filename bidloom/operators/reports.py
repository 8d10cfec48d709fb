"""What reviewers read: conclusions of a stage, records of offers, blockers of a draft; each as rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pricing import prose

#: How a tenderer's place in a stage is put.
VERBS = {"needs_review": "awaits a reviewer's decision on", "dormant": "has items the Authority may request:", "disqualified": "is not considered further:"}


def stage_conclusion(offers: DataFrame, label: str) -> DataFrame:
    """(project, conclusion): who passed a stage, who waits, who is out and for which items.

    offers: project, tenderer, status (null: the stage has no rules), items (array of struct<letter, title, status>).
    """
    status = F.coalesce("status", F.lit("pass"))
    named = F.transform(F.filter("items", lambda i: i["status"] == F.col("s")), lambda i: F.rtrim(F.concat(F.lit("item ("), i["letter"], F.lit(") "), F.coalesce(i["title"], F.lit("")))))
    verb = F.try_element_at(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv]), F.col("s"))
    line = F.concat("tenderer", F.lit(" "), verb, F.lit(" "), F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise("see the record"))
    df = offers.withColumn("s", status).withColumn("line", line)
    order = F.array_position(F.array(*map(F.lit, VERBS)), F.col("s"))
    by = df.groupBy("project").agg(
        F.count_if(F.col("status").isNotNull()).alias("n"), F.array_sort(F.collect_list(F.when(F.col("s") == "pass", F.col("tenderer")))).alias("passed"),
        F.array_sort(F.collect_list(F.when(F.col("s") != "pass", F.struct(order.alias("o"), "tenderer", "line")))).alias("rest"),
    )
    first = F.when(F.size("passed") > 0, F.array(F.concat(prose(F.col("passed")), F.lit(f" passed {label}")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(first, F.transform("rest", lambda r: r["line"]))
    return by.select("project", F.when(F.col("n") == 0, f"{label}: the rule set has no {label} rules.").otherwise(F.concat(F.lit(f"{label}: "), F.array_join(parts, "; "), F.lit("."))).alias("conclusion"))


def recommendation(rows: DataFrame, sign: str) -> DataFrame:
    """(project, line) for the recommended offer of each price table, with what it was chosen by; none where there is none."""
    by_ce = F.col("cost_effectiveness").isNotNull()
    amount = F.concat(F.lit(sign), F.format_number(F.coalesce("cost_effectiveness", "estimated"), 2))
    how = F.concat(F.when(by_ce, "a cost-effectiveness of ").otherwise("a total estimated amount of "), amount)
    best = rows.where("recommended").select("project", F.concat(F.lit("recommended acceptance of "), "tenderer", F.lit("'s offer with "), how, F.lit(".")).alias("line"))
    return rows.select("project").distinct().join(best, "project", "left").select("project", F.coalesce("line", F.lit("No offer is recommended.")).alias("line"))


def evaluation_record(verdicts: DataFrame, items: DataFrame, corrections: DataFrame) -> DataFrame:
    """A line per offer and item: run_id, letter, line. verdicts: run_id, letter, outcome, reasons; items: letter, title,
    part; corrections: run_id, letter, key, by."""
    name = F.replace(F.regexp_replace("key", r"^.*\.", ""), F.lit("_decision"), F.lit(" decided"))
    who = corrections.groupBy("run_id", "letter").agg(F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit(" by "), F.coalesce("by", F.lit("-"))))), "; ").alias("who"))
    j = verdicts.join(items, "letter", "left").join(who, ["run_id", "letter"], "left")
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    title = F.concat(F.lit("("), "letter", F.lit(") "), F.coalesce("title", F.lit("")))
    return j.select("run_id", "letter", F.concat_ws(" | ", title, dash(F.col("part")), dash(F.col("outcome")), dash(F.col("reasons")), dash(F.col("who"))).alias("line"))


def confirm_blockers(items: DataFrame, templates: DataFrame, slots: DataFrame, rules: DataFrame, gaps: DataFrame) -> DataFrame:
    """(letter, kind, what) of all that keeps a draft from being confirmed.

    items: letter, status, template, values (map of slot to value); templates: template, tiers (array); slots: template,
    name, required; rules: letter, rule_id, tier, outcomes, refs (array of slots it reads); gaps: node_id, reason. Kinds: an item
    that needs input or is a gap, an unknown template, an empty required slot, a tier that the template doesn't define, a
    slot that isn't declared, a gap without a reason.
    """
    row = lambda df, kind, what: df.select("letter", F.lit(kind).alias("kind"), what.alias("what"))
    known = templates.select("template", "tiers", F.lit(True).alias("known"))
    own = items.join(known, "template", "left")
    fine = own.where("known or template is null")
    out = row(items.where("status in ('needs_input', 'gap')"), "item_status", F.col("status"))
    out = out.unionByName(row(own.where("template is not null and known is null"), "unknown_template", F.col("template")))
    need = fine.join(slots.where("required"), "template").where(F.try_element_at("values", F.col("name")).isNull())
    out = out.unionByName(row(need, "empty_required_slot", F.col("name")))
    ruled = rules.join(fine.select("letter", "template", "tiers", "values"), "letter")
    odd = ruled.where("template is not null and tier is not null and outcomes is null").where(~F.array_contains("tiers", F.col("tier")))
    out = out.unionByName(row(odd, "unknown_tier", F.concat_ws(" ", "rule_id", "tier")))
    declared = slots.groupBy("template").agg(F.collect_set("name").alias("declared"))
    free = ruled.join(declared, "template", "left").withColumn("has", F.when(F.col("template").isNull(), F.map_keys(F.coalesce("values", F.create_map().cast("map<string,string>")))).otherwise(F.coalesce("declared", F.array().cast("array<string>"))))
    free = free.withColumn("missing", F.array_sort(F.array_except("refs", "has"))).where("size(missing) > 0")
    out = out.unionByName(row(free, "undeclared_slot", F.concat_ws(" ", "rule_id", F.array_join("missing", ", "))))
    return out.unionByName(gaps.where("coalesce(reason, '') = ''").select(F.lit(None).cast("string").alias("letter"), F.lit("gap_without_reason").alias("kind"), F.col("node_id").alias("what")))


def corrected_slot(old: Column, value: Column, user: Column) -> Column:
    """struct<value, model_value, origin, verified, by>: a person's value; the model's own survives every further correction.
    old: the same struct, null for a slot without a value."""
    kept = F.when(old.isNotNull(), F.when(old["origin"] == "manual", old["model_value"]).otherwise(old["value"]))
    verified = F.coalesce(old["verified"] & (old["value"] == value), F.lit(False))
    return F.struct(value.alias("value"), kept.alias("model_value"), F.lit("manual").alias("origin"), verified.alias("verified"), user.alias("by"))


def page_sets(expected: Column, read: Column) -> Column:
    """hit, within or miss: pages in common, and none beyond the expected ones."""
    return F.when(~F.arrays_overlap(expected, read), "miss").when(F.size(F.array_except(read, expected)) == 0, "within").otherwise("hit")


def unknown_keys(declared: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(declared, F.array(*map(F.lit, vocabulary))))
