"""The rule engine: presence, outcomes, comparisons, dependencies, overrides and roll-ups over tables.

rules: rule_id, field_id, check, tier, stage, parent (rule_id or null), outcomes (map of key to struct<status, note>, or
null), params (map of string to string, lists joined by a bar), letter, row_ord, and optionally label, steps (array of
struct<op, figures>) and entered_by; fields: run_id, field_id, value, and optionally the columns of FIELD. Rules are
metadata: at most MOST_RULES, which is checked before they are broadcast. Fields may be of any size: those of a run meet
once, as a map, so that a field without a row is a blank and inputs of other fields are looked up in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.text import once
from ..functions.vocab import INJECTED, NEGATIVE_KEYS, NEUTRAL_KEYS, POSITIVE_KEYS, SEVERITY

MOST_RULES = 100_000
#: What is known of a field beside its value; columns that a table of fields lacks are null.
FIELD = {
    "value": "string", "printed": "string", "redacted": "boolean", "corrected": "boolean", "verified": "boolean", "verify_note": "string",
    "located": "string", "decision": "string", "decided_by": "string", "decided_why": "string",
}
DECISIONS = ("pass", "dormant", "disqualified")


def few(rules: DataFrame) -> DataFrame:
    """rules with a broadcast hint, once a count has shown that they are metadata indeed."""
    counted(rules)
    return F.broadcast(rules)


def counted(rules: DataFrame) -> None:
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")


def presence(value: Column, redacted: Column) -> Column:
    """redacted, blank, not_applicable or filled; 0 and "nil" are filled."""
    v = F.trim(value.cast("string"))
    return F.when(F.coalesce(redacted, F.lit(False)), "redacted").when(v.isNull() | (v == ""), "blank").when(F.lower(v).isin("n/a", "na"), "not_applicable").otherwise("filled")


def severity(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), status), F.lit(0))


def worst(status: Column, only: Column | None = None) -> Column:
    """Aggregate: the most severe status; pass if there is none."""
    s = status if only is None else F.when(only, status)
    return F.coalesce(F.max_by(s, F.when(s.isNotNull(), severity(s))), F.lit("pass"))


def resolved_outcomes(rules: DataFrame, tiers: DataFrame) -> DataFrame:
    """A rule's own outcomes replace those of its tier as a whole; an unknown tier gives an empty map."""
    t = tiers.select("tier", F.col("outcomes").alias("of_tier"))
    return rules.join(t, "tier", "left").withColumn("outcomes", F.coalesce("outcomes", "of_tier", F.expr("cast(map() as map<string,struct<status:string,note:string>>)"))).drop("of_tier")


def first_declared(outcomes: Column, keys: tuple[str, ...]) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(outcomes, k)), F.lit(0))


def outcome_key(outcomes: Column, state: Column, bucket: Column | None = None, explicit: Column | None = None) -> Column:
    """Which declared outcome applies: explicit, redacted, not applicable, blank or neutral, the bucket's, filled; or null."""
    has = lambda k: F.map_contains_key(outcomes, F.lit(k))
    none = F.lit(None).cast("string")
    explicit, bucket = (none if x is None else x for x in (explicit, bucket))
    return F.coalesce(
        F.when(explicit.isNotNull() & F.map_contains_key(outcomes, F.coalesce(explicit, F.lit(""))), explicit),
        F.when((state == "redacted") & has("redacted"), "redacted"),
        F.when((state == "not_applicable") & has("not_applicable"), "not_applicable"),
        F.when((state == "blank") & has("blank"), "blank"),
        F.when(state == "blank", first_declared(outcomes, NEUTRAL_KEYS)),
        F.when(bucket == "positive", first_declared(outcomes, POSITIVE_KEYS)).when(bucket == "negative", first_declared(outcomes, NEGATIVE_KEYS)).when(bucket == "neutral", first_declared(outcomes, NEUTRAL_KEYS)),
        F.when((state == "filled") & has("filled"), "filled"),
    )



def rendered(param: Column, slots: Column) -> Column:
    """A parameter that is exactly {slot} becomes the slot's value, null if it is missing."""
    ref = F.regexp_extract(param, r"^\{([a-z][a-z0-9_]*)\}$", 1)
    return F.when(ref == "", param).otherwise(F.try_element_at(slots, ref))


def slot_refs(params: Column) -> Column:
    return F.array_remove(F.transform(F.map_values(params), lambda p: F.regexp_extract(p, r"^\{([a-z][a-z0-9_]*)\}$", 1)), "")


def switched_off(rules: DataFrame, slots: DataFrame) -> DataFrame:
    """Rules all of whose slots are optional and empty. slots: name, required, value."""
    unset = slots.where(~F.col("required") & (F.coalesce("value", F.lit("")) == "")).agg(F.collect_set("name").alias("unset"))
    refs = rules.withColumn("refs", slot_refs(F.col("params"))).where(F.size("refs") > 0)
    return refs.crossJoin(F.broadcast(unset)).where(F.size(F.array_except("refs", "unset")) == 0).drop("refs", "unset")


def excluded(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids, "rule_id", "left_anti")


def parsed(params: Column) -> Column:
    """The params of a comparison as values, read once for each rule and not for each row."""
    p = lambda k: F.try_element_at(params, F.lit(k))
    listed = lambda x: F.transform(F.filter(F.split(x, r"\|"), lambda u: F.trim(u) != ""), lambda u: F.struct(u.alias("text"), text.padded(u).alias("key")))
    unread = lambda raw: (F.coalesce(raw, F.lit("")) != "") & dates.parse_date(raw).isNull()
    return F.struct(
        p("expected").alias("expected"), text._number(p("min")).alias("lo"), text._number(p("max")).alias("hi"), text._number(p("max_decimals")).alias("places"),
        listed(F.coalesce(p("allowed"), p("expected"))).alias("units"), listed(F.coalesce(p("phrases"), p("phrase"), p("text"), p("expected"))).alias("phrases"),
        F.coalesce(text.flag(p("absent")), F.lit(False)).alias("absent"), dates.parse_date(p("after")).alias("after"), dates.parse_date(p("before")).alias("before"),
        (F.coalesce(unread(p("after")), F.lit(False)) | F.coalesce(unread(p("before")), F.lit(False))).alias("unread"),
        F.coalesce(p("op"), F.lit("product")).alias("op"), text._number(p("tolerance")).alias("tolerance"),
    )


def judged(kind: Column, value: Column, printed: Column, corrected: Column, p: Column, first: Column, second: Column, other: Column, asked: set[str] | None = None) -> Column:
    """struct<result, detail> of a comparison: match, mismatch or unstated; null for presence kinds and without a value.

    p: as parsed; first and second: the math check's inputs; other: what the other document prints; asked: the kinds that
    can occur, where that is known.
    """
    said = lambda ok: F.when(ok, "match").otherwise("mismatch")
    answer = lambda result, *detail: F.struct((F.lit(result) if isinstance(result, str) else result).alias("result"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in detail]).alias("detail"))
    read = lambda x: F.concat(F.lit("read '"), x, F.lit("'"))
    quoted = lambda xs: F.concat(F.lit("'"), F.array_join(xs["text"], "', '"), F.lit("'"))
    none = lambda xs: F.coalesce(F.size(xs), F.lit(0)) <= 0

    def ranged(q: Column) -> Column:
        lo, hi, places, shown, n, written = p["lo"], p["hi"], p["places"], q["shown"], q["n"], q["written"]
        bounds = F.when(lo.isNull(), F.concat(F.lit("at most "), text.plain(hi))).when(hi.isNull(), F.concat(F.lit("at least "), text.plain(lo))).otherwise(F.concat(text.plain(lo), F.lit(" to "), text.plain(hi)))
        return (
            F.when(written > places, answer("mismatch", read(shown), ", ", written.cast("string"), " decimal places, at most ", text.plain(places)))
            .when(places.isNotNull() & lo.isNull() & hi.isNull(), answer("match", read(shown), F.when(written.isNull(), ", no figure").otherwise(F.concat(F.lit(", at most "), text.plain(places), F.lit(" decimal places")))))
            .when(n.isNull(), answer("mismatch", F.concat(F.lit("'"), shown, F.lit("' is not a number"))))
            .when(lo.isNull() & hi.isNull(), answer("unstated", "no bounds to compare with"))
            .otherwise(answer(said((lo.isNull() | (n >= lo)) & (hi.isNull() | (n <= hi))), read(shown), ", allowed ", bounds))
        )

    def held(q: Column) -> Column:
        return (
            F.when(p["absent"] & (F.size(q["found"]) > 0), answer("mismatch", read(q["page"]), ", which should not contain ", quoted(F.slice(q["found"], 1, 1))))
            .when(p["absent"], answer("match", read(q["page"]), ", none of ", quoted(p["phrases"])))
            .when(F.size(q["found"]) < F.size(p["phrases"]), answer("mismatch", read(q["page"]), ", missing ", quoted(F.array_except(p["phrases"], q["found"]))))
            .otherwise(answer("match", read(q["page"]), ", looked for ", quoted(p["phrases"])))
        )

    def dated(day: Column, shown: Column) -> Column:
        return (
            F.when(day.isNull(), answer("mismatch", F.concat(F.lit("'"), shown, F.lit("' is not a date"))))
            .when(p["unread"], answer("unstated", "a bound is not a date a person has confirmed"))
            .when(day < p["after"], answer("mismatch", day.cast("string"), " is before ", p["after"].cast("string")))
            .when(day > p["before"], answer("mismatch", day.cast("string"), " is after ", p["before"].cast("string")))
            .otherwise(answer("match", day.cast("string")))
        )

    def summed(q: Column) -> Column:
        slack = F.coalesce(p["tolerance"], F.greatest(F.lit(0.01), 0.005 * F.abs(q["due"])))
        return (
            F.when(q["a"].isNull() | q["b"].isNull() | q["n"].isNull(), answer("unstated", "an input is blank or not a number"))
            .when(q["due"].isNull(), answer("unstated", "unknown operation '", p["op"], "'"))
            .otherwise(answer(said(F.abs(q["n"] - q["due"]) <= slack), "read ", text.plain(q["n"]), ", the ", p["op"], " is ", text.plain(q["due"])))
        )

    def by_kind(t: Column) -> Column:
        v, page, shown = t["value"], t["page"], t["shown"]
        inside = lambda at: lambda x: (x["key"] != "  ") & F.contains(at, x["key"])

        def numbers() -> Column:
            a, b = text._number(first), text._number(second)
            return once(F.struct(a.alias("a"), b.alias("b"), text._number(v).alias("n")), lambda q: F.struct(q["a"].alias("a"), q["b"].alias("b"), q["n"].alias("n"), F.when(p["op"] == "product", q["a"] * q["b"]).when(p["op"] == "sum", q["a"] + q["b"]).alias("due")))

        kinds = {
            "value": lambda: F.when(p["expected"].isNull(), answer("unstated", "no expected value to compare with")).otherwise(answer(said(text.equal(v, p["expected"])), read(shown), ", expected '", p["expected"], "'")),
            "range": lambda: once(F.struct(shown.alias("shown"), text._number(v).alias("n"), F.when(p["places"].isNotNull(), F.array_max(text.decimal_places(shown))).alias("written")), ranged),
            "unit": lambda: F.when(none(p["units"]), answer("unstated", "no unit to compare with")).otherwise(once(text.padded(page), lambda at: answer(said(F.exists(p["units"], inside(at))), read(page), ", allowed ", F.array_join(p["units"]["text"], ", ")))),
            "contains": lambda: F.when(none(p["phrases"]), answer("unstated", "no phrase to look for")).otherwise(once(F.struct(page.alias("page"), once(text.padded(page), lambda at: F.filter(p["phrases"], inside(at))).alias("found")), held)),
            "date": lambda: once(dates.parse_date(shown), lambda day: dated(day, shown)),
            "math": lambda: once(numbers(), summed),
            "cross_document_match": lambda: F.when(other.isNull(), answer("unstated", "the other field is blank")).otherwise(answer(said(text.agree(shown, other)), read(shown), ", the other reads '", other, "'")),
            "human_only": lambda: answer("unstated", "a reviewer decides; no automated check"),
        }
        out = F.when(v.isNull(), F.lit(None).cast("struct<result:string,detail:string>"))
        for k, made in kinds.items():
            if asked is None or k in asked:
                out = out.when(kind == k, made())
        return out

    on_page = F.coalesce(printed, value)
    return once(F.struct(value.alias("value"), on_page.alias("page"), F.when(F.coalesce(corrected, F.lit(False)), value).otherwise(on_page).alias("shown")), by_kind)


def compare(kind: Column | str, value: Column, printed: Column, corrected: Column, params: Column, first: Column | None = None, second: Column | None = None, other: Column | None = None) -> Column:
    """match, mismatch or unstated of one comparison with params as they are written; kind: a column, or the one kind."""
    none = F.lit(None).cast("string")
    first, second, other = (none if x is None else x for x in (first, second, other))
    return once(parsed(params), lambda p: judged(kind if isinstance(kind, Column) else F.lit(kind), value, printed, corrected, p, first, second, other, None if isinstance(kind, Column) else {kind}))["result"]


#: "a - b" with a hyphen, a dash or "to".
_SPAN = r"(\d[\d,]*(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d[\d,]*(?:\.\d+)?)"


def _ends(printed: Column) -> tuple[Column, Column]:
    return text._number(F.regexp_extract(printed, _SPAN, 1)), text._number(F.regexp_extract(printed, _SPAN, 2))


def nothing_words(value: Column, words: Column, corrected: Column) -> Column:
    """blank, unstated or kept: an answer that is a word for nothing is blank; one that opens with it says more."""
    keys = F.transform(words, lambda w: text.blank_key(w))

    def said(key: Column) -> Column:
        opens = F.exists(keys, lambda w: (w != "") & key.startswith(F.concat(w, F.lit(" "))))
        return F.when((key == "") | F.array_contains(keys, key), "blank").when(F.coalesce(corrected, F.lit(False)), "kept").when(opens, "unstated").otherwise("kept")

    return F.when(value.isNull(), "kept").otherwise(once(text.blank_key(value), said))


def normalised_steps(value: Column, steps: Column) -> Column:
    """Numeric steps in order, each on the last one's result. steps: array of struct<op, figures>.

    A range is resolved to its lower end where the text holds one; null where there is no number.
    """
    from ..functions.numbers import significant_any

    def fold(q: Column) -> Column:
        step = lambda acc, s: F.when(s["op"] == "round_significant_figures", significant_any(acc, s["figures"])).when(s["op"] == "resolve_range_to_lower_bound", F.coalesce(q["low"], acc)).otherwise(acc)
        return F.aggregate(steps, q["n"], step)

    a, b = _ends(value)
    low = F.when(~text.bare_number(value) & a.isNotNull() & b.isNotNull(), F.least(a, b))
    return once(F.struct(text._number(value).alias("n"), low.alias("low")), fold)


def range_low_end(value: Column, printed: Column, corrected: Column) -> Column:
    """The lower end of "a - b" as printed, if the value is one of its ends and nobody corrected it."""
    v, (a, b) = text._number(value), _ends(printed)
    return F.when(~F.coalesce(corrected, F.lit(False)) & ((v == a) | (v == b)), F.least(a, b)).otherwise(v)


def as_read(field: Column, chain: Column) -> Column:
    """struct<value, printed, corrected, failed> of a field after the answers for nothing and the steps of its rules.

    field: struct of FIELD, null for a field without a row; chain: array of struct<rule_id, words, steps> in the order
    of rules. First every rule's words for nothing, then every rule's steps, each on what the one before left; failed
    lists the rules that could not settle the field.
    """
    corrected = F.coalesce(field["corrected"], F.lit(False))

    def state(value: Column, printed: Column, failed: Column) -> Column:
        return F.struct(value.alias("value"), printed.alias("printed"), failed.alias("failed"))

    def blank(a: Column, r: Column) -> Column:
        put = lambda found: state(F.when(found != "blank", a["value"]), a["printed"], F.when(found == "unstated", F.array_append(a["failed"], r["rule_id"])).otherwise(a["failed"]))
        return once(F.when(r["words"].isNotNull(), nothing_words(a["value"], r["words"], corrected)).otherwise("kept"), put)

    def steps(a: Column, r: Column) -> Column:
        def settle(q: Column) -> Column:
            # A bare number that is one end of a printed range was read from that range.
            at_end = (F.get(r["steps"], F.lit(0))["op"] == "resolve_range_to_lower_bound") & q["bare"] & ~corrected & ((q["n"] == q["lo"]) | (q["n"] == q["hi"]))
            new = once(F.when(F.coalesce(at_end, F.lit(False)), a["printed"]).otherwise(a["value"]), lambda v: normalised_steps(v, r["steps"]))
            return once(new, lambda x: put(q, x))

        def put(q: Column, new: Column) -> Column:
            same = q["bare"] & (new == q["n"])
            return (
                F.when(new.isNull(), state(a["value"], a["printed"], F.array_append(a["failed"], r["rule_id"])))
                .when(same, a)
                .otherwise(state(text.plain(new), F.when(q["bare"], a["printed"]).otherwise(F.coalesce(a["printed"], a["value"])), a["failed"]))
            )

        lo, hi = _ends(a["printed"])
        read = F.struct(text._number(a["value"]).alias("n"), text.bare_number(a["value"]).alias("bare"), lo.alias("lo"), hi.alias("hi"))
        return F.when((F.coalesce(F.size(r["steps"]), F.lit(0)) <= 0) | a["value"].isNull(), a).otherwise(once(read, settle))

    start = state(field["value"], field["printed"], F.array().cast("array<string>"))
    return F.when(F.size(chain) > 0, F.aggregate(chain, F.aggregate(chain, start, blank), steps)).otherwise(start)


def scoped(rules: DataFrame) -> list[str]:
    """The column that tells rule sets apart, where rules have one: then rule ids and letters are theirs."""
    return ["ruleset"] if "ruleset" in rules.columns else []


def _pairs(rules: DataFrame) -> dict[tuple, tuple | None]:
    """(rule set or nothing, rule) to evaluable parent, and no parent where it isn't evaluable."""
    rows = rules.select(*scoped(rules), "rule_id", "parent", "evaluable").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    key = lambda r, c: (*r[:-3], r[c])
    open_ = {key(r, "rule_id") for r in rows if r["evaluable"]}
    return {key(r, "rule_id"): key(r, "parent") if key(r, "parent") in open_ else None for r in rows}


def cyclic(rules: DataFrame) -> DataFrame:
    """Rules that are their own ancestor. rules: rule_id, parent."""
    parents = _pairs(rules.select(*scoped(rules), "rule_id", "parent", F.lit(True).alias("evaluable")))
    found = []
    for rule in parents:
        at, seen = parents[rule], set()
        while at is not None and at != rule and at not in seen:
            seen.add(at)
            at = parents.get(at)
        found += [rule] if at == rule else []
    return rules.sparkSession.createDataFrame(found, _ids(rules))


def _ids(rules: DataFrame) -> str:
    return "".join(f"{c} {rules.schema[c].dataType.simpleString()}, " for c in scoped(rules)) + "rule_id string"


def ancestors(rules: DataFrame) -> DataFrame:
    """(rule_id, ancestor), of each rule set, over evaluable parents, however many; one that isn't evaluable ends the chain, a cycle raises."""
    parents, out = _pairs(rules), []
    for rule in parents:
        at, seen = parents[rule], set()
        while at is not None:
            if at in seen or at == rule:
                raise ValueError(f"the rules above {rule[-1]} form a cycle")
            seen.add(at)
            at = parents.get(at)
        out += [(*rule, x[-1]) for x in seen]
    return rules.sparkSession.createDataFrame(out, f"{_ids(rules)}, ancestor string")


def resolution_order(rules: DataFrame) -> list[str]:
    """Rule ids, each after what it depends on, in the order given otherwise."""
    parents, out = _pairs(rules.withColumn("evaluable", F.lit(True))), {}
    for rule in parents:
        chain = []
        while rule is not None and rule not in out:
            if rule in chain:
                raise ValueError(f"the rules above {rule[-1]} form a cycle")
            chain.append(rule)
            rule = parents.get(rule)
        out |= dict.fromkeys(reversed(chain))
    return [r[-1] for r in out]


def visible(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows all of whose evaluable ancestors have a row that is neither disqualified nor dormant.

    No order of evaluation: a rule's own result never depends on its parent. A run has at most one row per rule, so its
    rows fit one array, and one aggregation by run suffices; rules are a few hundred.
    """
    keys = [*scoped(rules), "rule_id"]
    anc = F.broadcast(ancestors(rules).groupBy(*keys).agg(F.collect_set("ancestor").alias("_above")))
    wide = rows.join(anc, keys, "left").groupBy("run_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "run_id"], "_above")).alias("_r"))
    open_ = F.transform(F.filter("_r", lambda r: ~r["status"].isin("disqualified", "dormant")), lambda r: r["rule_id"])
    kept = F.filter("_r", lambda r: F.coalesce(F.size(F.array_except(r["_above"], F.col("_open"))) == 0, F.lit(True)))
    return wide.withColumn("_open", open_).select("run_id", F.inline(kept)).select(*rows.columns)


def bundled(fields: DataFrame) -> DataFrame:
    """run_id and f: the map of its fields. A run has some hundred fields; they meet by one shuffle on run_id."""
    columns = [F.col(c).cast(k).alias(c) if c in fields.columns else F.lit(None).cast(k).alias(c) for c, k in FIELD.items()]
    return fields.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", F.struct(*columns).alias("x")))).alias("f"))


def compiled(rules: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Rules with what their rows need: params with slots filled in and parsed, qualified inputs, and the chains of rules
    that normalise the fields they read, all within a rule set where there are several. slots: letter, name, value, and
    ruleset where rules have it."""
    of = scoped(rules)
    have = lambda c, kind: F.col(c) if c in rules.columns else F.lit(None).cast(kind)
    r = rules.withColumns({"letter": F.coalesce(have("letter", "string"), F.lit("")), "row_ord": have("row_ord", "int"), "steps": F.coalesce(have("steps", "array<struct<op:string,figures:int>>"), F.array().cast("array<struct<op:string,figures:int>>"))})
    if slots is not None:
        by = slots.groupBy(*of, "letter").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_slots"))
        r = r.join(by, [*of, "letter"], "left").withColumn("params", F.transform_values("params", lambda k, v: rendered(v, F.coalesce("_slots", F.create_map().cast("map<string,string>"))))).drop("_slots")
    prefix = F.regexp_replace("field_id", r"\.?[^.]*$", "")
    named = lambda x: F.when(x.isNull(), None).when(F.contains(x, F.lit(".")) | (prefix == ""), x).otherwise(F.concat(prefix, F.lit("."), x))
    inputs = F.split(F.try_element_at("params", F.lit("inputs")), r"\|")
    words = F.try_element_at("params", F.lit("blank_if"))
    name = F.replace(F.regexp_replace("field_id", r"^.*\.", ""), F.lit("_"), F.lit(" "))
    r = r.select(
        *of, "rule_id", "field_id", F.coalesce(have("label", "string"), name).alias("label"), "check", F.col("stage"), "letter", "row_ord", "parent", "outcomes", "tier" if "tier" in rules.columns else F.lit(None).cast("string").alias("tier"),
        parsed(F.col("params")).alias("p"), prefix.alias("prefix"), named(F.get(inputs, F.lit(0))).alias("first"), named(F.get(inputs, F.lit(1))).alias("second"),
        named(F.coalesce(F.try_element_at("params", F.lit("other")), F.try_element_at("params", F.lit("field")))).alias("other"),
        have("entered_by", "string").alias("entered_by"), F.struct("rule_id", F.when(words.isNotNull(), F.split(words, r"\|")).alias("words"), "steps").alias("own"),
    )
    chains = r.where("own.words is not null or size(own.steps) > 0").groupBy(*of, "letter", "field_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "own"))), lambda x: x["own"]).alias("chain"))
    for key, to in (("field_id", "chain"), ("first", "chain_first"), ("second", "chain_second"), ("other", "chain_other")):
        r = r.join(chains.select(*of, "letter", F.col("field_id").alias(key), F.col("chain").alias(to)), [*of, "letter", key], "left")
        r = r.withColumn(to, F.coalesce(to, F.array().cast(chains.schema["chain"].dataType)))
    return r.drop("own")


def met(fields: DataFrame, r: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Each run's fields, as f, with each rule that it has to meet.

    Without runs there is one rule set for all, of MOST_RULES at most. With runs (run_id, ruleset) each meets the rules of its own: these are packed
    into one row for each rule set, joined by equality and spread out afterwards, so rules of other projects cost
    nothing and a rule set that a third of all runs share is split like any skewed key. Runs without fields meet theirs too.
    """
    if runs is None:
        return bundled(fields).crossJoin(F.broadcast(r))
    packed = r.groupBy("ruleset").agg(F.collect_list(F.struct(*[c for c in r.columns if c != "ruleset"])).alias("_rules"))
    none = F.create_map().cast(bundled(fields).schema["f"].dataType)
    df = runs.select("run_id", "ruleset").join(bundled(fields), "run_id", "left").join(packed, "ruleset")
    return df.select("run_id", "ruleset", F.coalesce("f", none).alias("f"), F.inline("_rules"))


def evaluated(fields: DataFrame, rules: DataFrame, slots: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """A row for each run and rule that says something: run_id, rule_id, field_id, field, letter, row_ord, status, note,
    stage, redacted, value, and what overrides ask for. rules: with resolved outcomes; with a column ruleset, runs tells
    which one each run is held against, and rows have it too.

    A field without a row is a blank. No outcomes: no row. No key and a blank field: no row. No key otherwise:
    needs_review. A value at `<rule_id>__outcome` chooses the outcome, where no comparison does.
    """
    if (runs is not None) != bool(scoped(rules)):
        raise ValueError("rules have a column ruleset if and only if runs say which rule set is theirs")
    if runs is None:
        counted(rules)
    kinds = rules.select("check", F.map_contains_key("params", F.lit("blank_if")).alias("w"), (F.size("steps") > 0 if "steps" in rules.columns else F.lit(False)).alias("s")).distinct().collect()
    asked, chained = {k["check"] for k in kinds}, any(k["w"] or k["s"] for k in kinds)
    df = met(fields, compiled(rules.where(F.size("outcomes") > 0), slots), runs)
    at = lambda k: F.try_element_at("f", k)
    # Without rules that normalise, fields are as they were read.
    plain = lambda x: F.struct(x["value"].alias("value"), x["printed"].alias("printed"), F.array().cast("array<string>").alias("failed"))
    seen = (lambda x, chain: as_read(x, F.col(chain))) if chained else (lambda x, chain: plain(x))
    df = df.withColumn("x", at(F.col("field_id"))).withColumn("own", once(F.col("x"), lambda x: seen(x, "chain")))
    first, second = (seen(at(F.col(k)), f"chain_{k}")["value"] for k in ("first", "second"))
    other = once(at(F.col("other")), lambda o: F.when(seen(o, "chain_other")["value"].isNotNull(), F.coalesce(o["printed"], o["value"])))
    failed = F.array_contains("own.failed", F.col("rule_id"))
    unread = F.struct(F.lit("unstated").alias("result"), F.concat(F.lit("'"), F.col("own.value"), F.lit("' could not be settled; a reviewer corrects it")).alias("detail"))
    said = once(F.col("own"), lambda o: judged(F.col("check"), o["value"], o["printed"], F.col("x.corrected"), F.col("p"), first, second, other, asked))
    df = df.withColumn("said", F.when(failed, unread).otherwise(said))
    df = df.withColumn("state", presence(F.col("own.value"), F.col("x.redacted")))
    outcomes = F.col("outcomes")
    key = F.coalesce("said.result", once(F.col("state"), lambda s: outcome_key(outcomes, s, explicit=at(F.concat("rule_id", F.lit("__outcome")))["value"])))
    df = df.withColumn("key", key)
    declared = F.try_element_at(outcomes, F.coalesce("key", F.lit("")))
    injected = F.element_at(F.create_map(*[F.lit(x) for kv in INJECTED.items() for x in kv]), F.col("said.result"))
    status = F.coalesce(F.when(F.col("said.result").isNotNull(), injected).otherwise(declared["status"]), F.lit("needs_review"))
    none = F.concat("label", F.lit(" reads '"), F.coalesce("own.value", F.lit("")), F.lit("', an answer this rule has no outcome for; a reviewer decides"))
    note = F.when(F.col("said.result").isNotNull(), F.concat("label", F.lit(": "), "said.detail")).when(F.col("key").isNull(), none).otherwise(text.filled_note(declared["note"], "label"))
    form = at(F.concat("prefix", F.lit(".document")))["value"]
    row = F.struct(
        "rule_id", "field_id", F.col("label").alias("field"), "letter", "row_ord", status.alias("status"), note.alias("note"), F.coalesce("stage", F.lit("I")).alias("stage"),
        F.coalesce(F.col("key") == "redacted", F.lit(False)).alias("redacted"), F.col("own.value").alias("value"), F.col("x").isNotNull().alias("read"), "x", "entered_by", "tier",
        (form.isNotNull() & (F.lower(form) != "false")).alias("form_there"),
    )
    # A filter would be pushed below the comparison and repeat it; a generator isn't.
    return df.select("run_id", *scoped(rules), F.inline(F.when(F.col("key").isNotNull() | (F.col("state") != "blank"), F.array(row))))


def overridden(status: Column, verified: Column, key_present: Column, page_present: Column, by_reviewer: Column, decision: Column, form_present: Column, corrected: Column, redacted: Column, blank: Column, located: Column) -> Column:
    """The overrides in their order: verification, unextracted, reviewer's blanks, unread blanks, decisions."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    s = F.when((verified == False) & status.isin("pass", "disqualified"), "needs_review").otherwise(status)  # noqa: E712
    s = F.when(~yes(key_present) & ~yes(page_present), "needs_review").otherwise(s)
    s = F.when(yes(by_reviewer) & yes(blank), "dormant").otherwise(s)
    unread = yes(blank) & ~yes(corrected) & ~yes(redacted) & ~yes(by_reviewer) & (yes(form_present) | yes(located))
    s = F.when(unread & (s == "disqualified"), "needs_review").otherwise(s)
    return F.when((s == "needs_review") & decision.isin("pass", "dormant", "disqualified"), decision).otherwise(s)


def after_engine(rows: DataFrame) -> DataFrame:
    """What code does after the rules, in its order, with its reasons: unverified and unextracted values, what a reviewer
    enters later, blanks on forms that are there, decisions. rows: as evaluated (and visible)."""
    x, value = F.col("x"), F.col("x.value")
    blank = value.isNull() | (F.trim(value) == "")
    name = F.regexp_replace("field_id", r"^.*\.", "")
    untouched = ~F.coalesce(x["corrected"], F.lit(False))
    put = lambda df, when, status, note: df.withColumn("_w", F.coalesce(when, F.lit(False))).withColumns({"status": F.when(F.col("_w"), status).otherwise(F.col("status")), "note": F.when(F.col("_w"), note).otherwise(F.col("note"))}).drop("_w")
    df = put(rows, (x["verified"] == False) & F.col("status").isin("pass", "disqualified"), F.lit("needs_review"), F.concat(F.lit("unverified: "), F.coalesce(x["verify_note"], F.lit("the two readings differ"))))  # noqa: E712
    df = put(df, ~F.col("read"), F.lit("needs_review"), F.concat(F.lit("unextracted: no form reads "), "field", F.lit("; a reviewer decides")))
    df = put(df, (F.col("entered_by") == "reviewer") & value.isNull(), F.lit("dormant"), F.concat("field", F.lit(REVIEWER_NOTE)))
    df = put(df, (F.col("status") == "disqualified") & (name != "document") & blank & F.col("form_there") & untouched & ~F.coalesce(x["redacted"], F.lit(False)), F.lit("needs_review"), F.concat("field", F.lit(": nothing was read here on a form that is there; a reviewer confirms before it disqualifies")))
    df = put(df, (F.col("status") == "disqualified") & (name == "document") & blank & x["located"].isNotNull() & untouched, F.lit("needs_review"), F.concat("field", F.lit(": pages were found for this form ("), x["located"], F.lit(") but the reading says it is not there; a reviewer confirms before it disqualifies")))
    decided = (F.col("status") == "needs_review") & x["decision"].isin(*DECISIONS)
    note = F.concat(F.lit("decided by "), F.coalesce(x["decided_by"], F.lit("a reviewer")), F.lit(": "), F.coalesce(x["decided_why"], F.lit("no reason given")))
    return put(df, decided, x["decision"], note)


REVIEWER_NOTE = " is entered by a reviewer once it arrives; not recorded yet"


def with_reviewer_rows(rows: DataFrame, fields: DataFrame, rules: DataFrame) -> DataFrame:
    """rows and a dormant one for each blank field that a reviewer enters and that has none, unless its rule's parent has
    no row, or one that is dormant or disqualified."""
    r = few(compiled(rules.where("entered_by = 'reviewer'")))
    parents = few(rules.select(F.col("rule_id").alias("parent"), F.col("field_id").alias("parent_field")))
    have = rows.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", "status"))).alias("have"))
    b = bundled(fields).join(have, "run_id", "left").withColumn("have", F.coalesce("have", F.create_map().cast("map<string,string>")))
    df = b.crossJoin(r).join(parents, "parent", "left").withColumn("x", F.try_element_at("f", F.col("field_id")))
    above = F.try_element_at("have", F.col("parent_field"))
    open_ = F.col("parent_field").isNull() | (above.isNotNull() & ~above.isin("dormant", "disqualified"))
    df = df.where(F.col("x.value").isNull() & ~F.map_contains_key("have", F.col("field_id")) & open_)
    made = {"field": F.col("label"), "status": F.lit("dormant"), "note": F.concat("label", F.lit(REVIEWER_NOTE)), "redacted": F.lit(False), "value": F.lit(None).cast("string"), "read": F.col("x").isNotNull(), "form_there": F.lit(False), "stage": F.coalesce("stage", F.lit("I"))}
    return rows.unionByName(df.withColumns(made).select(*rows.columns))


def blocked_items(items: DataFrame, rules: DataFrame, templates: DataFrame, tiers: DataFrame) -> DataFrame:
    """(letter, reason) of items that no rules can decide: without rules, without their template, or with a tier that it
    doesn't define. items: letter, template; rules: letter, rule_id, row_ord, tier, outcomes; templates: template; tiers:
    template, tier."""
    own = rules.select("letter", "rule_id", "row_ord", "tier", (F.col("tier").isNotNull() & F.col("outcomes").isNull()).alias("asks"))
    known = templates.select("template", F.lit(True).alias("known")).distinct()
    j = items.join(own, "letter", "left").join(known, "template", "left").join(tiers.select("template", "tier", F.lit(True).alias("defined")).distinct(), ["template", "tier"], "left")
    by = j.groupBy("letter", "template").agg(
        F.count("rule_id").alias("rules"), F.max("known").alias("known"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"),
        F.min(F.when(F.col("asks") & F.col("defined").isNull(), F.struct("row_ord", "rule_id", "tier"))).alias("bad"),
    )
    item = F.concat(F.lit("item ("), "letter", F.lit(")"))
    reason = (
        F.when(F.col("rules") == 0, F.concat(item, F.lit(" has no rules; a reviewer decides")))
        .when(F.col("template").isNotNull() & F.col("known").isNull() & F.col("asks"), F.concat(item, F.lit(": template '"), "template", F.lit("' is not in the library, so its rules have no outcomes; a reviewer decides")))
        .when(F.col("known") & F.col("bad").isNotNull(), F.concat(item, F.lit(": rule "), "bad.rule_id", F.lit(" names tier '"), "bad.tier", F.lit("', which template '"), "template", F.lit("' does not define; a reviewer decides")))
    )
    return by.select("letter", reason.alias("reason")).where("reason is not null")


def off_reasons(rules: DataFrame, slots: DataFrame) -> DataFrame:
    """(letter, reasons) of the rules that are switched off. rules: letter, rule_id, row_ord, params."""
    off = switched_off(rules, slots).withColumn("names", F.array_join(F.array_sort(slot_refs(F.col("params"))), ", "))
    line = F.concat(F.lit("rule "), "rule_id", F.lit(" not checked: the tender sets no "), "names")
    return off.groupBy("letter").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", line.alias("line")))), lambda x: x["line"]).alias("off"))


def completed_verdicts(verdicts: DataFrame, runs: DataFrame, items: DataFrame, blocked: DataFrame, off: DataFrame) -> DataFrame:
    """item_verdicts for every run and item: those without rows pass, blocked ones need review, and the reasons of rules
    that are switched off follow the others. runs: run_id; items: letter."""
    every = runs.select("run_id").distinct().crossJoin(few(items.select("letter").distinct().join(blocked, "letter", "left").join(off, "letter", "left")))
    df = every.join(verdicts, ["run_id", "letter"], "left")
    stop, zero = F.col("reason").isNotNull(), F.lit(0).cast("long")
    reasons = F.filter(F.concat(F.array("reasons"), F.coalesce("off", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    return df.select(
        "run_id", "letter", F.when(stop, "needs_review").otherwise(F.coalesce("outcome", F.lit("pass"))).alias("outcome"), F.when(stop, "needs_review").otherwise(F.coalesce("worst", F.lit("pass"))).alias("worst"),
        *[F.when(stop, zero).otherwise(F.coalesce(f"n_{k}", zero)).alias(f"n_{k}") for k in SEVERITY], F.when(stop, F.col("reason")).otherwise(F.array_join(reasons, "; ")).alias("reasons"),
    )


def follow_ups(rows: DataFrame, fields: DataFrame, tiers: DataFrame) -> DataFrame:
    """(run_id, rule_id, deadline) of dormant rows whose tier sets one: so many days after the rule's own base date, or
    after the authority's request. tiers: tier, op (add_working_days or add_calendar_days), days."""
    base = lambda k: dates.parse_date(F.try_element_at("f", k)["value"])
    df = rows.where("status = 'dormant'").join(few(tiers.select("tier", "op", "days")), "tier").join(bundled(fields), "run_id")
    day = F.coalesce(base(F.concat("rule_id", F.lit("__base_date"))), base(F.lit("authority_request_date")))
    due = F.when(F.col("op") == "add_working_days", dates.add_working_days_by(day, F.col("days"))).when(F.col("op") == "add_calendar_days", F.date_add(day, F.col("days")))
    return df.select("run_id", "rule_id", due.alias("deadline"))


def adjustments(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(run_id, rule_id, field_id, was, value): what the steps of a rule made of a field's value, where that changed it."""
    r = few(compiled(rules).where("size(filter(chain, c -> c.rule_id = rule_id and size(c.steps) > 0)) > 0"))
    df = bundled(fields).crossJoin(r).withColumn("x", F.try_element_at("f", F.col("field_id")))
    df = df.withColumn("new", once(F.col("x"), lambda x: as_read(x, F.col("chain"))["value"]))
    row = F.struct("rule_id", "field_id", F.col("x.value").alias("was"), F.col("new").alias("value"))
    return df.select("run_id", F.inline(F.when(F.col("new").isNotNull() & (F.col("new") != F.col("x.value")), F.array(row))))


def item_verdicts(rows: DataFrame) -> DataFrame:
    """Per run and letter: outcome over what isn't dormant, dormant if all is, worst, counts of all statuses, reasons in order."""
    s = F.col("status")
    live = s != "dormant"
    return rows.groupBy("run_id", "letter").agg(
        F.when(F.count_if(live) > 0, worst(s, live)).when(F.count("*") > 0, "dormant").otherwise("pass").alias("outcome"),
        worst(s).alias("worst"),
        *[F.count_if(s == k).alias(f"n_{k}") for k in SEVERITY],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(s != "pass", F.struct("row_ord", "note")))), lambda x: x["note"]), "; ").alias("reasons"),
    )


def stage_summary(rows: DataFrame) -> DataFrame:
    """Per run and stage: items at the stage by worst live status, and the stage's outcome: two levels, both partial."""
    s, live = F.col("status"), F.col("status") != "dormant"
    items = rows.groupBy("run_id", "stage", "letter").agg(F.when(F.count_if(live) > 0, worst(s, live)).otherwise("dormant").alias("status"))
    return items.groupBy("run_id", "stage").agg(
        F.when(F.count_if(live) > 0, worst(s, live)).otherwise("dormant").alias("outcome"), F.count("*").alias("items"), *[F.count_if(s == k).alias(f"n_{k}") for k in SEVERITY]
    )


def tender_verdicts(stages: DataFrame) -> DataFrame:
    """Per run the verdict of stage I, and that of stage II, null without any."""
    return stages.groupBy("run_id").agg(F.max(F.when(F.col("stage") == "I", F.col("outcome"))).alias("verdict"), F.max(F.when(F.col("stage") == "II", F.col("outcome"))).alias("stage2"))
