"""Around the rules: gates, routing, merges, second readings, scores and the marks of a document's text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import agree
from ..functions.vocab import SEVERITY
from .rules import few

#: What a drafted rule's blank means by Part of the schedule.
BLANK_BY_PART = {"A": "disqualified", "B": "dormant", "C": "pass"}
#: Which mark wins where several begin at one place.
MARK_ORDER = ("part", "part_inline", "annex", "clause", "subclause", "subitem")


# ------------------------------------------------------------------ joins
def with_ruleset(results: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Results with the rule set they were decided by: equal project and version."""
    return results.join(rulesets, ["project", "version"])


def with_template(items: DataFrame, own: DataFrame, library: DataFrame) -> DataFrame:
    """Adds body: an item's own copy of its template, else the library's. own, library: template, body."""
    o, b = own.select("template", F.col("body").alias("_own")), library.select("template", F.col("body").alias("_lib"))
    return items.join(o, "template", "left").join(b, "template", "left").withColumn("body", F.coalesce("_own", "_lib")).drop("_own", "_lib")


def labelled_pages(pages: DataFrame, labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every page with exactly one label of the vocabulary (label); other where none was given or it is unknown."""
    given = labels.groupBy("page").agg(F.min("label").alias("label")).join(vocabulary.select("label").distinct(), "label", "left_semi")
    return pages.join(given, "page", "left").withColumn("label", F.coalesce("label", F.lit("other")))


def routed(pages: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of forms by their label, and the pages that a reader must be asked about. forms: label, form."""
    return pages.join(forms, "label"), pages.join(forms.select("label"), "label", "left_anti")


def missing_offers(offers: DataFrame, results: DataFrame, version: DataFrame) -> DataFrame:
    """Offers of a project without a result at its version. version: project, version."""
    now = results.join(version, ["project", "version"], "left_semi").select("project", "tenderer")
    return offers.join(now, ["project", "tenderer"], "left_anti")


def forms_without_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items of Part A whose form has no page. items: part, form; pages: run_id, form."""
    runs = pages.select("run_id").distinct()
    return runs.crossJoin(few(items.where("part = 'A'"))).join(pages.select("run_id", "form").distinct(), ["run_id", "form"], "left_anti")


def uncovered(nodes: DataFrame, cited: DataFrame, covered: DataFrame) -> DataFrame:
    """Nodes beside what is cited (the same parent) that nothing covers and that hold no other node. nodes: id, parent."""
    near = nodes.join(cited.select("id"), "id", "left_semi").select("parent").distinct()
    beside = nodes.join(near, "parent", "left_semi").select("id", "parent")
    used = covered.select("id").unionByName(cited.select("id")).distinct()
    holders = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    return beside.join(used, "id", "left_anti").join(holders, "id", "left_anti")


def second_readings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Adds verified, confidence and note. first: run_id, name, value, printed, confidence; second: run_id, name, value, confidence.

    Two readings agree as texts do; the confidence is their mean, and half of the lesser one where they differ.
    """
    s = second.select("run_id", "name", F.col("value").alias("again"), F.col("confidence").alias("c2"))
    j = first.join(s, ["run_id", "name"], "left")
    shown, c1, c2 = F.coalesce("printed", "value"), F.coalesce("confidence", F.lit(0.0)), F.coalesce("c2", F.lit(0.0))
    ok = agree(shown, F.col("again"))
    note = F.when(ok & shown.isNotNull(), "a second, independent read agrees").when(ok, "a second, independent read found nothing either").otherwise("the two readings differ")
    return j.withColumns({"verified": ok, "note": note, "confidence": F.round(F.when(ok, (c1 + c2) / 2).otherwise(F.least(c1, c2) / 2), 2)}).drop("again", "c2")


# ------------------------------------------------------------------ gates
def report_gate(projects: DataFrame, reviews: DataFrame) -> DataFrame:
    """(project, reason) of projects whose reports are refused: a review isn't confirmed, or there is none."""
    by = reviews.groupBy("project").agg(F.count_if(~F.coalesce("confirmed", F.lit(False))).alias("open"))
    j = projects.select("project").distinct().join(by, "project", "left")
    why = F.when(F.col("open").isNull(), "no review").when(F.col("open") > 0, F.concat(F.col("open").cast("string"), F.lit(" unconfirmed")))
    return j.select("project", why.alias("reason")).where("reason is not null")


def listed(vendors: DataFrame, status: str | None, text: str) -> DataFrame:
    """Vendors of a status whose name holds the text, whatever the case. vendors: name, status."""
    df = vendors if status is None else vendors.where(F.col("status") == status)
    return df.where(F.contains(F.lower("name"), F.lit(text.lower())))


def blank_outcome(part: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BLANK_BY_PART.items() for x in kv]), part), F.lit("pass"))


def merged_params(params: Column, inputs: Column, condition: Column) -> Column:
    """A transform's params with the inputs and the condition that stand beside them; those win."""
    entry = lambda k, v: F.when(v.isNotNull(), F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(F.coalesce(params, F.create_map().cast("map<string,string>")), entry("inputs", inputs), entry("condition", condition))


def displayed(value: Column, page: Column, corrected: Column, corrected_page: Column) -> tuple[Column, Column]:
    """What a reader sees: the correction and the page it names, where there is one."""
    return F.coalesce(corrected, value), F.coalesce(corrected_page, page)


# ------------------------------------------------------------------ merges and edits
def rebuilt(old: DataFrame, new: DataFrame) -> DataFrame:
    """A rule set after a new build. Both: letter, title, by; old also reason.

    A person's items win, and a differing new title stays beside them as a suggestion; items that a person added stay;
    what only the model once had goes; reasons of gaps are carried over.
    """
    o = old.select("letter", F.col("title").alias("_t"), F.col("by").alias("_by"), "reason")
    j = new.select("letter", "title", "by").join(o, "letter", "full_outer")
    person = F.coalesce(F.col("_by") == "person", F.lit(False))
    out = j.where(F.col("title").isNotNull() | person)
    return out.select(
        "letter", F.when(person, F.col("_t")).otherwise(F.col("title")).alias("title"), F.when(person, "person").otherwise(F.col("by")).alias("by"),
        F.when(person & (F.col("title") != F.col("_t")), F.col("title")).alias("suggested"), "reason",
    )


def next_added(letters: Column) -> Column:
    """The letter of the next item that a person adds: x1, x2 and so on."""
    n = F.transform(F.filter(letters, lambda x: x.rlike("^x[0-9]+$")), lambda x: F.substring(x, 2, 10).cast("int"))
    return F.concat(F.lit("x"), (F.coalesce(F.array_max(n), F.lit(0)) + 1).cast("string"))


def edited(notes: Column, index: Column, text: Column, who: Column) -> Column:
    """Notes (array of struct<text, model, by>) with one replaced: the model's wording stays beside the person's."""
    put = lambda x, i: F.when(i == index, F.struct(text.alias("text"), F.coalesce(x["model"], x["text"]).alias("model"), who.alias("by"))).otherwise(x)
    return F.transform(notes, put)


def same_verdict(a: str, b: str) -> Column:
    """Equal apart from the version each was decided against. a, b: struct columns with a field ruleset_version."""
    return F.col(a).dropFields("ruleset_version").eqNullSafe(F.col(b).dropFields("ruleset_version"))


# ------------------------------------------------------------------ roll-ups and scores
def tenderer_row(rows: DataFrame) -> DataFrame:
    """Per run: passed, to review, failed, and per stage the worst status that isn't dormant."""
    s, live = F.col("status"), F.col("status") != "dormant"
    worst = lambda stage: F.max_by(s, F.when(live & (F.col("stage") == stage), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), s), F.lit(0))))
    return rows.groupBy("run_id").agg(
        F.count_if(s == "pass").alias("passed"), F.count_if(s == "needs_review").alias("review"), F.count_if(s == "disqualified").alias("failed"),
        worst("I").alias("stage1"), worst("II").alias("stage2"), F.count_if(F.col("stage") == "II").alias("stage2_rows"),
    )


def ruleset_score(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row: items found, parts, pages and templates right, checks found of those expected.

    expected: letter, part, page, template, checks (array); found: letter, part, page, template, checks.
    """
    f = found.select("letter", *[F.col(c).alias(f"f_{c}") for c in ("part", "page", "template", "checks")], F.lit(True).alias("is_found"))
    j = expected.join(f, "letter", "left").withColumn("hit", F.col("is_found").isNotNull())
    right = lambda c: F.count_if(F.col("hit") & F.col(c).isNotNull() & (F.col(c) == F.col(f"f_{c}")))
    common = F.when(F.col("hit"), F.size(F.array_intersect("checks", "f_checks"))).otherwise(0)
    df = j.agg(
        F.count("*").alias("items"), F.count_if("hit").alias("found"), right("part").alias("part_right"), right("page").alias("page_right"), F.count("page").alias("paged"),
        right("template").alias("template_right"), F.sum(common).alias("checks_found"), F.sum(F.size("checks")).alias("checks"),
    )
    pct = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 1)
    return df.withColumns({"found_pct": pct("found", "items"), "part_pct": pct("part_right", "items"), "checks_pct": pct("checks_found", "checks")})


def bid_score(rows: DataFrame) -> DataFrame:
    """Per letter and in total (a null letter): presence, pages hit, values matched, missed, wrong and invented, and the
    verification matrix. rows: letter, expected, read, key_pages, read_pages (arrays), verified.

    Numbers match within half a percent of the larger one, both ways; other values as texts do.
    """
    e, r = F.col("expected"), F.col("read")
    a, b = e.try_cast("double"), r.try_cast("double")
    near = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 0.005 * F.greatest(F.abs(a), F.abs(b))).otherwise(agree(e, r))
    df = rows.select("letter", "verified", e.isNotNull().alias("e"), r.isNotNull().alias("r"), (e.isNotNull() & r.isNotNull() & near).alias("m"), F.arrays_overlap("key_pages", "read_pages").alias("hit"), (F.size(F.array_except("read_pages", "key_pages")) == 0).alias("within"))
    rate = lambda x, of: F.round(F.try_divide(F.count_if(x & of).cast("double"), F.count_if(of)), 3)
    e, r, m = F.col("e"), F.col("r"), F.col("m")
    return df.rollup("letter").agg(
        F.count_if(e == r).alias("presence"), F.count_if("hit").alias("page_hit"), F.count_if(F.col("hit") & F.col("within")).alias("page_within"),
        F.count_if(m).alias("matched"), F.count_if(e & ~r).alias("missed"), F.count_if(e & r & ~m).alias("mismatched"), F.count_if(~e & r).alias("invented"),
        F.count_if(m & F.col("verified")).alias("right_verified"), F.count_if(r & ~m & F.col("verified")).alias("wrong_verified"), F.count_if(m & ~F.col("verified")).alias("right_unverified"),
        rate(m, e).alias("match_rate"), rate(~e & r, r).alias("invented_rate"),
    )


def strong_bands(items: DataFrame, keys: list[str], share: float = 0.08) -> DataFrame:
    """Left edges of the clusters that hold at least two items and 8 % of a block's, in blocks with two such. items: keys, cluster, x."""
    n = F.count("*").over(Window.partitionBy(*keys))
    by = items.withColumn("_n", n).groupBy(*keys, "cluster").agg(F.min("x").alias("x"), F.count("*").alias("members"), F.first("_n").alias("_n"))
    by = by.where(F.col("members") >= F.greatest(F.lit(2), F.floor(F.col("_n") * share)))
    return by.withColumn("_k", F.count("*").over(Window.partitionBy(*keys))).where("_k >= 2").drop("_k", "_n")


# ------------------------------------------------------------------ marks of a text
def one_mark(marks: DataFrame) -> DataFrame:
    """One mark for each place of a document, by the order of kinds. marks: doc, offset, kind, number, title."""
    place = F.array_position(F.array(*map(F.lit, MARK_ORDER)), F.col("kind"))
    rank = F.row_number().over(Window.partitionBy("doc", "offset").orderBy(place, "number"))
    return marks.withColumn("_r", rank).where("_r = 1").drop("_r")


def parts_with_content(marks: DataFrame) -> DataFrame:
    """Inline PARTs stay, as parts, only if a clause, sub-clause or sub-item lies before the next boundary."""
    edge, held = F.col("kind").isin("part", "part_inline", "annex"), F.col("kind").isin("clause", "subclause", "subitem")
    df = marks.withColumn("_n", F.max(F.when(edge, F.col("offset"))).over(Window.partitionBy("doc").orderBy("offset").rangeBetween(Window.unboundedPreceding, 0)))
    full = F.max(held & (F.col("offset") > F.col("_n"))).over(Window.partitionBy("doc", "_n"))
    df = df.withColumn("_full", full).where((F.col("kind") != "part_inline") | F.col("_full"))
    return df.withColumn("kind", F.when(F.col("kind") == "part_inline", "part").otherwise(F.col("kind"))).drop("_n", "_full")


def real_subclauses(marks: DataFrame) -> DataFrame:
    """Sub-clauses stay only where their clause is in the document and isn't 0: other decimals are figures."""
    heads = marks.where("kind = 'clause'").select("doc", F.col("number").alias("_head")).distinct()
    head = F.substring_index("number", ".", 1)
    sub = marks.where("kind = 'subclause'").withColumn("_head", head).where("_head <> '0'").join(heads, ["doc", "_head"], "left_semi")
    return marks.where("kind <> 'subclause'").unionByName(sub.select(*marks.columns))


def apart_annexes(marks: DataFrame, gap: int = 300) -> DataFrame:
    """Annex marks with another within so many characters are a list of names and go."""
    w = Window.partitionBy("doc", (F.col("kind") == "annex")).orderBy("offset")
    near = F.least(F.col("offset") - F.lag("offset").over(w), F.lead("offset").over(w) - F.col("offset")) < gap
    return marks.withColumn("_near", (F.col("kind") == "annex") & F.coalesce(near, F.lit(False))).where("not _near").drop("_near")


def cited_once(citations: DataFrame) -> DataFrame:
    """One citation per document and page, one with a quote first, in the order of first citing. citations: doc, page, quote, ord."""
    w = Window.partitionBy("doc", "page")
    df = citations.withColumn("first", F.min("ord").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("quote").isNull(), "ord", "quote")))
    return df.where("_r = 1").drop("_r")


def jobs_after(jobs: DataFrame, after: str | None, limit: int, order: str = "created") -> DataFrame:
    """The next jobs of each project after a job id in order of creation; from the start where it is unknown. jobs: project, job_id."""
    n = F.row_number().over(Window.partitionBy("project").orderBy(order, "job_id"))
    df = jobs.withColumn("_n", n).withColumn("_at", F.coalesce(F.max(F.when(F.col("job_id") == after, F.col("_n"))).over(Window.partitionBy("project")), F.lit(0)))
    return df.where((F.col("_n") > F.col("_at")) & (F.col("_n") <= F.col("_at") + limit)).drop("_n", "_at")


# ------------------------------------------------------------------ control
def next_steps(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Per run the first step that isn't done, null where all are. steps: step, ord; done: run_id, step."""
    finished = done.groupBy("run_id").agg(F.collect_set("step").alias("done"))
    plan = steps.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "step"))), lambda x: x["step"]).alias("plan"))
    return finished.crossJoin(F.broadcast(plan)).select("run_id", F.get(F.array_except("plan", "done"), F.lit(0)).alias("step"))


def first_answer(attempts: DataFrame, order: list[str]) -> DataFrame:
    """Per key the answer of the first model in order that gave one, and which. attempts: key, model, answer (null: failed)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    some = F.when(F.col("answer").isNotNull() & (place > 0), place)
    return attempts.groupBy("key").agg(F.min_by("answer", some).alias("answer"), F.min_by("model", some).alias("model"), F.count_if(F.col("answer").isNull()).alias("failed"))


def running_cost(saved: DataFrame, deltas: DataFrame) -> DataFrame:
    """A run's cost: what was saved, and all that came since. saved: run_id, usd; deltas: run_id, usd."""
    return reduce(DataFrame.unionByName, (saved.select("run_id", "usd"), deltas.select("run_id", "usd"))).groupBy("run_id").agg(F.sum("usd").alias("usd"))


def checked_choices(answers: DataFrame, menu: DataFrame) -> DataFrame:
    """A model's choices: an id outside the menu is unknown, a quote that its text doesn't hold unverified, a repeated id
    goes. answers: run_id, ord, id, quote; menu: id, text."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    j = answers.join(menu.select("id", F.col("text").alias("_text")), "id", "left")
    first = F.row_number().over(Window.partitionBy("run_id", "id").orderBy("ord"))
    state = F.when(F.col("_text").isNull(), "unknown").when(F.coalesce(F.contains(flat(F.col("_text")), flat(F.col("quote"))) & (flat(F.col("quote")) != ""), F.lit(False)), "verified").otherwise("unverified")
    return j.withColumns({"_n": first, "state": state}).where("_n = 1").drop("_n", "_text")
