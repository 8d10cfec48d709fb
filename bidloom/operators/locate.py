"""Where a tender's schedule stands: its Parts and items on the pages, their nodes, and the clauses that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..lineage import cut
from . import citations as cite
from .documents import per_group
from .structure import NUMBERING, item_chain, page_footer

SCHEDULE = "Completeness Check Schedule"
PARTS = ("A", "B", "C")


def schedule_lines(pages: DataFrame, schedule: str = SCHEDULE) -> DataFrame:
    """(project, file, page, line, said): the lines of the first file whose footers name the schedule, running heads removed.

    pages: project, file, page, text. What stands above a head of the schedule's name and "Page n of m" goes with it, unless a Part or
    an item begins there.
    """
    named = pages.withColumn("name", page_footer(F.col("text"))["name"]).where(F.contains(F.lower("name"), F.lit(schedule.lower())))
    named = named.withColumn("first", F.min("file").over(Window.partitionBy("project"))).where("file = first")
    head = F.concat(F.lit("(?is)^(.*?)\\Q"), F.col("name"), F.lit(rf"\E\s*{NUMBERING}\s*(.*)$"))
    above, below = (F.call_function("regexp_extract", F.col("text"), head, F.lit(k)) for k in (1, 4))
    holds = F.concat(F.lit("\n"), above).rlike(r"\n(Part [A-Z]\b|\([a-z]\))")
    body = F.when(~F.regexp_like("text", head), F.col("text")).when(holds, F.concat(above, F.lit("\n"), below)).otherwise(below)
    return named.select("project", "file", "page", F.posexplode(F.split(body, "\n")).alias("line", "said"))


def schedule_units(lines: DataFrame) -> DataFrame:
    """(project, file, part, letter, page, text): a row for each Part, with its introduction and no letter, and each item.

    Parts begin at lines "Part A" and run to the next; items at the lines of the Part's chain of letters. A unit's page is that
    of its first line, though it may go on over pages. Steps are windows over a schedule's lines, a few pages each.
    """
    order = Window.partitionBy("project").orderBy("page", "line")
    letter = F.regexp_extract("said", r"^Part ([A-Z])\b", 1)
    df = lines.withColumn("head", F.when(letter.isin(*PARTS), letter)).withColumn("span", F.count("head").over(order)).where("span > 0")
    df = df.withColumn("marker", F.nullif(F.regexp_extract("said", r"^\(([a-z]+)\)", 1), F.lit("")))
    df = cut(df, "lines")
    marked = df.where("marker is not null").select("project", "span", (F.col("page") * (1 << 32) + F.col("line")).alias("at"), "marker")
    items = per_group(marked, ["project", "span"], "at", "marker", "item", "boolean", item_chain).where("item").select("project", "span", "at", F.col("marker").alias("opens"))
    df = df.withColumn("at", F.col("page") * (1 << 32) + F.col("line")).join(items, ["project", "span", "at"], "left")
    w = Window.partitionBy("project", "span").orderBy("at")
    df = df.withColumn("letter", F.last("opens", ignorenulls=True).over(w)).withColumn("part", F.first("head").over(w))
    said = F.when(F.col("head").isNotNull(), F.substring(F.col("said"), F.lit(7), F.length("said"))).otherwise(F.col("said"))
    rows = F.array_sort(F.collect_list(F.struct("at", said.alias("said"))))
    by = df.groupBy("project", "file", "span", "part", "letter").agg(F.min("at").alias("at"), F.min("page").alias("page"), rows.alias("rows"))
    whole = F.trim(F.regexp_replace(F.array_join(F.transform("rows", lambda r: r["said"]), "\n"), r"\s+", " "))
    return by.select("project", "file", "part", "letter", "page", whole.alias("text"), "span")


def _same(name: Column, schedule: str) -> Column:
    return cite.folded_name(F.coalesce(name, F.lit(""))) == cite.folded_name(F.lit(schedule))


def with_nodes(units: DataFrame, nodes: DataFrame, pages: DataFrame, schedule: str = SCHEDULE) -> DataFrame:
    """units with node_id and up (the Part's node): Parts by file, page and letter, items by their label below the Part's node,
    or in the Part where it has none; the node on the item's own page first, then in the order of nodes."""
    n = nodes.where(_same(F.col("doc_name"), schedule)).withColumn("file", F.element_at(F.split("source_file", "/"), -1))
    shown = pages.select("project", "file", F.col("page").alias("n_page")).distinct()
    parts = n.where("kind = 'part'").withColumnRenamed("page", "n_page").join(shown, ["project", "file", "n_page"], "left_semi")
    parts = parts.groupBy("project", "file", F.col("number").alias("part")).agg(F.min_by("node_id", "ord").alias("up"))
    df = units.join(parts, ["project", "file", "part"], "left")
    items = n.where("kind = 'subitem'").select("project", "file", F.element_at(F.split(F.col("part"), " "), -1).alias("part"), F.regexp_extract("label", r"^\(([a-z])\)$", 1).alias("letter"), "parent_id", F.col("node_id").alias("own"), F.col("page").alias("n_page"), "ord")
    hit = df.where("letter is not null").join(items, ["project", "file", "part", "letter"]).where(F.col("up").isNull() | (F.col("parent_id") == F.col("up")))
    best = hit.groupBy("project", "span", "letter").agg(F.min_by("own", F.struct(F.col("n_page") != F.col("page"), F.col("ord"))).alias("own"))
    df = df.join(best, ["project", "span", "letter"], "left")
    return df.withColumn("node_id", F.when(F.col("letter").isNull(), F.col("up")).otherwise(F.col("own"))).drop("own")


def quotes(nodes: DataFrame) -> DataFrame:
    """(project, node_id, page, own, quote): a node's own text, or, as its quote, its title or document's name; of a whole document the first text inside."""
    own = F.trim(F.coalesce("text", F.lit("")))
    inside = nodes.where(own != "").select("project", F.explode(cite._above(F.col("node_id"))).alias("node_id"), "ord", "text")
    first = inside.groupBy("project", "node_id").agg(F.trim(F.min_by("text", "ord")).alias("inside"))
    df = nodes.join(first, ["project", "node_id"], "left")
    name = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.col("title"), F.lit("")), "doc_name", F.lit("")), r"\s+", " "))
    return df.select("project", "node_id", "page", F.nullif(own, F.lit("")).alias("own"), F.when(own != "", own).when(F.col("kind").isin("document", "subdocument") & F.col("inside").isNotNull(), F.col("inside")).otherwise(name).alias("quote"))


def described(name: Column, path: Column) -> Column:
    """A citation written out, the innermost first: "Paragraph 2 of Part A of the Price Schedule"."""
    words = F.create_map(*[F.lit(x) for kv in {"part": "Part", "annex": "Annex", "number": "Paragraph", "label": "part"}.items() for x in kv])
    chain = F.array_join(F.reverse(F.transform(path, lambda t: F.concat(words[t["kind"]], F.lit(" "), t["ident"]))), " of ")
    return F.when(F.size(path) == 0, name).otherwise(F.concat(chain, F.lit(" of the "), name))


def located(pages: DataFrame, nodes: DataFrame, schedule: str = SCHEDULE) -> tuple[DataFrame, DataFrame]:
    """(units, clauses) of every project's schedule.

    units: project, part, letter and title (null for a Part), page, node_id, quote. clauses: project, part, letter, ord,
    written, node_id, page, quote: what the unit's text cites, in its order and once each: nodes outside the schedule, or none where a
    citation leads nowhere. An item's text is that of its node and all below, or that of its lines where it has no node;
    a Part's that of its node, or its introduction.

    pages: project, file, page, text; nodes: project, node_id, parent_id, kind, number, label, title, doc_name, part, text,
    page, source_file, aliases, ord. Every step is a join or aggregation by project, so any number of tenders goes through at once.
    """
    nodes = cut(nodes, "nodes")
    units = cut(with_nodes(schedule_units(schedule_lines(pages, schedule)), nodes, pages, schedule), "units")
    below = nodes.where(F.coalesce("text", F.lit("")) != "").select("project", F.explode(F.array_append(cite._above(F.col("node_id")), F.col("node_id"))).alias("node_id"), F.col("node_id").alias("inner"), "ord", F.col("text").alias("said"))
    inner = F.col("letter").isNotNull() | (F.col("inner") == F.col("node_id"))
    read = units.join(below, ["project", "node_id"]).where(inner).groupBy("project", "span", "letter").agg(F.array_sort(F.collect_list(F.struct("ord", "said"))).alias("rows"))
    read = read.select("project", "span", F.coalesce("letter", F.lit("")).alias("_l"), F.array_join(F.transform("rows", lambda r: r["said"]), "\n").alias("read"))
    q = cut(quotes(nodes), "quotes")
    units = units.withColumn("_l", F.coalesce("letter", F.lit(""))).join(read, ["project", "span", "_l"], "left").join(q.withColumnRenamed("page", "n_page"), ["project", "node_id"], "left")
    whole = F.when(F.col("letter").isNull(), F.concat_ws(" ", F.lit("Part"), "part", F.nullif(F.col("text"), F.lit("")))).otherwise(F.col("text"))
    cited = F.when(F.col("node_id").isNotNull(), F.coalesce("read", F.lit(""))).otherwise(F.col("text"))
    title = F.when(F.col("letter").isNotNull(), F.coalesce(F.nullif(tx.title(F.coalesce("own", "text")), F.lit("")), "letter"))
    units = units.select(
        "project", "span", "part", "letter", title.alias("title"), F.coalesce("n_page", "page").alias("page"), "node_id",
        F.coalesce(F.nullif(F.col("quote"), F.lit("")), whole).alias("quote"), cited.alias("cited"), F.concat_ws("/", F.col("project").cast("string"), F.col("span").cast("string"), "_l").alias("doc_id"),
    )
    units = cut(units, "read")

    docs = units.select("doc_id", "project", F.col("cited").alias("text"))
    registry = cite.names(nodes)
    chains = cut(cite.chains(docs), "chains")
    said = cite.citations(chains).join(docs.select("doc_id", "project"), "doc_id")
    said = said.select("project", "doc_id", F.struct(F.lit(0).alias("kind"), F.col("chain").alias("a"), F.col("ord").alias("b")).alias("place"), "name", "path")
    texts = cite.blanked(docs, chains).join(docs.select("doc_id", "project"), "doc_id")
    bare = cite.mentions(texts, registry).join(docs.select("doc_id", "project"), "doc_id")
    none = F.array().cast("array<struct<kind:string,ident:string>>")
    bare = bare.select("project", "doc_id", F.struct(F.lit(1).alias("kind"), F.col("run").alias("a"), F.col("start").alias("b")).alias("place"), "name", none.alias("path"))
    said = cut(said.unionByName(bare).withColumn("cite", F.concat_ws("/", "doc_id", F.to_json("place"))), "said")
    led = cite.resolved(said.select("project", "cite", "name", "path"), nodes, registry).select("project", "cite", "node_id")
    # The schedule's own sub-document, or else its Parts, are no clauses of it.
    own = nodes.where(_same(F.col("doc_name"), schedule) & F.col("kind").isin("subdocument", "part"))
    own = own.withColumn("sub", F.max((F.col("kind") == "subdocument").cast("int")).over(Window.partitionBy("project"))).where("(sub = 1) = (kind = 'subdocument')").select("project", F.col("node_id").alias("up"))
    up = led.where("node_id is not null").select("project", "cite", "node_id", F.explode(F.array_append(cite._above(F.col("node_id")), F.col("node_id"))).alias("up"))
    inside = up.join(own, ["project", "up"], "left_semi").select("project", "cite", "node_id").distinct()
    led = led.where("node_id is not null").join(inside, ["project", "cite", "node_id"], "left_anti")
    df = said.join(led, ["project", "cite"], "left").where(F.col("node_id").isNotNull() | ~_same(F.col("name"), schedule))
    df = df.withColumn("written", F.when(F.col("node_id").isNull(), described(F.col("name"), F.col("path"))))
    df = df.groupBy("project", "doc_id", "node_id", "written").agg(F.min("place").alias("place"))
    df = df.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "node_id")))
    out = df.join(units.select("doc_id", "part", "letter"), "doc_id").join(q.drop("own"), ["project", "node_id"], "left")
    out = out.where(F.col("node_id").isNull() | F.col("page").isNotNull())
    return units.select("project", "part", "letter", "title", "page", "node_id", "quote"), out.select("project", "part", "letter", "ord", "written", "node_id", "page", "quote")
