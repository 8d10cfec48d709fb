"""Schedules of one tender for each supplier, located on pages and nodes made from the suppliers' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import locate
from .base import Tables, registrar
from .citations import nodes as files
from .citations import word

QUERIES, ORACLE_SQL, query = registrar()

FOOT = "Tender Ref.: {w}\nCompleteness Check Schedule Page %d of 2\n"
#: Pages 4 and 5 of the schedules' file: a range that wraps before a letter, roman sub-items, an item that goes on over the page.
PAGES = {
    3: "Cover of {w}",
    4: FOOT % 1 + "Part A\nItems (a) to\n(c) below: see Clause 1 in Part A of the {w} Terms of Tender.\n(a) Offer form in Part B of the {w} Price Schedule; signed.\n(b) Proof, i.e. a letter, under\n(i) Item 2 in Part C of the {w} Price Schedule or\n(ii) Paragraph 9 of the {w} Terms of Tender",
    5: FOOT % 2 + "and more\n(c) The {w} Price Schedule.\nPart B\nNothing here.\n(a) Any paper of the Completeness Check Schedule",
}
INTRO = "Items (a) to (c) below: see Clause 1 in Part A of the {w} Terms of Tender."
#: (id, kind, number, label, part, text) of the schedule's nodes; item (c) and Part B have none.
NODES = (
    ("", "document", None, None, None, None),
    (":PA", "part", "A", None, "Part A", INTRO),
    (":PA:(a)", "subitem", None, "(a)", "Part A", "(a) Offer form in Part B of the {w} Price Schedule; signed."),
    (":PA:(b)", "subitem", None, "(b)", "Part A", "(b) Proof, i.e. a letter, under"),
    (":PA:(b):(a)", "subitem", None, "(a)", "Part A", "(i) Item 2 in Part C of the {w} Price Schedule or"),
    (":PA:(b):(ii)", "subitem", None, "(ii)", "Part A", "(ii) Paragraph 9 of the {w} Terms of Tender; Part A of the Completeness Check Schedule"),
)


def _made(t: Tables) -> tuple[DataFrame, DataFrame]:
    """pages and nodes: each supplier is a project with its two documents and a schedule."""
    s = t.supplier.select(F.col("s_suppkey").alias("project"), word(F.col("s_suppkey")).alias("w"))
    put = lambda x: F.lit(None).cast("string") if x is None else F.replace(F.lit(x), F.lit("{w}"), F.col("w"))
    pages = s.select("project", F.lit("09 Schedules.pdf").alias("file"), F.inline(F.array(*[F.struct(F.lit(k).alias("page"), put(v).alias("text")) for k, v in PAGES.items()])))
    rows = F.array(*[F.struct(F.concat(F.lit("L"), F.col("project").cast("string"), F.lit(i)).alias("node_id"), F.lit(k).alias("kind"), F.lit(n).cast("string").alias("number"), F.lit(lb).cast("string").alias("label"), F.lit(p).cast("string").alias("part"), put(x).alias("text")) for i, k, n, lb, p, x in NODES])
    up = lambda c: F.nullif(F.regexp_extract(c, "^(.*):[^:]*$", 1), F.lit(""))
    none = F.lit(None).cast("string")
    own = s.select("project", F.inline(rows)).withColumns({"title": none, "doc_name": F.when(F.col("kind") != "document", locate.SCHEDULE), "aliases": F.lit(None).cast("array<string>"), "source_file": F.lit("in/09 Schedules.pdf"), "page": F.lit(4)})
    rest = files(t).withColumns({"project": F.regexp_extract("node_id", "^S([0-9]+)", 1).cast("long"), "part": none, "page": F.lit(2)})
    nodes = own.unionByName(rest.withColumn("source_file", F.coalesce("source_file", F.lit("in/02 Terms.pdf"))))
    return pages, nodes.withColumns({"parent_id": up(F.col("node_id")), "ord": F.col("node_id")})


W = "'Go' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij')"


def _sql(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows: tuple) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _sql(x) for x in r) + ")" for r in rows)


UNITS = (
    ("A", None, None, 4, "L{k}:PA", INTRO), ("A", "a", "Offer form in Part B of the {w} Price Schedule;", 4, "L{k}:PA:(a)", NODES[2][5]), ("A", "b", "Proof, i.e. a letter, under", 4, "L{k}:PA:(b)", NODES[3][5]),
    ("A", "c", "The {w} Price Schedule.", 5, None, "(c) The {w} Price Schedule."), ("B", None, None, 5, None, "Part B Nothing here."), ("B", "a", "Any paper of the Completeness Check Schedule", 5, None, "(a) Any paper of the Completeness Check Schedule"),
)
CLAUSES = (
    ("A", None, 1, None, "S{k}:01-Terms:PA:1", ""), ("A", "a", 1, None, "S{k}:00-Price:PB", "Payment"), ("A", "b", 1, None, "S{k}:00-Price:PC:2", ""), ("A", "b", 2, "Paragraph 9 of the {w} Terms of Tender", None, None),
    ("A", "c", 1, None, "S{k}:00-Price", "{w} Price Schedule"), ("B", "a", 1, None, "L{k}", INTRO),
)


@query(f"""WITH s AS (SELECT s_suppkey, {W} AS w FROM supplier), v(part, letter, title, page, node_id, quote) AS (VALUES {_values(UNITS)})
 SELECT s_suppkey AS project, part, letter, replace(title, '{{w}}', w) AS title, page::INT AS page, replace(node_id, '{{k}}', s_suppkey::VARCHAR) AS node_id, replace(quote, '{{w}}', w) AS quote FROM s, v""")
def schedule_units(t: Tables) -> DataFrame:
    return locate.located(*_made(t))[0]


@query(f"""WITH s AS (SELECT s_suppkey, {W} AS w FROM supplier), v(part, letter, ord, written, node_id, quote) AS (VALUES {_values(CLAUSES)})
 SELECT s_suppkey AS project, part, letter, ord::INT AS ord, replace(written, '{{w}}', w) AS written, replace(node_id, '{{k}}', s_suppkey::VARCHAR) AS node_id, CASE WHEN starts_with(node_id, 'L') THEN 4 WHEN node_id IS NOT NULL THEN 2 END::INT AS page, replace(quote, '{{w}}', w) AS quote FROM s, v""")
def schedule_clauses(t: Tables) -> DataFrame:
    return locate.located(*_made(t))[1]
