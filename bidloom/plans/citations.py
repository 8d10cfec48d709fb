"""Citations, scopes and mentions: sentences made from the suppliers' keys, at the end of every document, cite nodes made from the same keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import apart, cut, spread
from ..operators import citations as cite
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()

#: What each supplier's file holds below its root: (id, kind, number, label, title), the same in both of its sub-documents.
_PARTS = [(f"P{p}", "part", p, None, {"A": "ESTIMATED PRICE", "B": "Payment"}.get(p)) for p in "ABC"]
_CLAUSES = [(f"P{p}:{c}", "clause", str(c), None, None) for p in "ABC" for c in (1, 2, 3)]
_SUB = [(f"P{p}:{c}:{c}.{s}", "subclause", f"{c}.{s}", None, None) for p in "ABC" for c in (1, 2, 3) for s in (1, 2)]
_ITEMS = [(f"P{p}:{c}:{c}.{s}:({x})", "subitem", None, f"({x})", None) for p in "ABC" for c in (1, 2, 3) for s in (1, 2) for x in "ab"]
BELOW = _PARTS + _CLAUSES + _SUB + _ITEMS
NODE = "project int, node_id string, kind string, number string, label string, title string, doc_name string, text string, aliases array<string>, source_file string"


def word(key: F.Column) -> F.Column:
    """A capitalised word for a key."""
    return F.concat(F.lit("Go"), F.translate(key.cast("string"), "0123456789", "abcdefghij"))


def nodes(t: Tables) -> DataFrame:
    s = spread(t.supplier, "s_suppkey").select(F.col("s_nationkey").alias("project"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("root"), word(F.col("s_suppkey")).alias("w"), (F.col("s_suppkey") % 10).alias("digit"))
    none = lambda *c: [F.lit(None).cast("string").alias(x) for x in c]
    no = F.lit(None).cast("array<string>").alias("aliases")
    file = F.concat(F.lit("in/0"), F.col("digit").cast("string"), F.lit(" "), "w", F.lit(" Contact Details (G.F.999).pdf"))
    root = s.select("project", F.col("root").alias("node_id"), F.lit("document").alias("kind"), *none("number", "label", "title", "doc_name", "text"), F.array(F.concat("w", F.lit(" TENDER FORM"))).alias("aliases"), file.alias("source_file"))
    subs = s.select("project", "root", "w", F.inline(F.array(*[F.struct(F.lit(i).alias("sub"), F.lit(n).alias("said")) for i, n in (("00-Price", " Price Schedule"), ("01-Terms", " Terms of Tender"))])))
    at = F.concat("root", F.lit(":"), "sub")
    sub = subs.select("project", at.alias("node_id"), F.lit("subdocument").alias("kind"), *none("number", "label", "title"), F.concat("w", "said").alias("doc_name"), *none("text"), no, *none("source_file"))
    rows = F.array(*[F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(("tail", "kind", "number", "label", "title"), b, strict=True)]) for b in BELOW])
    below = subs.select("project", at.alias("at"), F.inline(rows)).select("project", F.concat("at", F.lit(":"), "tail").alias("node_id"), "kind", "number", "label", "title", *none("doc_name", "text"), no, *none("source_file"))
    annex = s.select("project", F.concat("root", F.lit(":01-Terms:ANNEX-A")).alias("node_id"), F.lit("annex").alias("kind"), F.lit("A").alias("number"), *none("label", "title", "doc_name"), F.concat(F.lit("Annex A to the "), "w", F.lit(" Terms of Tender\nUNDERTAKING")).alias("text"), no, *none("source_file"))
    return root.unionByName(sub).unionByName(below).unionByName(annex)


SENTENCES = (
    " Paragraphs 1.1(a) to (b) and 1.2 of Parts A and C of the {w} Terms of Tender please note.",
    " Item 2 in Part B of the {w} Price Schedule in Local Currency.",
    " Tables A to C (if applicable) of the {w} Price Schedule and Paragraph 9 of the {w} Terms of Tender.",
    " Clauses 1 to 3 of the {w} Terms of Tender; Annex A to the {w} Terms of Tender - Part IA - Refunds.",
    " The {w} Price Schedule, duly completed. See {w} Terms of\n Tender; and {w} TENDER. Form.",
    " Paragraphs 1, 2, 3 and 4 above are separate.",
)


def cited(t: Tables) -> DataFrame:
    """doc_id, project, text: whole documents with a sentence that cites a supplier's file."""
    many = F.broadcast(t.supplier.agg(F.count("*").alias("many")))
    d = t.documents.select("doc_id", "text").crossJoin(many).withColumn("s", F.col("doc_id") % F.col("many") + 1)
    said = F.element_at(F.array(*[F.lit(x) for x in SENTENCES]), (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))
    d = d.join(t.supplier.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("project")), "s")
    return d.select("doc_id", "project", F.concat("text", F.replace(said, F.lit("{w}"), word(F.col("s")))).alias("text"))


W = "'Go' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij')"
PATHS = f"""p(kind, name, path) AS (VALUES
 {", ".join(f"(0, ' Terms of Tender', 'part {a} > number {n}')" for a in "AC" for n in ("1.1(a)", "1.1(b)", "1.2"))},
 (1, ' Price Schedule in Local Currency', 'part B > number 2'),
 (2, ' Price Schedule', 'part A'), (2, ' Price Schedule', 'part B'), (2, ' Price Schedule', 'part C'), (2, ' Terms of Tender', 'number 9'),
 (3, ' Terms of Tender', 'number 1'), (3, ' Terms of Tender', 'number 2'), (3, ' Terms of Tender', 'number 3'), (3, ' Terms of Tender', 'part IA')),
s AS (SELECT *, {W} AS w FROM supplier),
c AS (SELECT doc_id, s_nationkey AS project, s_suppkey, w, kind, name, path, CASE path WHEN 'part IA' THEN 'Annex A to the ' ELSE '' END || w || name AS said FROM documents JOIN s ON doc_id % (SELECT count(*) FROM supplier) + 1 = s_suppkey JOIN p ON doc_id % 6 = kind)"""


@query(f"WITH {PATHS} SELECT doc_id, said AS name, path, regexp_extract(path, 'number ([0-9.]+)', 1) AS number, regexp_extract(path, '\\(([a-z])\\)', 1) AS items FROM c")
def parse_citations(t: Tables) -> DataFrame:
    df = cite.citations(cite.chains(cited(t)))
    path = F.array_join(F.transform("path", lambda x: F.concat(x["kind"], F.lit(" "), x["ident"])), " > ")
    return df.select("doc_id", "name", path.alias("path"), "number", F.array_join("items", ",").alias("items"))


@query(f"""WITH s AS (SELECT s_nationkey AS project, 'S' || s_suppkey AS root, lower({W}) AS w FROM supplier),
 n AS (SELECT project, w || ' price schedule' AS key, root || ':00-Price' AS node_id, true AS document FROM s UNION ALL SELECT project, w || ' term of tender', root || ':01-Terms', true FROM s
 UNION ALL SELECT project, 'annex a to the ' || w || ' term of tender', root || ':01-Terms:ANNEX-A', true FROM s UNION ALL SELECT project, w || ' tender form', root, true FROM s
 UNION ALL SELECT project, w || ' contact detail g f 999', root, true FROM s UNION ALL SELECT project, w || ' contact detail', root, true FROM s
 UNION ALL SELECT project, 'estimated price', root || x || ':PA', true FROM s, (VALUES (':00-Price'), (':01-Terms')) v(x) UNION ALL SELECT project, 'payment', root || x || ':PB', false FROM s, (VALUES (':00-Price'), (':01-Terms')) v(x)) SELECT * FROM n""")
def scope_names(t: Tables) -> DataFrame:
    return cite.names(nodes(t)).select("project", "key", "node_id", "document")


LED = f"""WITH {PATHS},
 h AS (SELECT *, 'S' || s_suppkey || CASE WHEN starts_with(name, ' Price') THEN ':00-Price' ELSE ':01-Terms' END AS sub FROM c),
 r AS (SELECT doc_id, said, path, CASE kind
   WHEN 0 THEN [sub || ':P' || path[6] || ':1:' || regexp_extract(path, '1\\.[12]', 0) || CASE WHEN contains(path, '(') THEN ':' || regexp_extract(path, '\\(.\\)', 0) ELSE '' END]
   WHEN 1 THEN [sub || ':PB:2'] WHEN 2 THEN CASE WHEN path = 'number 9' THEN [NULL] ELSE [sub || ':P' || path[6]] END
   ELSE CASE WHEN path = 'part IA' THEN [NULL] ELSE [sub || ':PA:' || path[8], sub || ':PB:' || path[8], sub || ':PC:' || path[8]] END END AS ids FROM h),
 u AS (SELECT doc_id, said AS name, path, unnest(ids) AS node_id, CASE WHEN ids[1] IS NULL THEN 'unresolved' WHEN len(ids) = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM r)"""


@query(f"{LED} SELECT * FROM u")
def citations_resolved(t: Tables) -> DataFrame:
    docs, made = cited(t), nodes(t)
    path = F.array_join(F.transform("path", lambda x: F.concat(x["kind"], F.lit(" "), x["ident"])), " > ")
    cites = cite.citations(cite.chains(docs)).join(docs.select("doc_id", "project"), "doc_id").withColumn("said", path)
    cites = cut(cites.withColumn("cite", F.concat_ws("/", "doc_id", "chain", "ord")), "cited")
    found = cite.resolved(cites, made, cite.names(made))
    return found.join(apart(cites.select("project", "cite", "doc_id", "name", F.col("said").alias("path"))), ["project", "cite"]).select("doc_id", "name", "path", "node_id", "outcome")


@query(f"{LED} SELECT node_id, count(*) AS times FROM u WHERE outcome = 'unique' GROUP BY node_id")
def cited_places(t: Tables) -> DataFrame:
    """How often each node is cited beyond doubt."""
    return citations_resolved(t).where("outcome = 'unique'").groupBy("node_id").agg(F.count("*").alias("times"))


@query(f"""WITH s AS (SELECT *, {W} AS w FROM supplier), v(x, k) AS (VALUES (' Price Schedule', ' price schedule'), (' Terms of Tender', ' term of tender'))
 SELECT doc_id, w || x AS name, lower(w) || k AS key FROM documents JOIN s ON doc_id % (SELECT count(*) FROM supplier) + 1 = s_suppkey, v WHERE doc_id % 6 = 4""")
def document_mentions(t: Tables) -> DataFrame:
    docs = cited(t)
    texts = cite.blanked(docs, cite.chains(docs)).join(docs.select("doc_id", "project"), "doc_id")
    return cite.mentions(texts, cite.names(nodes(t))).select("doc_id", "name", "key")
