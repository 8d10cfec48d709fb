"""Answer keys against nodes, likeness of readings, and pages read from files that Spark has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import cut, shared_folder
from ..operators import matches
from ..sources import page_source, readers
from .base import Tables, registrar
from .citations import nodes as files

QUERIES, ORACLE_SQL, query = registrar()

#: (key, its parent, first words or the node's own, node found or null, why); {s} is a supplier's root.
KEYS = (
    ("Terms", None, "", None, "no node with this path on this page"), ("Terms:PartA", None, "01-TermsPA", "{s}:01-Terms:PA", ""), ("Price:TableA:Item1", "Price:TableA", "00-Price PA:1", "{s}:00-Price:PA:1", ""), ("Terms:2.1(a)", "Terms", "01-Terms PB:2:2.1:(a)", "{s}:01-Terms:PB:2:2.1:(a)", ""),
    ("Terms:PartA:Para9", "Terms:PartA", "", None, "no node with this path on this page"), ("Terms:PartA:Notes", "Terms:PartA", "01-Terms PA:3:3.2 of", "{s}:01-Terms:PA:3:3.2", ""), ("Terms:PartA:Notes:Glossary", "Terms:PartA:Notes", "01-Terms PB:3 of", None, "first words not inside the ancestor on this page"),
    ("Other:Preface", None, "00-Price PC of", "{s}:00-Price:PC", ""), ("Other:Annex", None, "no such words", None, "first words not on this page"), ("Terms:PartA:Para9:Tail", "Terms:PartA:Para9", "01", None, "marked ancestor not found"),
)


def _sql(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"""WITH v(key_id, found, why, marked) AS (VALUES {", ".join("(" + ", ".join([_sql(k), _sql(n), _sql(w), str(not k.endswith(("Notes", "Glossary", "Preface", "Annex", "Tail"))).lower()]) + ")" for k, _, _, n, w in KEYS)})
 SELECT s_suppkey AS project, key_id, marked, replace(found, '{{s}}', 'S' || s_suppkey) AS node_id, why FROM supplier, v""")
def key_matches(t: Tables) -> DataFrame:
    """A key of ten nodes for each supplier's file, all of whose nodes stand on one page."""
    project = F.regexp_extract("node_id", "^S([0-9]+)", 1).cast("long")
    below = F.regexp_extract("node_id", "^[^:]*:(.*)$", 1)
    said = F.when(below != "", F.concat(F.regexp_replace(below, "^([^:]*):?", "$1 "), F.lit(" of the file")))
    nodes = files(t).where("kind not in ('document', 'annex')").select(project.alias("project"), "node_id", "kind", F.lit("f").alias("file"), F.lit(2).alias("page"), said.alias("text"), F.col("node_id").alias("ord"))
    rows = F.array(*[F.struct(F.lit(k).alias("key_id"), F.lit(p).cast("string").alias("parent_id"), F.lit(w).alias("first_words")) for k, p, w, _, _ in KEYS])
    keys = t.supplier.select(F.col("s_suppkey").alias("project"), F.inline(rows)).withColumns({"file": F.lit("f"), "page": F.when(F.col("key_id") == "Terms", 3).otherwise(2)})
    return matches.key_matches(keys, nodes)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 * length(p_name) / (2 * length(p_name) + 1 + length(p_brand)) WHEN 2 THEN 0.0 END::DOUBLE AS alike FROM part""")
def text_similarity(t: Tables) -> DataFrame:
    """A part's name against itself, itself and more, what shares no character with it, and nothing."""
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("§"), "p_brand")).when(k == 2, F.lit("§§§"))
    return t.part.select("p_partkey", text.similarity("p_name", other).alias("alike"))


@query("""WITH d AS (SELECT doc_id, (doc_id % 7)::VARCHAR AS f, replace(coalesce(text, ''), chr(12), ' ') AS text FROM documents),
 p AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS page FROM d)
 SELECT f AS file, page::INT AS page, row_number() OVER (ORDER BY f, page) AS seq, length(text) >= 100 AS has_text, md5(text) AS digest FROM p""")
def page_files(t: Tables) -> DataFrame:
    """Whole documents as pages of seven files, written by Spark and read in ranges of bytes; one sequence over all files."""
    import uuid

    folder = f"{shared_folder(t.spark)}/bidloom/{uuid.uuid4().hex}/pages"
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" "))
    # Pages come in order of ids: a file is a folder of parts, ranges of ids that many tasks write, named in their order.
    rows = t.documents.select((F.col("doc_id") % 7).cast("string").alias("f"), "doc_id", said.alias("value")).repartitionByRange("f", "doc_id").sortWithinPartitions("f", "doc_id")
    rows.select("f", "value").write.partitionBy("f").option("lineSep", "\f").text(folder)
    pages = page_source.pages(t.spark, folder, 4 << 20, "f=([0-9]+)").select(F.lit("all").alias("offer"), F.col("file").alias("doc"), "page", (F.length("text") >= readers.HAS_TEXT).alias("has_text"), F.md5(F.col("text").cast("binary")).alias("digest"))
    out = readers.gapless_sequence(cut(pages, "digests"))
    return out.select(F.col("doc").alias("file"), "page", F.col("seq").cast("long").alias("seq"), "has_text", "digest")
