"""Text, furniture, quotes and budgets over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents as docs
from ..operators import relational as rel
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("page", "line"))


LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents)"


@query(f"WITH {LINES} SELECT source AS scope, line AS text, count(DISTINCT doc_id) AS pages FROM lines WHERE length(line) >= 8 AND NOT regexp_matches(line, '^\\(?[a-z0-9]{{1,4}}[).]') GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2")
def running_furniture(t: Tables) -> DataFrame:
    return docs.furniture(lines(t).select(F.col("source").alias("scope"), F.col("line").alias("text"), F.col("doc_id").alias("page")))


@query(f"WITH {LINES}, r AS (SELECT doc_id, page, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS size FROM lines) SELECT doc_id, page::INT AS page, size::BIGINT AS size FROM r WHERE size <= 1000")
def line_budget(t: Tables) -> DataFrame:
    return rel.line_budget(lines(t), ["doc_id"], "page", 1000).select("doc_id", "page", "size")


@query("""WITH n AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS p FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS q FROM benchmark)
 SELECT item_id, doc_id FROM b JOIN n ON contains(p, ' ' || q || ' ')""")
def quote_on_text(t: Tables) -> DataFrame:
    return docs.quotes_on_texts(t.benchmark.select("item_id", F.col("text").alias("quote")), t.documents.select("doc_id", "text"))


SHORT = ("the of", "was", "und der die", "no such words here")


@query("""WITH n AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS p FROM documents), b(item_id, q) AS (VALUES """ + ", ".join(f"({i}, '{x}')" for i, x in enumerate(SHORT)) + """)
 SELECT item_id, doc_id FROM b JOIN n ON contains(p, ' ' || q || ' ')""")
def short_quotes(t: Tables) -> DataFrame:
    quotes = t.spark.createDataFrame(list(enumerate(SHORT)), "item_id int, quote string")
    return docs.quotes_on_texts(quotes, t.documents.select("doc_id", "text"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.;:]\\s+')) AS x FROM documents) SELECT doc_id, count(*) AS sentences FROM s WHERE contains(lower(x), 'icen') GROUP BY doc_id""")
def obligation_gaps(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.explode(F.split("text", r"[.;:]\s+")).alias("x"))
    return s.where(F.contains(F.lower("x"), F.lit("icen"))).groupBy("doc_id").agg(F.count("*").alias("sentences"))


@query("SELECT doc_id, substr(sha256(lang || chr(31) || source), 1, 12) AS id, (length(text) >= 100) AS has_text, length(trim(text)) >= 20 AS native FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.content_id("lang", "source").alias("id"), (F.length("text") >= 100).alias("has_text"), (F.length(F.trim("text")) >= 20).alias("native"))


@query(f"""WITH {LINES}, g AS (SELECT doc_id, list([n, page] ORDER BY n, page) AS l FROM (SELECT doc_id, page::BIGINT AS page, length(line)::BIGINT AS n FROM lines) GROUP BY doc_id),
 f AS (SELECT doc_id, l, list_reduce(l, lambda a, x: [a[1] - least(x[1], a[1] // (len(l) - a[2])), a[2] + 1] || a[3:] || [least(x[1], a[1] // (len(l) - a[2]))], [2000::BIGINT, 0]) AS r FROM g)
 SELECT doc_id, unnest(list_transform(l, lambda x: x[2]))::INT AS i, unnest(r[3:]) AS share FROM f""")
def water_fill_shares(t: Tables) -> DataFrame:
    by = lines(t).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", F.length("line").alias("n")))), lambda x: x["n"]).alias("lengths"))
    return by.select("doc_id", F.inline(rel.water_fill(F.col("lengths"), 2000)))


@query(r"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -p_partkey, repeat('1. Heading text' || chr(10), p_size) || repeat('x', (p_partkey % 50) * 100) FROM part),
 n AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^\s*(?:[0-9]+\.|PART|Annex)\s*\S'))::BIGINT AS headings, length(text)::BIGINT AS chars FROM d) SELECT * FROM n WHERE headings >= 8 AND chars < 200 * headings""")
def contents_like(t: Tables) -> DataFrame:
    """Whole documents, and tables of contents made of parts."""
    made = t.part.select((-F.col("p_partkey")).alias("doc_id"), F.concat(F.expr("repeat('1. Heading text\\n', p_size)"), F.expr("repeat('x', cast(p_partkey % 50 * 100 as int))")).alias("text"))
    return docs.contents_like(t.documents.select("doc_id", "text").unionByName(made))
