"""Document structure over pages and texts made of the parts' keys: forms that the driver's invented prose doesn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents as docs
from ..operators import structure
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()

#: Pages of each made file: 16, one for each part key.
PER_FILE = 16


def zh(n: F.Column) -> F.Column:
    """Chinese numerals of 1 to 999."""
    digit = lambda d: F.substring(F.lit("零一二三四五六七八九"), (d + 1).cast("int"), F.lit(1))
    h, t, u = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    some = lambda when, x: F.when(when, x).otherwise("")
    tens = F.when(t > 0, F.concat(some((t > 1) | (h > 0), digit(t)), F.lit("十"))).otherwise(some((h > 0) & (u > 0), F.lit("零")))
    return F.concat(some(h > 0, F.concat(digit(h), F.lit("百"))), tens, some(u > 0, digit(u)))


def pages(t: Tables) -> DataFrame:
    """file, page, text: files that begin with a cover, then hold three sub-documents in the forms of numbering."""
    k = F.col("p_partkey")
    p = t.part.select(F.floor(k / PER_FILE).alias("f"), (k % PER_FILE + 1).cast("int").alias("page"), "p_name")
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    page, f = F.col("page"), F.col("f")
    text = (
        F.when(page.isin(2, 3), said("3.2 Terms of Tender Page ", page - 1, " of 3"))
        .when(page == 4, said(F.col("p_name"), "\nTerms  of Tender\n\t Page 3 of 3"))
        .when(page.isin(9, 10), said("Ref. No. T-", f, " (June 2025)\nPage ", page - 8, " of 2\n", F.col("p_name")))
        .when(page.isin(11, 12), said("Page ", page - 10, " of 2\nG.F. ", f, " (Rev. 02/25)\n", F.col("p_name")))
        .when(page > 12, said("第", zh(page - 12 + f % 90 * 10), "頁，共", zh(F.lit(940)), "頁\nG.F. ", f, " (Rev.02/25)\n", F.col("p_name")))
        .when(page == 8, F.lit(None).cast("string"))
        .otherwise(F.col("p_name"))
    )
    return p.select(f.cast("string").alias("file"), "page", text.alias("text"))


MADE = """p AS (SELECT p_partkey // 16 AS f, (p_partkey % 16 + 1)::INT AS page FROM part),
 n AS (SELECT f::VARCHAR AS file, f, page, CASE WHEN page BETWEEN 2 AND 4 THEN page - 1 WHEN page IN (9, 10) THEN page - 8 WHEN page IN (11, 12) THEN page - 10 WHEN page > 12 THEN page - 12 + f % 90 * 10 END::INT AS printed_page,
  CASE WHEN page BETWEEN 2 AND 3 THEN 'Terms of Tender' WHEN page = 4 THEN 'Terms  of Tender' WHEN page IN (9, 10) THEN 'Ref. No. T-' || f || ' (June 2025)' WHEN page IN (11, 12) THEN 'G.F. ' || f || ' (Rev. 02/25)' WHEN page > 12 THEN 'G.F. ' || f || ' (Rev.02/25)' END AS name FROM p)"""


@query(f"WITH {MADE} SELECT file, page, name, printed_page, CASE WHEN page < 5 THEN 3 WHEN page < 13 THEN 2 ELSE 940 END::INT AS pages FROM n WHERE name IS NOT NULL")
def page_footers(t: Tables) -> DataFrame:
    return pages(t).select("file", "page", structure.page_footer(F.col("text")).alias("f")).where("f is not null").select("file", "page", "f.*")


@query(f"WITH {MADE} SELECT file, page, CASE WHEN page IN (9, 10) THEN 'T-' || f END AS ref_no, CASE WHEN page IN (9, 10) THEN 'June 2025' END AS edition, printed_page FROM n WHERE name IS NOT NULL")
def page_identities(t: Tables) -> DataFrame:
    df = pages(t).select("file", "page", structure.page_identity(F.col("text")).alias("i")).where("i.printed_page is not null")
    return df.select("file", "page", "i.ref_no", "i.edition", "i.printed_page")


@query(f"""WITH {MADE} SELECT file, page, CASE WHEN page BETWEEN 2 AND 7 THEN 'Terms of Tender' WHEN page IN (9, 10) THEN name WHEN page > 10 THEN CASE WHEN page > 12 AND printed_page - page + 12 = 0 THEN name ELSE 'G.F. ' || f || ' (Rev. 02/25)' END END AS name,
 CASE WHEN page = 1 THEN 1 WHEN page < 9 THEN 2 WHEN page < 11 THEN 3 WHEN page > 12 AND f % 90 = 0 THEN 5 ELSE 4 END::BIGINT AS segment FROM n""")
def page_segments(t: Tables) -> DataFrame:
    return structure.subdocuments(pages(t))


#: A document with lists of annexes, parts that are only named, a contents line, figures and repeated marks.
TEXT = (
    "Annex A to the Terms", "Annex B to the Terms", "Annex C to the Terms", "PART 1 — TERMS OF TENDER", "PART 2 - CONDITIONS", "1. Definitions of {k}", "1.1 The words mean this.", "(a) first", " (b) second", "93.70 Index of prices",
    "0.3 Ratio", "2.", "Offers", "2.1", "\"Offers\" are sealed. ", "19.5 of the conditions", "PART THE", "LAST", "x" * 320, "Annex D", "Form of offer", "Annex E to the Terms of {k}", "", "Undertaking", "1. Signature", "(a) of the tenderer", "(iii) third", "(abc) no mark",
    "1. Signature", "(a) again", "(a) once more", "PART IV", "MEMORANDUM", "Annex F to the Terms", "Page 1 of 2",
)
FOUND = (
    ("d", "part 2", "part", "CONDITIONS"), ("part 2", "1", "clause", "Definitions of {k}"), ("part 2:1", "1.1", "subclause", None), ("part 2:1:1.1", "a", "subitem", None), ("part 2:1:1.1", "b", "subitem", None), ("part 2", "2", "clause", "Offers"),
    ("part 2:2", "2.1", "subclause", None), ("d", "annex E", "annex", "Undertaking"), ("annex E", "1", "clause", "Signature"), ("annex E:1", "a", "subitem", None), ("annex E:1", "iii", "subitem", None), ("annex E", "1#2", "clause", "Signature"), ("annex E:1#2", "a", "subitem", None), ("annex E:1#2", "a#2", "subitem", None), ("d", "part IV", "part", "MEMORANDUM"),
)


def _sql(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"""WITH v(up, own, kind, title) AS (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in FOUND)})
 SELECT p_partkey::VARCHAR || CASE up WHEN 'd' THEN '' ELSE ':' || up END AS parent, p_partkey::VARCHAR || CASE up WHEN 'd' THEN '' ELSE ':' || up END || ':' || own AS id, kind, replace(title, '{{k}}', p_name) AS title FROM part, v""")
def node_table(t: Tables) -> DataFrame:
    """A made text for each part, its name in the places of k."""
    text = F.replace(F.lit("\n".join(TEXT)), F.lit("{k}"), F.col("p_name"))
    made = t.part.select(F.col("p_partkey").cast("string").alias("doc"), text.alias("text"))
    return structure.node_table(structure.real_marks(structure.found_marks(made))).select("parent", "id", "kind", "title")


CHAINS = {"intro": "a c a b c d", "roman": "a b i ii iii c", "item i": "a b c d e f g h i j", "v": "s t u i ii iii iv v", "x": "w ix x x y", "late": "b c d a b"}
KEPT = {"intro": (2, 3, 4, 5), "roman": (0, 1, 5), "item i": tuple(range(10)), "v": (0, 1, 2), "x": (0, 3, 4), "late": (0, 1, 2)}


@query(f"""WITH v(n, ord) AS (VALUES {", ".join(f"({n}, {i})" for n, k in enumerate(KEPT.values()) for i in k)}) SELECT p_partkey AS part, ord::INT AS ord FROM part JOIN v ON p_partkey % {len(CHAINS)} = n""")
def schedule_items(t: Tables) -> DataFrame:
    """Each part's key chooses the marks of its schedule."""
    said = F.element_at(F.array(*[F.lit(x) for x in CHAINS.values()]), (F.col("p_partkey") % len(CHAINS) + 1).cast("int"))
    df = t.part.select(F.col("p_partkey").alias("part"), F.posexplode(F.split(said, " ")).alias("ord", "marker"))
    return docs.per_group(df, ["part"], "ord", "marker", "item", "boolean", structure.item_chain).where("item").select("part", "ord")
