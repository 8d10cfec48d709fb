"""Layout blocks made of the parts' names and keys, split into their pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splits
from .base import Tables, registrar

QUERIES, ORACLE_SQL, query = registrar()

#: (kind, text, pieces): a bar stands between pieces, a plus sign before one that opens a list; {k} is a part's name.
BLOCKS = (
    ("table", "(a) Name of {k} (b) Contact (i) phone: (ii) fax of Paragraph 3(c) and Clause (c) (c) End", "(a) Name of {k}|(b) Contact|+(i) phone:|(ii) fax of Paragraph 3(c) and Clause (c)|(c) End"),
    ("table", "Row 1.* {k} 2. # Packing 0.5% 14. pH of 0.5", "Row|1.* {k}|2. # Packing 0.5%|14. pH of 0.5"),
    ("text", "(a) (i) for {k} only", "(a)|(i) for {k} only"),
    ("text", "(h) (i) goes on after {k}", "(h) (i) goes on after {k}"),
    ("text", "Notes: (1)  ^ tick {k}", "Notes:|(1)  ^ tick {k}"),
    ("list-item", "(c) where (i) a claim on {k}; (ii) grounds that (a) x is new or (b) y is old; or (iii) an end, has come", "(c) where|+(i) a claim on {k};|(ii) grounds that|+(a) x is new or|(b) y is old; or|(iii) an end, has come"),
    ("text", "within two (2) weeks of {k} under Paragraphs (a) and (b) or items (1) to (2)", "within two (2) weeks of {k} under Paragraphs (a) and (b) or items (1) to (2)"),
    ("text", "{k} says (a) and (b) apply", "{k} says (a) and (b) apply"),
)


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rows() -> str:
    return ", ".join(f"({i}, {n}, {_sql(p.removeprefix('+'))}, {str(p.startswith('+')).lower()})" for i, (_, _, said) in enumerate(BLOCKS) for n, p in enumerate(said.split("|")))


@query(f"WITH v(i, ord, piece, opens) AS (VALUES {_rows()}) SELECT p_partkey, ord::INT AS ord, replace(piece, '{{k}}', p_name) AS piece, opens FROM part JOIN v ON p_partkey % {len(BLOCKS)} = i")
def block_pieces(t: Tables) -> DataFrame:
    at = (F.col("p_partkey") % len(BLOCKS) + 1).cast("int")
    text = F.replace(F.element_at(F.array(*[F.lit(b[1]) for b in BLOCKS]), at), F.lit("{k}"), F.col("p_name"))
    made = t.part.select("p_partkey", text.alias("text"), F.element_at(F.array(*[F.lit(b[0]) for b in BLOCKS]), at).alias("kind"))
    return splits.pieces(made).select("p_partkey", "ord", "piece", "opens")


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 3) AS slipped FROM orders")
def displaced_markers(t: Tables) -> DataFrame:
    """Sentences in which the marker 7.n or (n-th letter) slipped in, is cited, is glued, or comes too late."""
    n = (F.col("o_orderkey") % 9 + 1).cast("string")
    bare, letter = F.concat(F.lit("7."), n), F.substring(F.lit("abcdefghi"), n.cast("int"), F.lit(1))
    kind = F.col("o_orderkey") % 6
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    text = (
        F.when(kind == 0, said("A Tender will not be considered if it ", bare, " expressly indicates. More"))
        .when(kind == 1, said("A Tender under Paragraph ", bare, " above is late"))
        .when(kind == 2, said("Paragraphs 20.1(a) to 20.1(", letter, ") above"))
        .when(kind == 3, said("in the opinion (", letter, ") of the authority"))
        .when(kind == 4, said("First sentence. The ", bare, " comes after it"))
        .otherwise(said("word " * 40, bare, " too late"))
    )
    marker, bracketed = F.when(kind.isin(2, 3), letter).otherwise(bare), kind.isin(2, 3)
    return t.orders.select("o_orderkey", splits.displaced(text, marker, bracketed).alias("slipped"))
