"""Document structure: furniture, contents pages, segments, markers, citations, reading lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, padded
from ..lineage import spread
from .relational import islands

#: Quotes, and bytes of them, that may go to every text.
FEW_QUOTES, FEW_BYTES = 1000, 1 << 20
MARKER = r"^\(?[a-z0-9]{1,4}[).]"


def furniture(lines: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, text, pages): text of at least 8 characters on two or more pages of a scope that is no marker."""
    f = lines.where((F.length("text") >= 8) & ~F.col("text").rlike(MARKER)).groupBy(scope, "text").agg(F.count_distinct("page").alias("pages"))
    return f.where("pages >= 2")


def contents_like(docs: DataFrame, headings: int = 8, per_heading: int = 200) -> DataFrame:
    """Texts with many headings and little text for each."""
    n = F.regexp_count("text", F.lit(r"(?m)^\s*(?:[0-9]+\.|PART|Annex)\s*\S"))
    return docs.select("doc_id", n.cast("long").alias("headings"), F.length("text").cast("long").alias("chars")).where((F.col("headings") >= headings) & (F.col("chars") < per_heading * F.col("headings")))



def quotes_on_texts(quotes: DataFrame, texts: DataFrame, head: int = 6) -> DataFrame:
    """(item_id, doc_id) of quotes whose words are a run of a text's. quotes: item_id, quote; texts: doc_id, text.

    Few quotes (FEW_QUOTES, counted) go to the texts, which are neither moved nor taken apart. Of more, hashes of a quote's first
    words, as many as it has up to `head`, meet the hashes of equally long runs of each text; rows of the exchange hold
    two numbers. Only the candidates' texts are fetched, and the whole quote is looked for. Quotes without words are on no text.
    """
    q = quotes.select("item_id", normalise("quote").alias("q")).where("q <> ''")
    many, size = q.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("q")), F.lit(0))).first()
    if many <= FEW_QUOTES and size <= FEW_BYTES:
        on = texts.select("doc_id", padded("text").alias("p")).join(F.broadcast(q), F.contains("p", F.concat(F.lit(" "), "q", F.lit(" "))))
        return on.where("doc_id is not null").select("item_id", "doc_id").distinct()
    q = q.withColumn("w", F.split("q", " "))
    q = q.withColumn("n", F.least(F.size("w"), F.lit(head)))
    key = lambda at: F.expr(f"case n {' '.join(f'when {k} then xxhash64({k}, ' + ', '.join(f'get(w, {at} + {j})' for j in range(k)) + ')' for k in range(1, head + 1))} end")
    q = q.select("item_id", "q", "n", key("0").alias("h"))
    widths = [r["n"] for r in q.select("n").distinct().collect()]
    t = texts.select("doc_id", F.split(normalise("text"), " ").alias("w"))
    runs = None
    for k in widths:
        at = F.expr(f"transform(sequence(0, size(w) - {k}), i -> xxhash64({k}, " + ", ".join(f"get(w, i + {j})" for j in range(k)) + "))")
        one = t.where(F.size("w") >= k).select("doc_id", F.explode(F.array_distinct(at)).alias("h"))
        runs = one if runs is None else runs.unionByName(one)
    if runs is None:
        return quotes.join(texts).select("item_id", "doc_id").limit(0)
    found = runs.join(q.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    wanted = texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", padded("text").alias("p"))
    out = found.join(q.select("item_id", "q"), "item_id").join(wanted, "doc_id")
    return out.where(F.contains("p", F.concat(F.lit(" "), "q", F.lit(" ")))).select("item_id", "doc_id").distinct()


_ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]


def follows(a: str, b: str) -> bool:
    """b is the next marker after a: the next letter, or the next roman numeral."""
    if len(a) == len(b) == 1 and ord(b) == ord(a) + 1:
        return True
    return a in _ROMAN and b in _ROMAN and _ROMAN.index(b) == _ROMAN.index(a) + 1


def longest_chain(markers: list[str]) -> list[int]:
    """Indexes of the longest chain of successive markers from (a); the later start wins ties."""
    best: list[int] = []
    reach: list[list[int] | None] = [None] * len(markers)
    for i, m in enumerate(markers):
        found = [i] if m == "a" else None
        for j in range(i):
            if reach[j] and len(markers[j]) == len(m) == 1 and ord(m) == ord(markers[j]) + 1 and (found is None or len(reach[j]) + 1 >= len(found)):
                found = [*reach[j], i]
        reach[i] = found
        if found and (len(found) > len(best) or len(found) == len(best) and found[0] > best[0]):
            best = found
    return best


def levels(markers: list[str]) -> list[int]:
    """Nesting depth of sub-item markers: the successor of an open level closes what is below; any other opens a level."""
    open_: list[str] = []
    out = []
    for m in markers:
        at = next((i for i in range(len(open_) - 1, -1, -1) if follows(open_[i], m)), None)
        if at is None:
            open_.append(m)
        else:
            open_ = [*open_[:at], m]
        out.append(len(open_) - 1)
    return out


def reading_lines(items: list[tuple[float, float]]) -> list[int]:
    """Line numbers of (top, bottom) in order: an item joins while its centre lies within half the taller height of the line's mean centre."""
    out, line, centres, tall = [], -1, [], 0.0
    for top, bottom in items:
        c, h = (top + bottom) / 2, bottom - top
        if centres and abs(c - sum(centres) / len(centres)) <= max(tall, h) / 2:
            centres.append(c)
            tall = max(tall, h)
        else:
            line, centres, tall = line + 1, [c], h
        out.append(line)
    return out


def per_group(df: DataFrame, keys: list[str], order: str, column: str, name: str, kind: str, fn) -> DataFrame:
    """Adds name: fn over a group's ordered values, a number each. Groups are single clauses or blocks, an array each; thousands
    of them go through Python together."""

    @F.pandas_udf(f"array<{kind}>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([fn(list(x)) for x in values])

    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (*keys, order)])))
    by = spread(df, *keys).groupBy(*keys).agg(rows.alias("_rows")).withColumn("_out", run(F.col(f"_rows.{column}")))
    one = by.select(*keys, F.explode(F.arrays_zip("_rows", "_out")).alias("_x")).select(*keys, "_x._rows.*", F.col("_x._out").alias(name))
    return one.select(*df.columns, name)
