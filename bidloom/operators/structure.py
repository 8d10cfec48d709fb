"""From page texts to a table of nodes: page footers, sub-documents, marks, their places and parents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once
from .relational import islands
from .reviews import apart_annexes, one_mark, parts_with_content, real_subclauses

# How page numberings are printed, Chinese digits by value and the letters of roman numbers.
NUMBERING, ZH_NUMBERING = r"Page\s+(\d+)\s+of\s+(\d+)", r"第([^第頁]+)頁，共([^第頁]+)頁"
ZH_DIGITS, ROMAN = "零一二三四五六七八九", "IVX"
#: Characters of a name that stands in front of a numbering, and of one on a line of its own.
NAME_BEFORE, NAME_LINE = (5, 46), (4, 61)
#: Pages without a footer belong to the sub-document before them, so many of them at most.
CARRY = 3


def zh_number(text: Column) -> Column:
    """A number below a thousand in Chinese numerals: what stands before the hundred, before the ten and behind both; a
    unit without a digit before it is one of it, and without units the last digit counts."""
    digit = lambda c: F.greatest(F.instr(F.lit(ZH_DIGITS), F.right(c, F.lit(1))) - 1, F.lit(0))
    many = lambda c: F.when(F.regexp_replace(c, "[零〇]", "") == "", 1).otherwise(digit(c))

    def below(x: Column) -> Column:
        tens = F.when(F.contains(x, F.lit("十")), many(F.substring_index(x, "十", 1)) * 10).otherwise(0)
        return tens + F.when(x == "", 0).otherwise(digit(F.substring_index(x, "十", -1)))

    hundreds = F.when(F.contains(text, F.lit("百")), many(F.substring_index(text, "百", 1)) * 100).otherwise(0)
    return (hundreds + once(F.substring_index(text, "百", -1), below)).cast("int")


def page_footer(text: Column) -> Column:
    """struct<name, printed_page, pages> of a page's numbering; null without any that has a name.

    A name is looked for, in this order and each over the whole page: in front of "Page n of m" on its line or, where that is
    blank, at the end of the line above: words of letters, brackets and hyphens from a capital on; the whole line above
    a numbering that begins its line; the line below one that ends its line, unless it is the page's last; and the
    line below a Chinese numbering.
    """
    fits = lambda x, most: F.length(x).between(*most)

    def read(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
        number = lambda x, rx, k: F.regexp_extract(x, rx, k)
        words = lambda x: F.regexp_extract(F.right(x, F.lit(NAME_BEFORE[1])), r"[A-Z][A-Za-z ()-]*$", 0)
        made = lambda name, page, pages: F.struct(name.alias("name"), page.cast("int").alias("printed_page"), pages.cast("int").alias("pages"))

        def line(x: Column, i: Column) -> Column:
            head = F.rtrim(F.regexp_extract(x, rf"^(.*?)\s*{NUMBERING}", 1))
            above, below = F.when(i > 0, at(i - 1)).otherwise(""), F.when(i + 2 < F.size(lines), at(i + 1)).otherwise("")
            one = lambda name: made(name, number(x, NUMBERING, 1), number(x, NUMBERING, 2))
            here = once(F.rtrim(words(F.when(head == "", above).otherwise(head))), lambda n: F.when(fits(n, NAME_BEFORE), one(n)))
            over = F.when((head == "") & fits(above, NAME_LINE) & ~above.rlike(f"^{NUMBERING}"), one(above))
            under = F.when(x.rlike(f"{NUMBERING}$") & fits(below, NAME_LINE), one(below))
            zh = made(below, zh_number(number(x, ZH_NUMBERING, 1)), zh_number(number(x, ZH_NUMBERING, 2)))
            found = F.when(x.rlike(NUMBERING), F.array(here, over, under, F.lit(None).cast(FOOTER)))
            return F.coalesce(found, F.array(*[F.lit(None).cast(FOOTER)] * 3, F.when(fits(below, NAME_LINE), zh)))

        numbered = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(NUMBERING) | x.rlike(f"{ZH_NUMBERING}$"), line(x, i))), lambda x: x.isNotNull())
        by_form = lambda k: F.get(F.filter(F.transform(numbered, lambda f: f[k]), lambda f: f.isNotNull()), F.lit(0))
        return F.coalesce(*[by_form(k) for k in range(4)])

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))))
    # Pages without a numbering are not taken apart.
    return F.when(text.rlike(NUMBERING) | text.rlike(ZH_NUMBERING), once(lines, read))


FOOTER = "struct<name:string,printed_page:int,pages:int>"


def page_identity(text: Column) -> Column:
    """struct<ref_no, edition, name, printed_page, pages>: the reference number and edition in "Ref. No. X (edition)", the
    footer's name, and the numbering, which counts without a name too."""
    flat = F.regexp_replace(text, r"\s+", " ")
    ref = lambda k: F.nullif(F.trim(F.regexp_extract(flat, r"(?i)\bref\. ?no\. ?([a-z0-9][a-z0-9-]*) ?\(([^)]+)\)", k)), F.lit(""))
    bare = lambda k: F.nullif(F.regexp_extract(text, NUMBERING, k), F.lit("")).cast("int")
    made = lambda f: F.struct(ref(1).alias("ref_no"), ref(2).alias("edition"), f["name"].alias("name"), F.coalesce(f["printed_page"], bare(1)).alias("printed_page"), F.coalesce(f["pages"], bare(2)).alias("pages"))
    return once(page_footer(text), made)


def subdocuments(pages: DataFrame) -> DataFrame:
    """file, page, name, segment: pages by the sub-document their footers name. pages: file, page, text.

    A new one begins at page 1 of a numbering, at the first footer and where the name changes, its blanks aside; pages
    without a footer belong to the one before, CARRY of them at most, and to none beyond.
    """
    w = Window.partitionBy("file").orderBy("page")
    df = pages.select("file", "page", page_footer(F.col("text")).alias("f")).select("file", "page", "f.*")
    df = df.withColumn("key", F.regexp_replace("name", r"\s+", ""))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    df = df.withColumn("before", last("key", w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("key").isNotNull() & ((F.col("printed_page") == 1) | F.col("before").isNull() | (F.col("key") != F.col("before")))
    df = islands(df.withColumn("begins", begins), ["file"], "page", F.col("begins"))
    # The name is that of the segment's first page, however later pages space it.
    df = df.withColumn("name", F.coalesce("name", last("name", w.rowsBetween(-CARRY, 0))))
    first = F.first("name", ignorenulls=True).over(Window.partitionBy("file", "segment").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return df.select("file", "page", F.when(F.col("name").isNotNull(), first).alias("name"), "segment")


def _leading(s: str, of: str) -> str:
    """The characters of `of` that s begins with."""
    return s[: len(s) - len(s.lstrip(of))]


_DIGITS, _UPPER, _LOWER, _BLANK = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t"


def line_mark(line: str, below: str, further: str) -> tuple[str, str, str | None] | None:
    """(kind, number, title) if a line, without blanks before it, begins with a mark; below, further: the two lines behind it.

    By what the line begins with: PART and digits with a capital perhaps, or a roman number, its title on the next line (part)
    or behind an em dash or hyphen (part_inline); Annex with its mark and "to the", its title on one of the next two
    lines, unless that is a page's numbering; digits and a full stop (clause); digits with full stops between them
    (subclause), both before a capital on the line or the next, a sub-clause also before a bracket or quotation mark;
    one or two small letters, or up to four of i, v and x, in brackets (subitem).
    """
    capital = lambda s: s[:1] in _UPPER and s != ""
    below, further = below.strip(_BLANK), further.strip(_BLANK)
    word, _, rest = line.replace("\t", " ").partition(" ")
    rest = rest.strip(_BLANK)
    if word == "PART":
        number = _leading(rest, _DIGITS)
        number = number + rest[len(number) : len(number) + 1] * (number != "" and capital(rest[len(number) :])) if number else _leading(rest, ROMAN)
        tail = rest[len(number) :].strip(_BLANK)
        if number and not tail and capital(below):
            return "part", number, below
        if number and tail[:1] in ("—", "-") and capital(tail[1:].lstrip(_BLANK)):
            return "part_inline", number, tail[1:].strip(_BLANK)
    elif word == "Annex":
        said = rest.split()
        title = below or further
        if len(said) >= 3 and said[0].isascii() and said[0].isalnum() and said[0] == said[0].upper() and said[1] == "to" and said[2].rstrip(",.;:") == "the" and capital(title):
            if not (title.split()[:1] == ["Page"] and title.split()[2:3] == ["of"]):
                return "annex", said[0], title
    elif line[:1] in _DIGITS and line:
        number = _leading(line, _DIGITS + ".")
        tail = line[len(number) :].strip(_BLANK)
        title = tail or below
        if number.count(".") == 1 and number.endswith(".") and capital(title):
            return "clause", number[:-1], title
        opens = title[1:] if title[:1] in ('"', "'", "(") else title
        apart = line[len(number) : len(number) + 1] in ("", " ", "\t")
        if "." in number and all(number.split(".")) and apart and capital(opens):
            return "subclause", number, None
    elif line[:1] == "(":
        mark, closed, _ = line[1:].partition(")")
        if closed and mark and (len(mark) <= 2 and not mark.strip(_LOWER) or len(mark) <= 4 and not mark.strip("ivx")):
            return "subitem", mark, None
    return None


def found_marks(docs: DataFrame) -> DataFrame:
    """(doc, offset, kind, number, title) of all that looks like a mark, in one pass over the lines of whole texts; offset: where the
    mark begins. docs: doc, text; null texts have none."""

    def of(text: str) -> Iterator[tuple]:
        lines, at = text.split("\n"), 0
        for i, line in enumerate(lines):
            own = line.lstrip(_BLANK)
            found = line_mark(own, *[*lines[i + 1 : i + 3], "", ""][:2])
            if found:
                yield at + len(line) - len(own), *found
            at += len(line) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(d, *m) for d, t in zip(df["doc"], df["text"], strict=True) for m in of(t or "")]
            yield pd.DataFrame(rows, columns=["doc", "offset", "kind", "number", "title"])

    return docs.select("doc", "text").mapInPandas(run, "doc string, offset int, kind string, number string, title string")


def real_marks(marks: DataFrame) -> DataFrame:
    """Marks without lists of annexes, without parts that are only named, one for each place, without decimals."""
    return real_subclauses(one_mark(parts_with_content(apart_annexes(marks))))


def node_table(marks: DataFrame) -> DataFrame:
    """id, parent, kind, number, title, doc, offset: every mark as a node below what is open where it stands.

    A part or annex opens a scope and closes all below it, a clause closes sub-clauses, a sub-clause sub-items. Open levels
    are running values of windows by document, so no text is read again. Ids are paths, minted from the top: a mark that
    comes again below the same node gets #2, #3, and so do all paths through it, so that children of repeats are apart.
    """
    w = Window.partitionBy("doc").orderBy("offset")
    scope, clause, sub = F.col("kind").isin("part", "annex"), F.col("kind") == "clause", F.col("kind") == "subclause"
    df = marks.withColumn("_s", F.sum(scope.cast("int")).over(w))
    df = df.withColumn("_c", F.sum(clause.cast("int")).over(Window.partitionBy("doc", "_s").orderBy("offset")))
    df = df.withColumn("_b", F.sum(sub.cast("int")).over(Window.partitionBy("doc", "_s", "_c").orderBy("offset")))
    name = F.concat(F.when(scope, F.concat("kind", F.lit(" "))).otherwise(""), "number")
    # What a mark is repeated below: the document, its scope, its clause or its sub-clause.
    below = F.when(scope, F.array("doc")).when(clause, F.array("doc", "_s")).when(sub, F.array("doc", "_s", "_c")).otherwise(F.array("doc", "_s", "_c", "_b"))
    nth = F.row_number().over(Window.partitionBy("_below", "_level", "_name").orderBy("offset"))
    level = F.when(scope, 0).when(clause, 1).when(sub, 2).otherwise(3)
    df = df.withColumns({"_name": name, "_level": level, "_below": F.transform(below, lambda x: x.cast("string"))}).withColumn("_n", nth)
    df = df.withColumn("_name", F.concat("_name", F.when(F.col("_n") > 1, F.concat(F.lit("#"), F.col("_n").cast("string"))).otherwise("")))
    opened = lambda keys, is_: F.max(F.when(is_, F.col("_name"))).over(Window.partitionBy("doc", *keys))
    df = df.withColumns({"_scope": opened(["_s"], scope), "_clause": opened(["_s", "_c"], clause), "_sub": opened(["_s", "_c", "_b"], sub)})
    up = F.when(scope, F.array("doc")).when(clause, F.array("doc", "_scope")).when(sub, F.array("doc", "_scope", "_clause")).otherwise(F.array("doc", "_scope", "_clause", "_sub"))
    df = df.withColumn("_path", F.array_join(F.filter(up, lambda x: x.isNotNull()), ":"))
    return df.select(F.concat("_path", F.lit(":"), F.col("_name")).alias("id"), F.col("_path").alias("parent"), "kind", "number", "title", "doc", "offset")


_ROMAN_BEFORE = {"v": "iv", "x": "ix"}


def item_chain(markers: list[str]) -> list[bool]:
    """Which markers open the items of a schedule: the longest run of single letters that go up by one, the later one
    wherever two could go on with it. Roman sub-items are none: an (i) with (ii) behind it, a (v) after (iv), an (x)
    after (ix), each before the next single letter."""
    single = [i for i, m in enumerate(markers) if len(m) == 1]
    own = []
    for n, i in enumerate(single):
        behind = markers[i + 1 : single[n + 1] if n + 1 < len(single) else None]
        before = markers[single[n - 1] + 1 if n else 0 : i]
        if not (markers[i] == "i" and "ii" in behind or _ROMAN_BEFORE.get(markers[i], "") in before and markers[i] in _ROMAN_BEFORE):
            own.append(i)
    best: dict[str, tuple[int, int]] = {}  # letter: the longest run that ends with it, and where
    prior: dict[int, int | None] = {}
    end = None
    for i in own:
        n, at = best.get(chr(ord(markers[i]) - 1), (0, None))
        prior[i] = at
        if n + 1 >= best.get(markers[i], (0, 0))[0]:
            best[markers[i]] = (n + 1, i)
        if end is None or n + 1 >= end[0]:
            end = (n + 1, i)
    kept, at = set(), end[1] if end else None
    while at is not None:
        kept.add(at)
        at = prior[at]
    return [i in kept for i in range(len(markers))]
