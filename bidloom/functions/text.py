"""Text functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocab import META_SUFFIXES, MONTHS


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, body) -> Column:
    """body(v) with value evaluated once per row; a lambda also keeps long bodies out of generated methods, which the JVM
    doesn't compile beyond a certain length."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain(x: Column) -> Column:
    """A number without needless decimals."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).otherwise(x.cast("string"))


def normalise(text: Column | str) -> Column:
    """Lower case, all but a-z and 0-9 to single spaces, month names to three letters."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(col(text).cast("string"), F.lit(""))), "[^a-z0-9]+", " "))
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    # Only texts with the name of a month are taken apart.
    short = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(F.try_element_at(months, w), w)), " ")
    return once(flat, lambda x: F.when(x.rlike(r"\b(" + "|".join(MONTHS) + r")\b"), short(x)).otherwise(x))


def padded(text: Column | str) -> Column:
    """The normal form between blanks: runs of whole words are then plain parts of it."""
    return F.concat(F.lit(" "), normalise(text), F.lit(" "))


def contains_words(text: Column | str, phrase: Column | str) -> Column:
    """phrase is a run of whole words of text; a blank phrase never is."""
    return (normalise(phrase) != "") & F.contains(padded(text), padded(phrase))


def agree(a: Column | str, b: Column | str) -> Column:
    """Two readings agree: equal, both blank, or one is a run of whole words of the other."""
    same = lambda n: (n["a"] == n["b"]) | ((n["a"] != "  ") & F.contains(n["b"], n["a"])) | ((n["b"] != "  ") & F.contains(n["a"], n["b"]))
    return once(F.struct(padded(a).alias("a"), padded(b).alias("b")), same)


def number(value: Column | str) -> Column:
    """The first number of a text, thousands commas dropped; null without one."""
    return _number(col(value))


def _number(value: Column) -> Column:
    found = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"-?\d[\d,]*(?:\.\d+)?", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def equal(value: Column, expected: Column) -> Column:
    """Numbers within half a percent of the expected one; other readings by agreement."""
    a, b = _number(value), _number(expected)
    numeric = expected.cast("string").rlike(r"^[\d,.\s]+$")
    near = lambda n: F.when(n["a"].isNotNull() & n["b"].isNotNull(), F.abs(n["a"] - n["b"]) <= F.greatest(0.005 * F.abs(n["b"]), F.lit(1e-9)))
    return F.coalesce(F.when(numeric, once(F.struct(a.alias("a"), b.alias("b")), near)), agree(value, expected))


def decimal_places(text: Column | str) -> Column:
    """Decimal places of each figure as written; dates are none; a comma is decimal only before a percent sign."""
    figures = F.regexp_extract_all(F.coalesce(col(text).cast("string"), F.lit("")), F.lit(r"\d+(?:[.,]\d+)*(?:\s*%)?"), F.lit(0))
    figures = F.filter(figures, lambda x: ~x.rlike(r"\..*\.") & ~F.regexp_replace(x, r"\s*%", "").rlike(r"^\d{1,2}[.,]\d{1,2}[.,]\d{2,4}$"))

    def places(x: Column) -> Column:
        bare = F.regexp_replace(x, r"\s*%", "")
        return (
            F.when(F.contains(bare, F.lit(".")), F.length(F.substring_index(bare, ".", -1)))
            .when(x.rlike("%$") & bare.rlike(r"^\d+,\d+$"), F.length(F.substring_index(bare, ",", -1)))
            .otherwise(F.lit(0))
        )

    return F.transform(figures, places)


def is_meta(key: Column | str) -> Column:
    return col(key).rlike("_(" + "|".join(META_SUFFIXES) + ")$")


def short_name(key: Column | str) -> Column:
    return F.substring_index(col(key), ".", -1)


def squash(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(text), r"\s+", " ")))


def letters_digits(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]", "")


def name_key(text: Column | str) -> Column:
    """A document name for matching: marks folded, leading "the" and a plural s of longer words dropped."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "), " "), "")
    words = F.when(F.get(words, F.lit(0)) == "the", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)), " ")


def coerced_number(text: Column | str) -> Column:
    """A number whose thousands may be set off by spaces."""
    return _number(F.regexp_replace(col(text), "(?<=\\d)[   ](?=\\d{3}(?!\\d))", ""))


def blank_key(text: Column | str) -> Column:
    """An answer without case and marks, in any script."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"(?U)[^\w\s]|_", ""), r"(?U)\s+", " "))


#: What stands for a covered value, between marks of any kind.
_COVERED = r"(?i)^\W*(redacted|blacked[ -]?out|masked|covered|hidden|[█■▇*xX]{3,})\W*$"


def redacted_reading(text: Column | str, listed: Column | None = None) -> Column:
    """The value only says that it is covered, or is blank and listed among the redacted ones."""
    t = F.trim(col(text))
    said = F.coalesce(t.rlike(_COVERED), F.lit(False))
    return said if listed is None else said | (F.coalesce(listed, F.lit(False)) & (F.coalesce(t, F.lit("")) == ""))


def obligation_sentence(text: Column | str, modal: str = r"\b(shall|must)\b") -> Column:
    """The first sentence with a modal, of at most 300 characters; null without one."""
    flat = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.left(F.get(F.filter(F.split(flat, r"(?<=[.;:])\s+"), lambda s: s.rlike("(?i)" + modal)), F.lit(0)), F.lit(300))


def title(text: Column | str) -> Column:
    """The first sentence without its marker "(a)", cut at a word within 120 characters; "i.e." and the like end none."""
    t = F.regexp_replace(F.trim(F.regexp_replace(col(text), r"\s+", " ")), r"^\([a-z]\) ?", "")
    t = F.get(F.split(t, r"(?<=[.;:])(?<!\b[a-z]\.[a-z]\.) ", 2), F.lit(0))
    return F.when(F.length(t) <= 120, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(120)), " [^ ]*$", ""), F.lit(" ...")))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def longest_run(value: Column | str, text: Column | str) -> Column:
    """Share of value's leading words found as a run in text: 1 in full; else at least two words and half of them, or 0."""
    words, page = F.array_remove(F.split(normalise(value), " "), ""), F.concat(F.lit(" "), normalise(text), F.lit(" "))
    n = F.size(words)
    run = lambda k: F.contains(page, F.concat(F.lit(" "), F.array_join(F.slice(words, 1, k), " "), F.lit(" ")))
    best = F.when(n > 0, F.get(F.filter(F.sequence(n, F.lit(1), F.lit(-1)), run), F.lit(0)))
    return F.when(best == n, F.lit(1.0)).when((best >= 2) & (2 * best >= n), best / n).otherwise(F.lit(0.0))


def quote_on_page(quote: Column | str, text: Column | str, window: int = 6) -> Column:
    """The whole quote, or any run of `window` of its words, is on the page."""
    words, page = F.array_remove(F.split(normalise(quote), " "), ""), F.concat(F.lit(" "), normalise(text), F.lit(" "))
    n = F.size(words)
    at = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    hit = F.exists(at, lambda i: F.contains(page, F.concat(F.lit(" "), F.array_join(F.slice(words, i, F.lit(window)), " "), F.lit(" "))))
    return F.when(n == 0, F.lit(False)).otherwise(hit)


def token_estimate(text: Column | str) -> Column:
    cjk = F.regexp_count(col(text), F.lit(r"[㐀-鿿豈-﫿]"))
    return (cjk + F.ceil((F.length(col(text)) - cjk) / 3.5)).cast("long")


def content_id(*parts: Column | str, length: int = 12) -> Column:
    """The first hex digits of SHA-256 over ordered parts."""
    return F.left(F.sha2(F.concat_ws("\u001f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), F.lit(length))


def path_id(path: Column | str) -> Column:
    return F.left(F.sha1(col(path)), F.lit(12))


def flag(value: Column | str) -> Column:
    return F.lower(F.trim(col(value))).isin("true", "yes", "1")


def bare_number(value: Column | str) -> Column:
    return col(value).rlike(r"^\s*-?[\d.,\s]*\d[\d.,\s]*$")


def filled_note(note: Column | str, field: Column | str) -> Column:
    return F.replace(col(note), F.lit("{field}"), col(field))


def money(amount: Column | str, sign: str = "HK$") -> Column:
    return F.concat(F.lit(sign), F.format_number(col(amount), 2))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks, the longest first and then those on either side, over all characters; null
    for a null text. Equal texts, most pairs of two good readings, are told apart beforehand."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def literal_pattern(words: str) -> str:
    """A regular expression for words set apart by anything but letters and digits."""
    return r"(?<![A-Za-z0-9])" + r"[^A-Za-z0-9]+".join(map(re.escape, words.split())) + r"(?![A-Za-z0-9])"
