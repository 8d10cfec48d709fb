"""Page, template and node sources, and the interface of what a model reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters from which a page counts as text, from which a parser keeps its native text, and scanned pages read per document.
HAS_TEXT, NATIVE_TEXT, OCR_PAGES = 100, 20, 8


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length of the PDF files below a folder, lock files aside; content is read only where it is selected."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return df.select("path", name.alias("name"), "length", "content").where(~name.startswith("~$"))


def page_sequence(pages: DataFrame) -> DataFrame:
    """Adds seq per offer over all its files in name order, and has_text. pages: offer, doc, page, text."""
    seq = F.row_number().over(Window.partitionBy("offer").orderBy("doc", "page"))
    return pages.withColumn("seq", seq).withColumn("has_text", F.length("text") >= HAS_TEXT)


def gapless_sequence(pages: DataFrame) -> DataFrame:
    """Adds seq as page_sequence does, for documents whose pages are numbered from 1 without gaps: pages of the documents before are added, so no
    page moves. One row for each document is sorted."""
    n = pages.groupBy("offer", "doc").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("offer").orderBy("doc")) - F.col("_n")
    found = pages.join(n.select("offer", "doc", before.alias("_before")), ["offer", "doc"])
    return found.withColumn("seq", F.col("_before") + F.col("page")).drop("_before")


def text_source(pages: DataFrame, most: int = OCR_PAGES) -> DataFrame:
    """Adds source: text, ocr for the first scanned pages of a document, skipped beyond."""
    scanned = F.length(F.trim(F.coalesce("text", F.lit("")))) < HAS_TEXT
    nth = F.sum(scanned.cast("int")).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("source", F.when(~scanned, "text").when(nth <= most, "ocr").otherwise("skipped"))


def classified(pages: DataFrame, sample: int = 5) -> DataFrame:
    """doc, kind: text if the first pages have enough characters on average."""
    return pages.where(F.col("page") <= sample).groupBy("doc").agg(F.when(F.avg(F.length(F.coalesce("text", F.lit("")))) >= HAS_TEXT, "text").otherwise("scan").alias("kind"))


def joined(pages: DataFrame, most: int = 100_000) -> DataFrame:
    """doc, text with [Page n] marks, cut at so many characters."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.concat(F.lit("[Page "), p["page"].cast("string"), F.lit("]\n"), p["text"]))
    return pages.groupBy("doc").agg(F.left(F.array_join(parts, "\n"), F.lit(most)).alias("text"))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """id, file, problem of every JSON template; the file's stem must equal the id."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return df.withColumn("file", stem).withColumn("problem", F.when(F.col("id").isNull(), "no id").when(F.col("id") != F.col("file"), "id differs from the file's name"))


def bidders(files: DataFrame, root: str) -> DataFrame:
    """bidder, files: folders below the root; loose files are bidders by their stem."""
    rest = F.replace("path", F.lit(root.rstrip("/") + "/"), F.lit(""))
    bidder = F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)).otherwise(F.regexp_replace(rest, r"\.[^.]*$", ""))
    return files.groupBy(bidder.alias("bidder")).agg(F.count("*").alias("files"))


def document_ids(files: DataFrame) -> DataFrame:
    """Adds doc_id, the first twelve hex digits of SHA-1 of the relative path."""
    return files.withColumn("doc_id", F.left(F.sha1("relative"), F.lit(12)))


#: A reader turns rows into readings, a batch at a time: (columns of the input) -> frame of the given schema.
Reader = Callable[[pd.DataFrame], pd.DataFrame]


def read_with(rows: DataFrame, reader: Reader, schema: str) -> DataFrame:
    """rows through a pluggable reader; whatever it calls stays out of the plan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield reader(b)

    return rows.mapInPandas(run, schema)


def answered(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """A reader made of a table: every asked row once, with its answer or null."""
    return asked.join(answers, key, "left")
