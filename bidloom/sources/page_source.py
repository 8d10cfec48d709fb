"""A data source of page texts: files whose pages are set apart by form feeds, read in ranges of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..lineage import cut

FEED = b"\f"
#: Bytes of a partition, and of a read.
RANGE, CHUNK = 32 << 20, 1 << 20
#: Pages of a batch, and characters from which a page counts as text.
BATCH, HAS_TEXT = 64, 100
#: Ranges whose first pages may be broadcast.
MOST_RANGES = 100_000


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; the pages that begin in them belong to it."""

    uri: str
    start: int
    end: int


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Pages(DataSourceReader):
    def __init__(self, uri: str, suffix: str, size: int, give: str):
        self.uri, self.suffix, self.size, self.give = uri.rstrip("/"), suffix, size, give

    def partitions(self) -> list[Range]:
        """Ranges of the files below the folder in name order; lock files, hidden ones and other suffixes are left out."""
        store, path = _store(self.uri)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith(("~$", ".", "_")))
        return [Range(p[len(path) :].lstrip("/"), a, min(a + self.size, n)) for p, n in files for a in range(0, max(n, 1), self.size)]

    def _texts(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(number, text) of the pages that begin in a range: form feeds before it are counted, not kept, and the last page is
        read to its end. A form feed at the end of a file begins no page; an empty file is one empty page."""
        store, path = _store(self.uri)
        with store.open_input_file(f"{path}/{part.uri}") as f:
            page, at, begins, size = 1, 0, True, f.size()
            if self.give == "ranges" and part.start:
                # What stands before the byte in front of the range isn't read.
                at = f.seek(part.start - 1)
                page, begins, at = 0, f.read(1) == FEED, part.start
                page += begins
            while at < part.start:
                block = f.read(min(CHUNK, part.start - at))
                page, begins, at = page + block.count(FEED), block.endswith(FEED), at + len(block)
            # held: what is read and not yet given, from place i on; at: where in the file that place is.
            held, i = b"", 0
            while begins is False:
                held, i = f.read(CHUNK), 0
                cut = held.find(FEED)
                if not held:
                    return
                at += len(held) if cut < 0 else cut + 1
                if cut >= 0:
                    begins, i, page = True, cut + 1, page + 1
            while at < part.end or size == 0:
                cut = held.find(FEED, i)
                while cut < 0 and (more := f.read(CHUNK)):
                    held, i = held[i:] + more, 0
                    cut = held.find(FEED)
                text = held[i:] if cut < 0 else held[i:cut]
                yield page, text
                if cut < 0:
                    return
                page, at, i = page + 1, at + len(text) + 1, cut + 1

    def _count(self, part: Range) -> int:
        """Pages that begin in a range: one at the file's beginning, and one behind each form feed that doesn't end the file."""
        store, path = _store(self.uri)
        n, at = int(part.start == 0), max(part.start - 1, 0)
        with store.open_input_file(f"{path}/{part.uri}") as f:
            f.seek(at)
            while block := f.read(min(CHUNK, max(part.end - 1 - at, 0))):
                n, at = n + block.count(FEED), at + len(block)
        return n

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if self.give == "counts":
            yield pa.RecordBatch.from_pydict({"file": [part.uri], "start": [part.start], "pages": [self._count(part)]})
            return
        rows: list[tuple[int, str]] = []
        for page, text in self._texts(part):
            rows.append((page, text.decode("utf-8", "replace")))
            if len(rows) == BATCH:
                yield self._batch(part, rows)
                rows = []
        if rows:
            yield self._batch(part, rows)

    def _batch(self, part: Range, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        pages, texts = zip(*rows, strict=True)
        columns = {"file": [part.uri] * len(rows), "page": pa.array(pages, pa.int32()), "text": list(texts), "has_text": [len(x) >= HAS_TEXT for x in texts]}
        return pa.RecordBatch.from_pydict({"start": [part.start] * len(rows)} | columns if self.give == "ranges" else columns)


class PageSource(DataSource):
    """spark.read.format("page_texts").load(folder): file, page, text, has_text. Options: suffix (".txt") and bytes, the size of a
    partition. A file of any size is read by many tasks; register it with spark.dataSource.register(PageSource).

    A range's number of its first page is counted from the file's beginning, so long files are read many times over; `pages` reads
    them twice. Option give: counts gives (file, start, pages) of each range, ranges numbers pages from the range's start.
    """

    @classmethod
    def name(cls) -> str:
        return "page_texts"

    def schema(self) -> str:
        pages = "file string, page int, text string, has_text boolean"
        return {"counts": "file string, start long, pages long", "ranges": f"start long, {pages}"}.get(self.options.get("give", ""), pages)

    def reader(self, schema) -> _Pages:
        return _Pages(self.options["path"], self.options.get("suffix", ".txt"), int(self.options.get("bytes", RANGE)), self.options.get("give", ""))


def pages(spark: SparkSession, folder: str, size: int = RANGE, file: str | None = None) -> DataFrame:
    """file, page, text, has_text of the files below a folder, each byte read twice: once to count the pages of each range, once
    for their texts. file: a pattern whose first group names the file that parts belong to, in the order of their names."""
    spark.dataSource.register(PageSource)
    read = lambda give: spark.read.format("page_texts").option("bytes", size).option("give", give).load(folder)
    whole = F.col("file") if file is None else F.regexp_extract("file", file, 1)
    before = F.sum("pages").over(Window.partitionBy("whole").orderBy("file", "start")) - F.col("pages")
    counts = cut(read("counts").where("pages > 0"), "counts").withColumn("whole", whole)
    first = cut(counts.select("file", "start", "whole", before.alias("before")), "first")
    found = read("ranges").join(F.broadcast(first) if first.count() <= MOST_RANGES else first, ["file", "start"])
    return found.select(F.col("whole").alias("file"), (F.col("before") + F.col("page")).cast("int").alias("page"), "text", "has_text")
