"""Vector code compression: product codes whose codebooks are maintained from changed assignments only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, removed, saved, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def limit(width: int) -> int:
    """Components of parts of that width stop at this size, so that squared distances are exact in 64 bits."""
    return min(1 << 28, int((2**62 / width) ** 0.5 / 2))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row of x: exact, ties to the lower index."""
    top = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * x.shape[1] * int(top) ** 2 < 1 << 53:
        # All terms are whole numbers that a double holds.
        c = book.astype(np.float64)
        d = (c * c).sum(1)[None, :] - 2.0 * (x.astype(np.float64) @ c.T)
        at = d.argmin(1)
        return at, (x * x).sum(1) + d[np.arange(len(x)), at].astype(np.int64)
    at, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for j, c in enumerate(book):
        d = ((x - c) ** 2).sum(1)
        better = d < best
        at[better], best[better] = j, d[better]
    return at, best


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id, label, v: the rows that take part, components as floor(scale * x).

    Vectors that are null or empty or hold null or non-finite components take no part, nor do those whose length isn't the
    most frequent one (ties: the shorter). Vectors that don't divide into equal parts are padded with zeros. Components
    stop at limit(width), far beyond what float vectors of any use hold.
    """
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.cast("array<double>").alias("v"))
    common = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = common["n"] if common else parts
    most = float(limit(-(-n // parts)))
    ints = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * float(scale)), F.lit(-most)), F.lit(most)).cast("int"))
    pad = F.array_repeat(F.lit(0), -n % parts)
    return whole.where(F.size("v") == n).select("vec_id", "label", F.concat(ints, pad).alias("v"))


def seeds(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The first codebooks, (part, entry, position): the vectors of the smallest ids, null ids last, repeated ids by value."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    width = len(first[0]["v"]) // parts if first else 1
    return np.array([r["v"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)


def assigned(rows: DataFrame, books: np.ndarray, known: bool, last: bool = False) -> DataFrame:
    """rows with their codes under books and, one for each entry that a task's rows joined or left, slot, joined and moved:
    the count and the components by which that entry changes. known: rows hold the codes of the round before, else all
    of them join. last: no changes are counted, and error holds the squared distances' sum.
    """
    parts, entries, width = books.shape
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = np.zeros((parts, entries), np.int64)
        moved = np.zeros((parts, entries, width), np.int64)
        touched = np.zeros((parts, entries), bool)
        label = pa.null()
        for b in batches:
            n, label = b.num_rows, b.column("label").type
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
            code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            before = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts) if known else None
            for p in range(parts):
                at, d = nearest(x[:, p], books[p])
                code[:, p] = at
                error += d
                if last:
                    continue
                change = at != before[:, p] if known else np.ones(n, bool)
                for sign, to in ((1, at[change]), (-1, before[change, p] if known else None)):
                    if to is not None:
                        np.add.at(joined[p], to, sign)
                        np.add.at(moved[p], to, sign * x[change, p])
                        touched[p, to] = True
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            none = pa.nulls(n)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), none.cast(pa.list_(pa.int32())) if last else b.column("v"), codes, pa.array(error), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))], names)
        slots = np.flatnonzero(touched.ravel())
        if len(slots):
            m = len(slots)
            none = pa.nulls(m)
            sums = pa.array(moved.reshape(-1, width)[slots].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(label), none.cast(pa.list_(pa.int32())), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(slots, pa.int32()), pa.array(joined.ravel()[slots]), sums], names)

    names = ["vec_id", "label", "v", "code", "error", "slot", "joined", "moved"]
    return rows.mapInArrow(run, f"vec_id long, label {kind}, v array<int>, code binary, error long, slot int, joined long, moved array<long>")


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame, list[int]]:
    """(codebooks, rows with the last round's codes, entries changed in each round) for the rows of integers().

    Each round reads the rows with the codes that the round before wrote, finds the nearest entries and writes both again
    beside the changes: what entries gain and lose by parts that moved, summed within each task. Only those sums are
    shuffled, at most parts * entries rows a task however many rows it holds, and added to the running sums and counts
    (whole numbers, so the order doesn't matter), which the driver keeps with the codebooks. Rounds are files in the
    shared folder; one is removed when the next is there.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: at most 256 entries")
    spark = rows.sparkSession
    books = seeds(rows, parts, entries)
    counts, sums, changed, path, known = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), [], None, False
    if not books.size:
        return books, rows.withColumn("code", F.lit(b"")), []
    for _ in range(rounds):
        to = scratch(spark, "codes")
        out = assigned(rows, books, known)
        out.write.parquet(to)
        done = spark.read.schema(out.schema).parquet(to)
        if path:
            removed(spark, path)
        rows, path, known = done.where("slot is null").select("vec_id", "label", "v", "code"), to, True
        per_slot = [F.sum(F.get("moved", F.lit(i))).alias(f"m{i}") for i in range(books.shape[2])]
        change = done.where("slot is not null").groupBy("slot").agg(F.sum("joined").alias("joined"), *per_slot).collect()
        for r in change:
            p, e = divmod(r["slot"], books.shape[1])
            counts[p, e] += r["joined"]
            sums[p, e] += np.array(r[2:], np.int64)
        changed.append(len(change))
        used = counts > 0
        books = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books)
    return books, rows, changed


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary, error for each row of integers(); the codebooks): vectors as one byte a part.

    Codebooks start as the vectors of the smallest ids. With fewer vectors than entries there are as many entries; repeated
    rows are rows of their own; an empty table gives no rows and empty codebooks; further columns are left out.
    """
    rows = saved(integers(vectors, parts, scale), "integers")
    books, rows, _ = trained(rows, parts, entries, rounds)
    if not books.size:
        return rows.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error")), books
    return saved(assigned(rows, books, known=True, last=True).select("vec_id", "label", "code", "error"), "encoded"), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with a column vector: the entries that the bytes stand for, in the vectors' own units."""
    table = [F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for e in part]) for part in books]

    def entry(p: int) -> Column:
        return F.get(table[p], F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int"))

    return codes.withColumn("vector", F.concat(*[entry(p) for p in range(len(books))]))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over rows of an equal label, nulls together. The sums are joined back by label,
    broadcast where measured small, so that a label of a third of all rows isn't gathered."""
    by = saved(codes.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error")), "label_errors")
    return codes.join(hinted(by), F.col("label").eqNullSafe(F.col("its"))).drop("its")


def _oracle() -> str:
    head = r"""WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
 FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM k, range(4) t(part)),
c0 AS MATERIALIZED (SELECT part, id AS entry, v, list_inner_product(v, v) AS cc FROM p WHERE id < 256),"""
    near = "SELECT id, part, min({'d': d, 'entry': entry}) AS m FROM (SELECT p.id, p.part, c.entry, c.cc - 2 * list_inner_product(p.v, c.v) AS d FROM p JOIN c%d c USING (part)) GROUP BY id, part"
    body = ""
    for r in range(4):
        body += f"\na{r} AS MATERIALIZED ({near % r}),"
        body += f"\nn{r} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM (SELECT part, m.entry AS entry, i, floor(sum(p.v[i]) / count(*)) AS x FROM a{r} JOIN p USING (id, part), range(1, 1 + (SELECT max(len(v)) FROM p)) t(i) GROUP BY ALL) GROUP BY ALL),"
        body += f"\nc{r + 1} AS MATERIALIZED (SELECT part, entry, v, list_inner_product(v, v) AS cc FROM (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n ON c.part = n.part AND c.entry = n.entry)),"
    tail = f"""
a4 AS MATERIALIZED ({near % 4}),
e AS (SELECT id, string_agg(lower(printf('%02x', m.entry)), '' ORDER BY part) AS code, CAST(sum(m.d + list_inner_product(p.v, p.v)) AS BIGINT) AS error FROM a4 JOIN p USING (id, part) GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN e USING (id), h"""
    return head + body + tail


ORACLE = _oracle()
