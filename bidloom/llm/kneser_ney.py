"""Quality by the perplexity of an interpolated modified Kneser-Ney model over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import having, hinted, saved
from .kernels import grouped

ORDER = 4
#: Bits of a character; 0 stands before and after each text.
BITS = 16
#: Above this quantile of trusted documents' perplexity in a document's language, it is rejected.
QUANTILE = 0.995
#: One of so many trusted documents is held out of the model, for the thresholds.
HELD_OUT = 5
#: Characters of the texts that are scored together, about, and n-grams that a task holds.
BLOCK_CHARS, HELD_GRAMS = 1 << 25, 4_000_000


def characters(text: str) -> np.ndarray:
    """Code points as 16-bit codes. Those beyond the basic plane share the 2048 codes that surrogates leave free."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return np.maximum(np.where(cp < 0x10000, cp, 0xD800 + cp % 2048), 1).astype(np.uint64)


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """Codes of the n-gram that ends at each character and at the end of the text."""
    edge = np.zeros(order - 1, np.uint64)
    c = np.concatenate([edge, characters(text), np.zeros(1, np.uint64)])
    n = len(c) - order + 1
    out = np.zeros(n, np.uint64)
    for j in range(order):
        out = (out << np.uint64(BITS)) | c[j : j + n]
    return out.view(np.int64)


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged(new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            g, c = np.unique(np.concatenate(new), return_counts=True)
            keys, at = np.unique(np.concatenate([held[0], g]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, at, np.concatenate([held[1], c]))
            return keys, n

        emit = lambda: pa.RecordBatch.from_pydict({"gram": held[0], "c": held[1]})
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in grouped(texts):
                held = merged([grams(texts[i], order) for i in part if texts[i]] or [np.zeros(0, np.int64)])
                if len(held[0]) > HELD_GRAMS:
                    yield emit()
                    held = held[0][:0], held[1][:0]
        yield emit()

    return run


def _tail(gram: str, k: int) -> F.Column:
    """The last k characters of an n-gram."""
    return F.col(gram).bitwiseAND((1 << (BITS * k)) - 1) if k * BITS < 64 else F.col(gram)


def model(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(k, gram, p, g): for order k the probability of each seen k-gram, and, for contexts of order k, their backoff g.

    trusted: text. Highest-order counts are summed over all of it; lower orders count the distinct characters before
    an n-gram. Discounts of 1, 2 and 3 or more come from the counts of counts of each order. Counts meet contexts and
    lower orders in equi joins on n-gram codes, so that every table is sharded by hash. Rows of p have a null g and
    those of g a null p; k = 0 holds the share of a character that was never seen. No text: no rows.
    """
    top = saved(trusted.select("text").mapInArrow(_counts(order), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "counts")
    tables = {order: top}
    for k in range(order - 1, 0, -1):
        tables[k] = saved(tables[k + 1].groupBy(_tail("gram", k).alias("gram")).agg(F.count("*").alias("c")), "counts")
    floor = 1.0 / (tables[1].count() + 1)
    lower, out = None, None
    for k in range(1, order + 1):
        t = tables[k]
        n = {r["c"]: r["n"] for r in t.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts([n.get(i, 0) for i in (1, 2, 3, 4)])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("h", F.shiftrightunsigned("gram", BITS)).withColumn("cut", cut)
        ctx = saved(t.groupBy("h").agg(F.sum("c").alias("total"), F.sum("cut").alias("kept")).select("h", "total", (F.col("kept") / F.col("total")).alias("g")), "contexts")
        t = t.join(hinted(ctx), "h")
        if lower is None:
            t = t.withColumn("q", F.lit(floor))
        else:
            t = t.join(hinted(lower.select(F.col("gram").alias("tail"), F.col("p").alias("q"))), _tail("gram", k - 1) == F.col("tail"))
        lower = saved(t.select("gram", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("g") * F.col("q")).alias("p")), "probabilities")
        both = lower.select(F.lit(k).alias("k"), "gram", "p", F.lit(None).cast("double").alias("g")).unionByName(
            ctx.select(F.lit(k).alias("k"), F.col("h").alias("gram"), F.lit(None).cast("double").alias("p"), "g")
        )
        out = both if out is None else out.unionByName(both)
    none = tables[1].agg(F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram"), F.lit(floor).alias("p"), F.lit(None).cast("double").alias("g"), F.count("*").alias("n")).where("n > 0")
    return saved(out.unionByName(none.drop("n")), "model")


def discounts(n: list[int]) -> list[float]:
    """Those of 1, 2 and 3 or more from how many n-grams have counts of 1 to 4; with plain values where some are missing."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5), (2 - 3 * y * n3 / n2 if n2 else 1.0), (3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(x, 0.05), j - 0.05) for j, x in enumerate(raw, 1)]


def log_probabilities(wanted: DataFrame, fitted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, lp) of wanted n-grams (gram, distinct): from the highest order down, what isn't found meets the next shard."""
    left = wanted.select("gram", F.lit(0.0).alias("scale"))
    out = None
    for k in range(order, 0, -1):
        p = saved(fitted.where((F.col("k") == k) & F.col("p").isNotNull()).select(F.col("gram").alias("tail"), "p"), "shard")
        g = saved(fitted.where((F.col("k") == k) & F.col("g").isNotNull()).select(F.col("gram").alias("h"), "g"), "shard")
        left = saved(left.join(hinted(p), _tail("gram", k) == F.col("tail"), "left").select("gram", "scale", "p"), "looked up")
        found = left.where("p is not null").select("gram", (F.col("scale") + F.log("p")).alias("lp"))
        out = found if out is None else out.unionByName(found)
        left = left.where("p is null").join(hinted(g), F.shiftrightunsigned(_tail("gram", k), BITS) == F.col("h"), "left")
        left = left.select("gram", (F.col("scale") + F.coalesce(F.log("g"), F.lit(0.0))).alias("scale"))
    floor = fitted.where("k = 0").select("p")
    return saved(out.unionByName(left.crossJoin(F.broadcast(floor)).select("gram", (F.col("scale") + F.log("p")).alias("lp"))), "resolved")


def _distinct(order: int, by_block: bool):
    """Distinct n-grams of all texts of a task, or of those of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            blocks = np.repeat(np.array(list(held), np.int32), [len(x) for x in held.values()])
            return pa.RecordBatch.from_pydict({"block": blocks, "gram": np.concatenate(list(held.values())) if held else np.zeros(0, np.int64)})

        for batch in batches:
            texts, blocks = batch.column("text").to_pylist(), batch.column("block").to_numpy()
            for part in grouped(texts):
                own: dict[int, list[np.ndarray]] = {}
                for i in part:
                    own.setdefault(int(blocks[i]) if by_block else 0, []).append(grams(texts[i], order))
                for b, new in own.items():
                    held[b] = np.unique(np.concatenate([held.get(b, new[0][:0]), *new]))
                if sum(map(len, held.values())) > HELD_GRAMS:
                    yield emit()
                    held.clear()
        yield emit()

    return run


def perplexity(docs: DataFrame, fitted: DataFrame, order: int = ORDER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """row (the columns of docs but for the text), chars, log_p, perplexity of each whole text; null for empty texts or an
    empty model.

    The distinct n-grams of all texts meet the sharded model in joins, once each. Texts are dealt into blocks of about
    block_chars, the distinct n-grams of a block meet what was found for them, and with these a block's texts are summed:
    pre-aggregated by block, n-grams cost a fraction of the texts' own shuffle, and nothing passes through the driver.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chars = F.length("text").cast("long").alias("chars")
    if fitted.isEmpty():
        return df.select("row", chars, F.lit(None).cast("double").alias("log_p"), F.lit(None).cast("double").alias("perplexity"))
    total = df.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    many = max(1, -(-total // block_chars))
    by = ["text"] + (["row.doc_id"] if "doc_id" in docs.columns else [])
    blocks = df.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(many)).cast("int"))
    wanted = blocks.mapInArrow(_distinct(order, False), "block int, gram long").groupBy("gram").agg(F.lit(1).alias("one")).select("gram")
    resolved = log_probabilities(wanted, fitted, order)
    # Both uses of the dealt texts have the same columns, so they are dealt once.
    blocks = blocks.repartition(many, "block")
    of_block = blocks.mapInArrow(_distinct(order, True), "block int, gram long").distinct()
    of_block = of_block.join(hinted(resolved), "gram")

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys, lp = found["gram"].to_numpy(), found["lp"].to_numpy()
        by_key = np.argsort(keys, kind="stable")
        keys, lp = keys[by_key], lp[by_key]
        values = texts["text"].to_pylist()
        out = np.zeros(len(values))
        for part in grouped(values):
            sets = [grams(values[i], order) for i in part]
            logs = lp[np.searchsorted(keys, np.concatenate(sets))]
            out[part] = np.add.reduceat(logs, np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]))
        return pa.table({"row": texts["row"], "chars": pa.array([len(v) for v in values], pa.int64()), "log_p": pa.array(out)})

    schema = StructType([df.schema["row"], StructField("chars", LongType()), StructField("log_p", DoubleType())])
    scored = blocks.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(score, schema)
    scored = scored.select("row", "chars", F.when(F.col("chars") > 0, F.col("log_p")).alias("log_p"))
    return scored.withColumn("perplexity", F.exp(-F.col("log_p") / (F.col("chars") + 1)))


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept.

    docs: doc_id, text, lang (other columns are ignored); labels: doc_id, quality, toxic. Trusted are documents labelled
    of quality and nowhere toxic. Those of four fifths, by hash of the id, train the model with all of their text; a
    language's threshold is a quantile of the perplexity of the others, which the model hasn't seen. A language without
    any, or a null one, takes that of all languages, and without held-out documents the trained ones decide. A text
    without characters has no perplexity and isn't kept; without trusted text every document is kept. Repeated rows
    are judged alike, and null ids like others.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("doc_id is not null and q = 1 and t = 0")
    good = saved(good.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_OUT)) == 0).alias("held")), "trusted")
    train = good.where("not held").select("doc_id")
    train = train if not train.isEmpty() else good.select("doc_id")
    fitted = model(having(docs.select("doc_id", "text"), train, "doc_id"), order)
    scored = saved(perplexity(docs.select("doc_id", "text", "lang"), fitted, order).select("row.doc_id", "row.lang", "perplexity"), "scored")
    if fitted.isEmpty():
        return scored.select("doc_id", "lang", "perplexity", F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    own = scored.where("perplexity is not null").join(hinted(good), "doc_id")
    held = saved(own.rollup("lang").agg(*[F.percentile_approx(F.when(F.col("held") | (F.lit(x) == "all"), F.col("perplexity")), quantile, 100_000).alias(x) for x in ("held", "all")], F.grouping("lang").alias("total")), "thresholds")
    overall = held.where("total = 1").select(F.coalesce("held", "all").alias("overall"))
    by = hinted(saved(held.where("total = 0 and lang is not null").select("lang", F.col("held").alias("cut")), "by language"))
    df = scored.join(by, "lang", "left").crossJoin(F.broadcast(overall)).withColumn("threshold", F.coalesce("cut", "overall"))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return df.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
