"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Codebooks and words of each; every word has all dimensions.
BOOKS, WORDS = 8, 256
BEAM = 4
#: The codebooks are fitted on at most this many vectors, those with the smallest hash of their id.
SAMPLE = 8192
KMEANS_ROUNDS, REFITS = 6, 2
#: Rows of a block, queries that are held against it together, and candidates of a block that are scored exactly first.
BLOCK_ROWS, QUERY_ROWS, RERANK = 16384, 4096, 160


@dataclass
class Codec:
    """books: (BOOKS, WORDS, dimensions)."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of the words whose sum is near each row: the best `beam` partial sums survive each book."""
        out = []
        norms = (self.books**2).sum(2)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n, rest, codes, cost = len(part), part[:, None, :], np.zeros((len(part), 1, 0), np.uint8), (part**2).sum(1)[:, None]
            for book, norm in zip(self.books, norms, strict=True):
                d = cost[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, rest.shape[1], -1) + norm
                flat = d.reshape(n, -1)
                k = min(beam, flat.shape[1])
                best = np.argpartition(flat, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
                from_, word = best // len(book), best % len(book)
                cost = np.take_along_axis(flat, best, 1)
                rest = np.take_along_axis(rest, from_[:, :, None], 1) - book[word]
                codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            out.append(codes[:, 0])
        return np.concatenate(out) if out else np.zeros((0, len(self.books)), np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, BOOKS, WORDS): inner products with every word."""
        return np.einsum("qd,mkd->qmk", queries, self.books, optimize=True)


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> Codec:
    """Residual k-means, then rounds of beam-search encoding and joint least squares over all books."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    words = max(1, min(words, len(x)))
    found, rest = [], x.copy()
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(KMEANS_ROUNDS):
            own = ((c**2).sum(1) - 2 * rest @ c.T).argmin(1)
            n = np.bincount(own, minlength=words)
            order = np.argsort(own, kind="stable")
            sums = np.add.reduceat(rest[order], np.minimum(np.concatenate([[0], np.cumsum(n)[:-1]]), len(rest) - 1), axis=0)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)]).astype(np.float32)
        own = ((c**2).sum(1) - 2 * rest @ c.T).argmin(1)
        rest = rest - c[own]
        found.append(c)
    codec = Codec(np.stack(found))
    for _ in range(REFITS):
        codes = codec.encode(x).astype(np.int64) + np.arange(books) * words
        # Normal equations of the one-hot design, a little damped towards the present words.
        gram = np.zeros((books * words, books * words))
        right = np.zeros((books * words, x.shape[1]))
        for m in range(books):
            np.add.at(right, codes[:, m], x)
            for k in range(books):
                np.add.at(gram, (codes[:, m], codes[:, k]), 1.0)
        now = codec.books.reshape(books * words, -1)
        fitted = np.linalg.solve(gram + np.eye(len(gram)), right + now)
        codec = Codec(fitted.reshape(books, words, -1).astype(np.float32))
    return codec


def _usable(c: str) -> Column:
    return F.col(c).isNotNull() & F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(c, lambda v: v != 0)


def search(vectors: DataFrame, queries: Column, k: int = 20, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows with the largest inner product, its own row left out.

    vectors: vec_id, embedding; queries: which rows are queries. Null and zero vectors, those with null or
    non-finite components and those of another length than most of the sample take no part. Every row is encoded
    and stands in one block by hash of its id; each pair of a query chunk and a block is one unit of work: table
    lookups score the block, and its best `rerank` rows are scored again in double precision on the original vectors.
    The k-th of these is a floor. A row's score lies within |query| * |residual| of its lookup and below |query| times
    its stored norm, so every further row that both bounds let reach the floor is scored as well: the result is that of
    brute force, whatever the codes. With fewer rows than k all are returned. Copies of a vector under several ids are
    scored alike and keep their order of ids; repeated rows are one, and where rows of one id differ, the id's best
    score counts. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", queries.alias("asks")).where("vec_id is not null").where(_usable("embedding"))
    rows = rows.groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks"))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = int(pd.Series([len(v) for v in drawn]).mode().iloc[0])
    books = spark.sparkContext.broadcast(train(np.stack([v for v in drawn if len(v) == size])).books)
    rows = rows.where(F.size("embedding") == size)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, wide = Codec(books.value), Codec(books.value.astype(np.float64))
        for df in batches:
            if len(df):
                x = np.stack(df["embedding"].to_numpy())
                codes = codec.encode(x.astype(np.float32))
                yield df.assign(code=[c.tobytes() for c in codes], off=np.sqrt(((x - wide.decode(codes)) ** 2).sum(1)), norm=np.sqrt((x.astype(np.float64) ** 2).sum(1)))

    index = saved(rows.mapInPandas(encode, "vec_id long, embedding array<float>, asks boolean, code binary, off double, norm double"), "index")
    n, asked = index.agg(F.count("*"), F.coalesce(F.count_if("asks"), F.lit(0))).first()
    blocks, chunks = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(asked / QUERY_ROWS))
    at = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    held = index.select("vec_id", "embedding", "code", "off", "norm", at(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asks = index.where("asks").select("vec_id", "embedding", at(chunks, 2).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def unit(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(x):
            x = x.sort_values("vec_id", kind="stable")
            ids, plain = x["vec_id"].to_numpy(), np.stack(x["embedding"].to_numpy()).astype(np.float64)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1).T)
            off, norm = x["off"].to_numpy(), x["norm"].to_numpy()
            ask = np.stack(q["embedding"].to_numpy()).astype(np.float64)
            # In double precision, so that rounding stays far below the slack of the bound.
            codec = Codec(books.value.astype(np.float64))
            slack = 1e-9 * (np.sqrt((codec.books**2).sum(2)).max(1).sum() + np.sqrt((plain**2).sum(1).max()))
            for i, query in enumerate(q["vec_id"]):
                table = codec.tables(ask[i : i + 1])[0]
                s = table[0][codes[0]]
                for m in range(1, len(table)):
                    s += table[m][codes[m]]
                s[ids == query] = -np.inf
                best = np.arange(len(s))
                if len(s) > max(rerank, k + 1):
                    depth = max(rerank, k + 1)
                    best = np.argpartition(s, -depth)[-depth:]
                    first = (plain[best[ids[best] != query]] * ask[i]).sum(1)
                    if len(first) >= k:
                        size = np.sqrt((ask[i] ** 2).sum())
                        reach = np.minimum(s + (off + slack) * size, (norm + slack) * size)
                        best = np.flatnonzero(reach >= np.partition(first, -k)[-k])
                    else:
                        best = np.arange(len(s))
                best = best[ids[best] != query]
                exact = (plain[best] * ask[i]).sum(1)
                order = np.lexsort((ids[best], -exact))[:k]
                out["query_id"].extend([query] * len(order))
                out["vec_id"].extend(ids[best][order])
                out["score"].extend(exact[order])
        return pd.DataFrame(out).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})

    near = asks.groupBy("chunk", "block").cogroup(held.groupBy("chunk", "block")).applyInPandas(unit, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
