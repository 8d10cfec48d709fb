"""Packing documents into training sequences: bounded-space online best fit."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .kernels import sliced

CAPACITY = 1024
#: Fixed: how byte-level BPE splits a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bins that are open at a time: on the documents table, four times as many leave as many sequences.
OPEN_BINS = 64
#: Pieces packed together, about: few enough for one task, many enough to fill bins.
GROUP_PIECES = 8192
#: Ranges of the training order that are told apart, at most.
RANGES = 2000
#: Characters that are tokenised together.
BATCH_CHARS = 1 << 20


def best_fit(lengths: list[int], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length in order: the open bin with the least space that suffices.

    Bit f of an integer says that some open bin has f free; its lowest bit from `length` on is the best fit. A bin
    that is full closes; when a new one would be too many, the fullest closes first.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = opened = bins = 0
    to, at = [], []
    for n in lengths:
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} doesn't fit into {capacity}")
        above = bits >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            if opened >= open_bins:
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                opened -= 1
            b, free = bins, capacity
            bins += 1
            opened += 1
        to.append(b)
        at.append(capacity - free)
        rest = free - n
        if rest:
            by_free[rest].append(b)
            bits |= 1 << rest
        else:
            opened -= 1
    return to, at


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which holds what is left over."""
    head = n % capacity or capacity
    return [(0, min(head, n)), *[(s, capacity) for s in range(head, n, capacity)]] if n else []


@lru_cache(maxsize=4)
def _whole(path: str):
    """The file as the `tokenizers` library reads it: only where a text needs it, since it takes memory in every worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def encoder(path: str):
    """Texts to lists of ids, as the `tokenizers` library gives them without added special tokens.

    A byte-level BPE file whose ids follow its merges is run by tiktoken's engine, which yields the same ids from
    the same vocabulary several times faster; any other file is run by `tokenizers` itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = lambda texts: [e.ids for e in _whole(path).encode_batch_fast(texts, add_special_tokens=False)]
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    same = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not spec.get("normalizer") and model.get("type") == "BPE"
    same = same and not model.get("dropout") and [model["vocab"].get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
    if not same:
        return plain
    import tiktoken

    # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    added = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [plain([t])[0] if any(a in t for a in added) else fast.encode_ordinary(t) for t in texts]


def found_file(tokenizer: str) -> str:
    """A file as it is; else the place of a public vocabulary of that name on this machine."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt (and ids, and place) of each whole document's pieces.

    Null texts count as empty: the end id alone. tokenizer: a file, or the name of a vocabulary of public_tokenizers, which
    each executor looks up for itself. order: a column of docs, kept as place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(found_file(tokenizer))
        salt = 0
        for batch in sliced(batches):
            doc_ids, texts, places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            run_, size = [], 0
            for i in range(len(texts)):
                run_.append(i)
                size += len(texts[i] or "")
                if size < BATCH_CHARS and i + 1 < len(texts):
                    continue
                out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids", "place")}
                for j, found in zip(run_, encode([texts[j] or "" for j in run_]), strict=True):
                    ids = np.array([*found, end_id], "<u4")
                    for p, (s, n) in enumerate(cut(len(ids), capacity)):
                        part = ids[s : s + n]
                        for c, x in (("doc_id", doc_ids[j]), ("piece", p), ("start", s), ("length", n), ("ids_crc32", zlib.crc32(part.tobytes())), ("salt", salt), ("ids", part if with_ids else None), ("place", places[j])):
                            out[c].append(x)
                        salt += 1
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "ids": pa.list_(pa.int32())}
                if not with_ids:
                    out.pop("ids")
                if not order:
                    out.pop("place")
                yield pa.RecordBatch.from_pydict({c: pa.array(x, kinds.get(c, pa.int64())) for c, x in out.items()})
                run_, size = [], 0

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long" + (", ids array<int>" if with_ids else "") + (", place long" if order else "")
    place = F.col(order).cast("long") if order else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.alias("place")).mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document longer than `capacity` tokens is cut, its first piece the shorter one. Pieces are dealt into groups of
    about GROUP_PIECES, and each group is packed online: its pieces come one by one, each goes into one of open_bins bins
    and stays there, and no later piece is known. A group fits one task at any size of the input, and leaves at most
    open_bins bins unfilled at its end. Groups are dealt by hash, and pieces come in the order of theirs; with order, a
    column of docs with the training order as whole numbers, groups are ranges of it, pieces come in it and sequence_id
    rises with it, so that a curriculum survives packing up to the length of a group; the column `place` is kept. Offsets in a sequence have no gaps. Repeated rows
    are packed like others; an empty table gives none.
    """
    found = saved(pieces(docs, tokenizer, end_id, capacity, with_ids, order), "pieces")
    many = found.count()
    groups = max(1, -(-many // GROUP_PIECES))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "salt")
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), *(["place"] if order else [])]

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values([*(["place"] if order else ["h"]), "doc_id", "piece", "salt"], kind="stable").reset_index(drop=True)
        to, at = best_fit(df["length"].tolist(), capacity, open_bins)
        out = df[keep].copy()
        out["sequence_id"] = np.array(to, np.int64) + (np.int64(df["bucket"].iloc[0]) << 32) if len(df) else 0
        out["offset"] = np.array(at, np.int64)
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + (", place long" if order else "") + ", sequence_id long, offset long"
    rows = found.withColumn("h", key)
    if not order or groups == 1:
        return rows.withColumn("bucket", F.pmod("h", F.lit(groups))).groupBy("bucket").applyInPandas(pack, schema)
    # Ends of the ranges: quantiles of the order over all pieces; where groups are more than RANGES, each range is
    # dealt by hash into several.
    ranges = min(groups, RANGES)
    each = -(-groups // ranges)
    ends = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)] or [1.0], 100 * ranges).alias("e"))
    half = "cast((a.lo + a.hi) div 2 as int)"
    search = f"aggregate(sequence(1, {ranges.bit_length() + 1}), struct(0 as lo, {ranges - 1} as hi), (a, i) -> if(a.lo >= a.hi, a, if(e[{half}] < place, struct(cast({half} + 1 as int) as lo, a.hi as hi), struct(a.lo as lo, {half} as hi))), a -> a.lo)"
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("bucket", F.expr(f"cast({search} as long) * {each} + pmod(h, {each})")).drop("e")
    return rows.groupBy("bucket").applyInPandas(pack, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of packed(..., with_ids=True): at most `capacity` tokens a row."""
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
