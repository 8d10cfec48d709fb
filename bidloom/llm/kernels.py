"""Word and shingle hashing over UTF-8 buffers with numpy; every function works on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; one longer text makes a group of its own.
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _weights(n: int) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(7)) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


#: Rows whose texts are Python objects at a time.
SLICE = 512


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of SLICE rows; at the end, memory that is free goes back to the machine and not to the idle worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
    pa.default_memory_pool().release_unused()


def grouped(texts: list) -> Iterator[list[int]]:
    """Indexes of texts, in runs of about GROUP_BYTES."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t) if t else 0
        if size >= GROUP_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, and where each text's begin (one more)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in raw])
    buf = _LOWER[buf]
    solid = ~_SPACE[buf]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(np.append(first, len(at)))
    pos = np.arange(len(at)) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTE[buf[at]] * _weights(int(lengths.max()))[pos], first)
    h = mix(h + lengths.astype(np.uint64) * _BASE)
    return h, np.concatenate([[0], np.searchsorted(at[first], ends)])


def shingle_sets(texts: list, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct hashes of the k-word shingles); a shorter text is one shingle, without words none."""
    for run in grouped(texts):
        h, begin = word_hashes([texts[i] for i in run])
        acc = np.zeros(len(h), np.uint64)
        for j in range(min(k, len(h))):
            acc[: len(h) - j] = acc[: len(h) - j] * _BASE + h[j:]
        acc = mix(acc)
        for n, i in enumerate(run):
            a, b = begin[n], begin[n + 1]
            if b - a >= k:
                yield i, np.unique(acc[a : b - k + 1])
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = np.uint64((int(one) * int(_BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
                yield i, mix(np.array([one]))
            else:
                yield i, acc[:0]
