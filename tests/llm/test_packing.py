"""Best fit against a plain search over all open bins, with the bound acting, and the order in which pieces come."""

from __future__ import annotations

import random

from bidloom.llm import packing


def plain(lengths: list[int], capacity: int, most: int) -> tuple[list[int], list[int], int]:
    """(bins, offsets, bins closed early): a list of open bins, searched for each piece."""
    open_: list[list[int]] = []  # free, bin, in the order of opening or of the last piece
    bins, to, at, early = 0, [], [], 0
    for n in lengths:
        fit = [b for b in open_ if b[0] >= n]
        if fit:
            best = min(b[0] for b in fit)
            b = [x for x in fit if x[0] == best][-1]
            open_.remove(b)
        else:
            if len(open_) >= most:
                least = min(b[0] for b in open_)
                open_.remove([x for x in open_ if x[0] == least][-1])
                early += 1
            b, bins = [capacity, bins], bins + 1
        to.append(b[1])
        at.append(capacity - b[0])
        if b[0] > n:
            open_.append([b[0] - n, b[1]])
    return to, at, early


def test_choice_of_bins():
    rng = random.Random(7)
    early = 0
    for most in (1, 2, 5, 64):
        for capacity in (10, 100, 1024):
            lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.randint(1, max(1, capacity // 9)) for _ in range(800)]
            to, at, closed = plain(lengths, capacity, most)
            assert packing.best_fit(lengths, capacity, most) == (to, at)
            early += closed
            if most < 64:
                assert closed > 0
    assert early > 1000


def test_pieces_come_in_training_order(spark):
    """With order, a group's pieces are packed as they come: the same as one run over the ordered lengths."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 500))), (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string, turn long").repartition(4)
    got = packing.packed(df, "byte_bpe_50k.json", end_id=2, order="turn").orderBy("place", "piece").collect()
    to, at = packing.best_fit([r["length"] for r in got])
    assert [r["offset"] for r in got] == at and [r["sequence_id"] & 0xFFFFFFFF for r in got] == to
