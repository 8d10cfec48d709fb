"""Set-similarity self join on word shingles with token-combination prefixes.

Tokens (shingle hashes) follow one global order: rare before frequent, then by hash. A document of n
tokens that links to another misses at most d = floor((1 - t) * n) of its tokens there, so a prefix whose
signatures need at least d + 1 removals to vanish shares a signature with every partner. A rare token is a
signature by itself (one removal). Frequent tokens are dealt by hash into groups, and two of one group
together are a signature: a group of p tokens withstands p - 1 removals, so the prefix is extended until
the sum over rare tokens and groups reaches d + 1. The number of groups depends on the size's power of two,
so both partners form the same groups, and the number of pairs stays in proportion to d.

Which tokens count as frequent decides speed only: any fixed set gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import components, having, hinted, lacking, saved

#: At most so many frequent tokens are broadcast (8 bytes each); the rest count as rare, which costs time, not links.
MOST_FREQUENT = 1 << 20
#: A token of so many distinct sets, as far as two or more of them are seen together, is frequent.
FREQUENT = 64
#: Tokens that a task counts together.
COUNTED = 1 << 21
#: Cells of the histogram by hash that a set carries: the sum of the smaller counts bounds an intersection.
CELLS = 256
#: Rows of a class of equal sets from which it is looked up by broadcast (if few classes are so large), not shuffled.
LARGE_CLASS = 256
#: Distances from a star's centre are told apart in so many classes, for stars of more sets than a block holds.
DISTANCES = 16
#: Sets and tokens of a block; two blocks are compared in one task, without a row for each pair.
BLOCK_SETS, BLOCK_TOKENS = 512, 1 << 20
#: Rounds in which each set is held against one leader before the rest is compared star by star.
STAR_ROUNDS = 2


def _fingerprint(tokens: np.ndarray) -> bytes:
    """128 bits of a sorted token set."""
    with np.errstate(over="ignore"):
        a = kernels.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        b = kernels.mix(tokens * np.uint64(0x2545F4914F6CDD1D) + np.uint64(len(tokens))).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _table(ids: list, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), **columns})


def _lists(sets: list[np.ndarray]) -> pa.Array:
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(begin), pa.array(flat))


def _describe(k: int):
    """Rows of two kinds: a document's id, set size and fingerprint; a token and how many distinct sets held it together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0))
            keep = n >= 2
            many = int(keep.sum())
            return _table([None] * many, n=pa.array(n[keep].astype(np.int64)), fp=pa.nulls(many, pa.binary()), token=pa.array(tokens[keep].view(np.int64)))

        for batch in kernels.sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes, fps = [], []
            for _, tokens in kernels.shingle_sets(texts, k):
                fp = _fingerprint(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                fps.append(fp)
                if fp and fp not in seen:
                    seen.add(fp)
                    held.append(tokens)
                    size += len(tokens)
                if size >= COUNTED:
                    yield counted()
                    held, size, seen = [], 0, set()
            yield _table(ids, n=pa.array(sizes, pa.int64()), fp=pa.array(fps, pa.binary()), token=pa.nulls(len(ids), pa.int64()))
        yield counted()

    return run


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in kernels.grouped(texts):
                sets = [s for _, s in kernels.shingle_sets([texts[i] for i in part], k)]
                yield _table([ids[i] for i in part], tokens=_lists(sets))

    return run


def levels(n: int, percent: int) -> range:
    """The powers of two of the sizes that can link to n."""
    return range(max(1, percent * n // 100).bit_length() - 1, (100 * n // percent).bit_length())


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Single-token and pair signatures of a sorted set, and its number of frequent tokens."""
    n = len(tokens)
    d = (100 - percent) * n // 100
    at = np.searchsorted(frequent, tokens)
    often = frequent[np.minimum(at, len(frequent) - 1)] == tokens if len(frequent) else np.zeros(n, bool)
    rare, hot = tokens[~often], tokens[often]
    single = rare[: d + 1]
    short = d + 1 - len(single)
    if short <= 0:
        return single, tokens[:0], len(hot)
    pairs = []
    with np.errstate(over="ignore"):
        for level in levels(n, percent):
            # Few enough that even a set of frequent tokens only has a prefix that suffices.
            groups = np.uint64(max(1, min((100 - percent) * (1 << level) * 9 // 1000, percent * percent * (1 << level) // 10_000 - 2)))
            dealt = kernels.mix(hot + np.uint64(level + 1)) % groups
            first = np.zeros(len(hot), bool)
            first[np.unique(dealt, return_index=True)[1]] = True
            stood = np.cumsum(~first)
            end = int(np.searchsorted(stood, short)) + 1
            if end > len(hot):
                raise ValueError(f"no prefix of {n} tokens suffices at level {level}")
            order = np.argsort(dealt[:end], kind="stable")
            own, by = hot[:end][order], dealt[:end][order]
            for step in range(1, end):
                same = by[step:] == by[:-step]
                if not same.any():
                    break
                low, high = own[:-step][same], own[step:][same]
                low, high = np.minimum(low, high), np.maximum(low, high)
                pairs.append(kernels.mix(low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level)))
    return single, np.unique(np.concatenate(pairs)), len(hot)


def _signed(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in kernels.sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in kernels.grouped(texts):
                own, n, hot, single, pair, cells = [], [], [], [], [], []
                for i, tokens in kernels.shingle_sets([texts[i] for i in part], k):
                    # Smaller sets link to equal ones only, and equal sets are one row here.
                    if 100 * len(tokens) // percent > len(tokens):
                        s, p, h = signatures(tokens, often, percent)
                        for to, x in ((own, ids[part[i]]), (n, len(tokens)), (hot, h), (single, s), (pair, p), (cells, np.minimum(np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), 32767).astype(np.int16))):
                            to.append(x)
                yield _table(own, n=pa.array(n, pa.int64()), hot=pa.array(hot, pa.int64()), single=_lists(single), pair=_lists(pair), cells=pa.array(cells, pa.list_(pa.int16())))

    return run


def _verified(pairs: DataFrame, cells: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, inter, na, nb) of pairs: whole token sets of both, made again from the texts fetched by id; saved.

    Pairs whose histograms rule out a similarity of `least` percent (a column of pairs, or else percent) are
    answered with that bound as inter: it is at least the true intersection, and below what counts.
    """
    if "least" not in pairs.columns:
        pairs = pairs.withColumn("least", F.lit(percent))
    for side in ("a", "b"):
        pairs = pairs.join(cells.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("c").alias(f"c{side}")), side)
    bound = F.coalesce(F.expr("aggregate(zip_with(ca, cb, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)"), F.least("na", "nb"))
    pairs = saved(pairs.select("a", "b", "least", "na", "nb", bound.alias("inter")), "bounded")
    open_ = F.lit(100) * F.col("inter") >= F.col("least") * _union()
    ruled_out = pairs.where(~open_).select("a", "b", "inter", "na", "nb")
    pairs = pairs.where(open_).select("a", "b")
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = having(docs.select("doc_id", "text"), ids, "doc_id").mapInArrow(_tokens(k), "id long, tokens array<long>")
    out = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    exact = out.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("inter"), F.size("ta").cast("long").alias("na"), F.size("tb").cast("long").alias("nb"))
    return saved(exact.unionByName(ruled_out), "verified")


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, by postings."""
    owner = np.repeat(np.arange(len(y)), [len(t) for t in y])
    flat = np.concatenate(y)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for i, tokens in enumerate(x):
        low, high = np.searchsorted(flat, tokens), np.searchsorted(flat, tokens, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        out[i] = np.bincount(owner[at], minlength=len(y))
    return out


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric boolean matrix connects, one less than the nodes of each part."""
    out, left = [], np.ones(len(near), bool)
    for start in range(len(near)):
        front = np.array([start]) if left[start] else np.zeros(0, np.int64)
        left[front] = False
        while len(front):
            new = np.flatnonzero(near[front].any(0) & left)
            out += zip(front[near[front][:, new].argmax(0)].tolist(), new.tolist(), strict=True) if len(new) else []
            left[new] = False
            front = new
    return out


def _unit(percent: int, every: bool):
    """(id, n, other) of the sets of pairs of blocks: n links of id, and the links that connect them, or every link.

    A row: ids and tokens (each set's length and all of them in a row) of one block, and of another or null for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                ids, sets = [], []
                for block in (x, y):
                    for one in block.as_py() or [] if block.is_valid else []:
                        ids.append(one["id"])
                        sets.append(np.array(one["tokens"], np.int64))
                    if block is x:
                        first = len(ids)
                ids, size = np.array(ids, np.int64), np.array([len(t) for t in sets])
                one = np.arange(first)
                two = np.arange(first, len(ids)) if y.is_valid else one
                near = np.zeros((len(ids), len(ids)), bool)
                if len(one) and len(two):
                    inter = _intersections([sets[i] for i in one], [sets[i] for i in two])
                    near[np.ix_(one, two)] = 100 * inter >= percent * (size[one][:, None] + size[two][None, :] - inter)
                near |= near.T
                np.fill_diagonal(near, False)
                pairs = np.argwhere(np.triu(near)).tolist() if every else _forest(near)
                degree = near.sum(1)
                at = np.flatnonzero(degree)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(np.concatenate([ids[at], ids[[i for i, _ in pairs]] if pairs else ids[:0]]), pa.int64()),
                    "n": pa.array(np.concatenate([degree[at], np.zeros(len(pairs), np.int64)]), pa.int64()),
                    "other": pa.array([None] * len(at) + [int(ids[j]) for _, j in pairs], pa.int64()),
                })

    return run


def _compared(maybe: DataFrame, each: DataFrame, docs: DataFrame, k: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(id, n): links of each set, and (a, b): links that connect, or every link, within the pairs of stars of maybe.

    maybe: centres a and b and their distance ab, a = b for the pairs within a star; each: id, n, centre, dist. Sets of a
    large star are classed by distance from its centre. Where the distances prove that all of two classes link, they are
    only counted; where they prove that none do, nothing is done; the rest is compared block by block. So a group
    of near copies costs its size, as long as its members are within half a radius of their centre, and beyond that
    the comparisons of whole blocks; in no case is there a row for each pair.
    """
    far = (100 - percent) / 100
    stars = each.groupBy("centre").agg(F.count("*").alias("m"))
    # The centre is a class of its own: its links to the members are known.
    cls = F.when(F.col("id") == F.col("centre"), F.lit(-1)).when(F.col("m") <= BLOCK_SETS, F.lit(0)).otherwise(F.ceil(F.col("dist") * (DISTANCES / far) - 1e-9).cast("int"))
    each = saved(each.join(stars, "centre").select("id", "n", "centre", "dist", cls.alias("cls")), "classed")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(BLOCK_TOKENS / F.max("n"))))
    classes = each.groupBy("centre", "cls").agg(F.count("*").alias("m"), F.max("dist").alias("hi"), F.ceil(F.count("*") / room).cast("int").alias("parts"))
    side = lambda s: classes.select(F.col("centre").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "m", "hi", "parts")])
    met = maybe.select("a", "b", "ab").join(side("a"), "a").join(side("b"), "b").where("(a <> b or cls_a <= cls_b)").where(f"ab - hi_a - hi_b <= {far + 1e-9}")
    same = "a = b and cls_a = cls_b"
    sure = F.expr(f"(a = b and cls_a = -1) or ab + hi_a + hi_b <= {far - 1e-9}")
    met = saved(met.where(f"not ({same}) or m_a > 1").withColumn("sure", F.lit(False) if every else sure), "met classes")
    sure, open_ = met.where("sure"), met.where("not sure")
    plus = sure.where(f"not ({same})").select(F.inline(F.array(*[F.struct(F.col(x).alias("centre"), F.col(f"cls_{x}").alias("cls"), F.col(f"m_{y}").alias("plus")) for x, y in ("ab", "ba")])))
    plus = plus.unionByName(sure.where(same).select(F.col("a").alias("centre"), F.col("cls_a").alias("cls"), (F.col("m_a") - 1).alias("plus")))
    counted = each.join(plus.groupBy("centre", "cls").agg(F.sum("plus").alias("n_links")), ["centre", "cls"]).select("id", F.col("n_links").alias("n"))
    bridges = sure.where("a <> b").select("a", "b").distinct()

    unit = ["a", "cls_a", "part_a", "b", "cls_b", "part_b"]
    units = open_
    for x in "ab":
        units = units.withColumn(f"part_{x}", F.explode(F.sequence(F.lit(0), F.col(f"parts_{x}") - 1)))
    units = saved(units.where(f"not ({same}) or part_a <= part_b").select(*unit), "units")
    # A block is one row of bounded size, so that pairs of blocks, and not their members, are what is joined.
    asked = units.select(F.inline(F.array(*[F.struct(F.col(x).alias("centre"), F.col(f"cls_{x}").alias("cls"), F.col(f"part_{x}").alias("part")) for x in "ab"]))).distinct()
    parts = each.join(classes.select("centre", "cls", "parts"), ["centre", "cls"]).select("id", "centre", "cls", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    dealt = saved(parts.join(asked, ["centre", "cls", "part"], "left_semi"), "dealt")
    ids = saved(dealt.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    sets = having(docs.select("doc_id", "text"), ids, "doc_id").mapInArrow(_tokens(k), "id long, tokens array<long>").dropDuplicates(["id"])
    blocks = dealt.join(sets, "id").groupBy("centre", "cls", "part").agg(F.collect_list(F.struct("id", "tokens")).alias("block"))
    blocks = saved(blocks, "blocks")
    side = lambda x: blocks.select(F.col("centre").alias(x), F.col("cls").alias(f"cls_{x}"), F.col("part").alias(f"part_{x}"), F.col("block").alias(f"block_{x}"))
    pair = units.join(side("a"), ["a", "cls_a", "part_a"]).join(side("b"), ["b", "cls_b", "part_b"])
    pair = pair.select("block_a", F.when(F.expr(f"not ({same} and part_a = part_b)"), F.col("block_b")).alias("block_b"))
    found = saved(pair.mapInArrow(_unit(percent, every), "id long, n long, other long"), "compared")
    degree = counted.unionByName(found.where("other is null").select("id", "n"))
    links = found.where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return degree, links.unionByName(bridges)


def _union() -> F.Column:
    return F.col("na") + F.col("nb") - F.col("inter")


def linked_classes(docs: DataFrame, k: int = 5, percent: int = 80, inside: bool = True, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, fp) of every row, (fp, id, c) of every class of equal sets, (a, b) of links that connect all that is
    linked, or of every link between classes, and (id, n): parts of the number of links of a class.

    Equal sets are one class, and a class is represented by its smallest id, so its c copies cost one row each; fp
    leads from a row to its class. Classes that share a signature are first held against one leader per round;
    links form stars. As Jaccard distance is a metric, two stars whose centres are further apart than three radii
    hold no link, and the remaining pairs of stars, and each star with itself, are settled by their members' distances
    or compared in blocks (see _compared). Nothing is capped. Without `inside` only stars of different components are
    compared: enough for the components, and the numbers of links are none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = saved(docs.mapInArrow(_describe(k), "id long, n long, fp binary, token long").withColumnRenamed("id", "doc_id"), "described")
    rows = both.where("token is null").select("doc_id", "n", "fp")
    classes = saved(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("doc_id").alias("c")), "classes").where("id is not null")
    heavy = both.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    heavy = heavy.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()["token"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(heavy.astype(np.int64).view(np.uint64)))

    # Copies are left out by id: what isn't a class's smallest id carries no signature.
    copies = rows.join(hinted(classes.where("c > 1")), "fp").where("doc_id <> id").select("doc_id").distinct()
    copies = saved(copies.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "copies")
    own = lacking(docs.where("doc_id is not null and text is not null"), copies, "doc_id")
    signed = saved(own.mapInArrow(_signed(k, percent, frequent), "id long, n long, hot long, single array<long>, pair array<long>, cells array<smallint>"), "signed")
    frequent.unpersist()
    sig = signed.select("id", F.explode("single").alias("sig"), F.lit(False).alias("paired")).unionByName(
        signed.select("id", F.explode("pair").alias("sig"), F.lit(True).alias("paired"))
    )
    shared = sig.groupBy("sig", "paired").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("sig", "paired")
    sizes = signed.select("id", "n", "hot").distinct()
    cells = signed.select("id", "n", F.when(F.array_max("cells") < 32767, F.col("cells")).alias("c")).dropDuplicates(["id"])
    bucket = saved(sig.join(shared, ["sig", "paired"]).distinct(), "bucket")
    common = bucket.groupBy("sig", "paired").agg(F.count("*").alias("c"))
    worth = bucket.join(common, ["sig", "paired"]).groupBy("id").agg(F.sum("c").alias("worth"))
    bucket = saved(bucket.join(sizes.join(worth, "id"), "id"), "bucket")

    far = (100 - percent) / 100 + 1e-9
    linked = F.lit(100) * F.col("inter") >= percent * _union()
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    known = star = None
    for _ in range(STAR_ROUNDS):
        free = bucket if star is None else bucket.join(star.select("id"), "id", "left_anti")
        lead = free.groupBy("sig", "paired").agg(F.max_by(F.struct("id", "n"), F.struct("worth", -F.col("id"))).alias("a"), F.count("*").alias("c")).where("c > 1").select("sig", "paired", F.col("a.id").alias("a"), F.col("a.n").alias("la"))
        cand = free.join(lead, ["sig", "paired"]).where(f"id <> a and 100 * least(la, n) >= {percent} * greatest(la, n)").groupBy(F.col("id").alias("b"), "a").agg(F.count("*").alias("c"))
        if known is not None:
            cand = cand.join(known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        best = cand.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
        done = _verified(best, cells, docs, k, percent)
        known = done if known is None else known.unionByName(done)
        # A leader that is itself in a star may lead another: its members are within one radius of it.
        good = done.where(linked).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("centre"), F.min_by(1 - F.col("inter") / _union(), "a").alias("dist"))
        star = good if star is None else star.unionByName(good)

    placed = bucket.join(star.select("id", "centre"), "id", "left").withColumn("centre", F.coalesce("centre", "id"))
    roots = None
    if not inside:
        roots = components(known.where(linked)).select(F.col("node").alias("id"), "root")
        placed = placed.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Stars (without `inside` only of different components) that meet in a bucket, unless sizes or frequent tokens
    # rule all members out: what shares a pair but no rare token overlaps in frequent tokens only.
    stars = saved(placed.groupBy("sig", "paired", "centre", *([] if inside else ["root"])).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("hot").alias("hot")), "stars")
    several = stars.groupBy("sig", "paired").agg(F.count("*").alias("c")).where("c > 1").select("sig", "paired")
    x, y = stars.join(several, ["sig", "paired"], "left_semi").alias("x"), stars.alias("y")
    near = F.expr(
        f"{'' if inside else 'x.root <> y.root and '}x.centre < y.centre and 100 * x.most >= {percent} * y.least and 100 * y.most >= {percent} * x.least"
        f" and (not x.paired or {100 + percent} * least(x.hot, y.hot) >= {percent} * (x.least + y.least))"
    )
    same = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.paired") == F.col("y.paired"))
    met = saved(x.join(y, same & near).select(F.col("x.centre").alias("a"), F.col("y.centre").alias("b")).distinct(), "met")
    past = known.select(*ordered, "inter", "na", "nb").distinct()
    # Where a star has members, the distance of the centres counts up to three radii.
    centres = star.select("centre").distinct()
    fresh = met.join(past, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        fresh = fresh.join(centres.select(F.col("centre").alias(side), F.lit(True).alias(f"m{side}")), side, "left")
    fresh = fresh.select("a", "b", F.when(F.col("ma").isNull() & F.col("mb").isNull(), percent).otherwise(max(0, 3 * percent - 200)).alias("least"))
    done = _verified(fresh, cells, docs, k, percent)
    # Distances: d(x, y) >= d(a, b) - d(x, a) - d(y, b), so members link only where that is within one radius.
    members = star.groupBy("centre").agg(F.max("dist").alias("r"), F.count("*").alias("k"))
    maybe = met.join(past, ["a", "b"]).unionByName(done).where(F.lit(True) if inside else ~linked).withColumn("ab", 1 - F.col("inter") / _union()).select("a", "b", "ab").distinct()
    for side in ("a", "b"):
        maybe = maybe.join(members.select(F.col("centre").alias(side), F.col("r").alias(f"r{side}"), F.col("k").alias(f"k{side}")), side, "left")
    maybe = maybe.where((F.col("ra").isNotNull() | F.col("rb").isNotNull()) & (F.col("ab") <= far + F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))))
    maybe = maybe.select("a", "b", "ab")
    if inside:
        maybe = maybe.unionByName(members.select(F.col("centre").alias("a"), F.col("centre").alias("b"), F.lit(0.0).alias("ab")))
    maybe = saved(maybe, "maybe")
    known = known.unionByName(done)
    # Each set is in one star, and a pair of sets belongs to the pair of their stars.
    each = cells.select("id", "n").join(star, "id", "left").withColumns({"centre": F.coalesce("centre", "id"), "dist": F.coalesce("dist", F.lit(0.0))})
    each = each.join(maybe.select(F.explode(F.array("a", "b")).alias("centre")).distinct(), "centre", "left_semi")
    if maybe.isEmpty():
        return rows, classes, saved(known.where(linked).select(*ordered).distinct(), "links"), known.where(linked).select(*ordered).distinct().select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n"))
    degree, links = _compared(maybe, each, docs, k, percent, every)
    # Pairs of lone sets were compared directly.
    lone = known.where(linked).select(*ordered).distinct()
    busy = saved(star.select("id").unionByName(members.select(F.col("centre").alias("id"))).distinct(), "busy")
    for side in ("a", "b"):
        lone = lone.join(busy.select(F.col("id").alias(side)), side, "left_anti")
    lone = lone.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return rows, classes, saved(known.where(linked).select(*ordered).unionByName(links).distinct(), "links"), degree.unionByName(lone)


def jaccard_pairs(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, of every link between representatives, and (doc_id, id): the representative of each document.

    Documents of one representative have equal sets; what links are the documents of a and those of b.
    """
    rows, classes, links, _ = linked_classes(docs, k, percent, every=True)
    return links, rows.where("doc_id is not null").join(classes, "fp").select("doc_id", "id").distinct()


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, inside: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_links.

    docs: doc_id long and text; other columns are ignored. Two documents link when
    100 * |intersection| >= percent * |union| of their sets of distinct k-word shingles (A-Z lowered); with fewer
    words the whole sequence is the one shingle. component_id is the smallest doc_id reachable over links;
    n_links is the number of classes of equal sets that the document's class links to; without `inside` there is
    none. Null or empty texts have no shingle, link with nothing and keep their own id. Rows
    that share a doc_id are one document; a null doc_id takes the component of equal texts, else null. Shingles are
    64-bit hashes.
    """
    rows, classes, links, parts = linked_classes(docs, k, percent, inside)
    comp = components(links)
    degree = parts.groupBy("id").agg(F.sum("n").alias("n_links"))
    placed = classes.join(comp.select(F.col("node").alias("id"), "root"), "id", "left").join(degree, "id", "left")
    placed = saved(placed.select("fp", "c", F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed")
    # The rows of a large class, and those without a set, don't meet in one task.
    large = hinted(placed.where(F.col("c") >= LARGE_CLASS))
    some = rows.where("fp is not null")
    found = some.join(large, "fp").unionByName(some.join(large.select("fp"), "fp", "left_anti").join(placed.where(F.col("c") < LARGE_CLASS), "fp", "left"))
    out = found.unionByName(rows.where("fp is null"), allowMissingColumns=True)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if inside else out.drop("n_links")


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of linked ones, that with the smallest id; columns as they came.

    Where rows share an id, each row is a document of its own, in the order of ids: copies go, other texts stay. Texts
    without words and null ids are in no group and stay.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    if twice.isEmpty():
        classes = jaccard_classes(docs, k, percent, inside=False)
        gone = saved(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
        return lacking(docs, gone, "doc_id").select(*docs.columns)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).orderBy(F.col("row.doc_id").cast("long"))
    # Of a sorted table these keys are in the order of ids.
    rows = rows.withColumn("key", F.when(F.col("row.doc_id").isNotNull(), F.monotonically_increasing_id()))
    rows = saved(rows, "keyed")
    classes = jaccard_classes(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), k, percent, inside=False)
    gone = saved(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct(), "gone")
    return lacking(rows, gone, "key").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
