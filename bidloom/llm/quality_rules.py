"""Text statistics and a learned decision list over them, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import having, hinted, saved

#: The list is fitted on at most this many labelled rows, those with the smallest hash of their id.
SAMPLE = 20_000
#: Thresholds tried per feature and class: so many quantiles of it.
QUANTILES = 16
MOST_RULES, MOST_CONDITIONS = 8, 4
#: A rule stays if, on rows that it wasn't grown on, so large a share of what it rejects is labelled bad, and so many rows.
PRECISION, SUPPORT = 0.97, 3

_SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("n_words", "mean_word", "symbol_share", "mark_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share")


def with_statistics(docs: DataFrame) -> DataFrame:
    """`row` (all columns of docs as they came), doc_id, and the statistics of each whole text.

    Null texts count as empty. Words are runs without the six ASCII white-space characters. n_repeat_words
    compares 5-word windows by 64-bit hash; windows are sorted within their row, so a text of n words takes
    n log n steps and rows never meet. Shares of an empty text are null.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumns(
        {
            "words": F.array_remove(F.split("text", _SPACE), ""),
            "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
            "n_digits": F.regexp_count("text", F.lit(r"[0-9]")),
            "n_marks": F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\p{N}\s]")),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_distinct": F.size(F.array_distinct("words")),
            "n_lines": F.size("lines"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "h": F.transform("words", lambda w: F.xxhash64(w)),
        }
    ).drop("words", "lines", "text")
    df = df.withColumn(
        "windows",
        F.when(F.col("n_words") < 5, F.array().cast("array<bigint>")).otherwise(
            F.expr("transform(slice(h, 1, size(h) - 4), (x, i) -> xxhash64(x, get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4)))")
        ),
    ).drop("h")
    # Only rows in which a window repeats sort their windows.
    df = df.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.expr("sort_array(transform(windows, (x, i) -> struct(x as h, i as p)))")),
    ).drop("windows")
    df = df.withColumn(
        "at", F.expr("sort_array(filter(transform(sorted, (e, i) -> if(get(sorted, i - 1).h = e.h or get(sorted, i + 1).h = e.h, e.p, null)), x -> x is not null))")
    ).drop("sorted")
    df = df.withColumn(
        "n_repeat_words",
        F.coalesce(
            F.expr("aggregate(at, struct(0L as upto, 0L as n), (a, p) -> struct(cast(p + 5 as bigint) as upto, a.n + p + 5 - greatest(a.upto, cast(p as bigint)) as n), a -> a.n)"),
            F.lit(0),
        ).cast("long"),
    ).drop("at")
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return df.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "mark_share": share("n_marks", "word_chars"),
            "upper_share": share("n_upper", "word_chars"),
            "digit_share": share("n_digits", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "distinct_share": share("n_distinct", "n_words"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature).cast("double")
        return F.coalesce(x > self.threshold if self.above else x <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out &= c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Ordered rules that reject; what none of them covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """The first rule that covers a row of statistics, as text; null if none does."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(str(r))) if out is None else out.when(r.column(), F.lit(str(r)))
        return F.lit(None).cast("string") if out is None else out


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics of at most `sample` labelled documents, with bad (1: labelled as of low quality).

    What the fixed base rules reject is left out: the list is to find what they don't.
    """
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = saved(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", (F.col("quality") == 0).cast("int").alias("bad")), "labels")
    stats = with_statistics(having(docs.select("doc_id", "text"), own.select("doc_id"), "doc_id"))
    stats = stats.withColumn("base_failed", base_failed()).join(hinted(own), "doc_id")
    return saved(stats.select("doc_id", "bad", "base_failed", *FEATURES), "labelled").where("not base_failed")


def fit(rows: DataFrame, precision: float = PRECISION, support: int = SUPPORT) -> DecisionList:
    """Sequential covering of rows (doc_id, bad and FEATURES), which labelled() bounds.

    Two thirds of the rows, by hash of the id, grow a rule: from nothing, the threshold with the largest
    information gain (FOIL) joins the conjunction until it covers no good row, gains nothing or is full. The
    other third prunes it: the head of the conjunction with the best (p - n) / (p + n) stays. A rule that
    isn't precise enough on that third is refused, and the next one starts with another feature or side; what an
    accepted rule covers leaves the rows. The list ends when no start is left. Thresholds lie midway between
    neighbouring quantiles of either class. All counts are aggregations over bins; the driver sees one number per
    feature, bin and class. Without bad rows, or without any, the list is empty.
    """
    cuts: dict[str, list[float]] = {}
    points = [i / QUANTILES for i in range(1, QUANTILES)] + [0.0, 0.005, 0.995, 1.0]
    quantiles = rows.groupBy("bad").agg(*[F.percentile(F.col(f).cast("double"), points).alias(f) for f in FEATURES]).collect()
    for f in FEATURES:
        seen = sorted({x for r in quantiles for x in r[f] or []})
        cuts[f] = [(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)] or seen
    if not any(r["bad"] == 1 for r in quantiles):
        return DecisionList()
    # The bin of a value: how many cuts lie below it; "value > cut" is "bin > the cut's place".
    below = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c < F.col(f).cast("double"))) if cuts[f] else F.lit(0)
    bins = [F.when(F.col(f).isNotNull(), below(f)).otherwise(-1).alias(f) for f in FEATURES]
    left = saved(rows.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow"), *bins), "bins")

    def test(c: tuple[str, bool, int]) -> Column:
        f, above, k = c
        return (F.col(f) > k) if above else (F.col(f) <= k) & (F.col(f) >= 0)

    def covers(cs: list) -> Column:
        out = F.lit(True)
        for c in cs:
            out &= test(c)
        return out

    def counts(df: DataFrame) -> dict[str, dict[int, list[int]]]:
        melted = df.select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("x"))
        out: dict = {f: {} for f in FEATURES}
        for r in melted.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect():
            out[r["f"]][r["b"]] = [r["p"], r["n"]]
        return out

    from math import log2

    found: list[list] = []
    refused: set[tuple[str, bool]] = set()
    while len(found) < MOST_RULES:
        rest = left
        for cs in found:
            rest = rest.where(~covers(cs))
        rule: list = []
        while len(rule) < MOST_CONDITIONS:
            by = counts(rest.where("grow").where(covers(rule)))
            p0, n0 = (sum(x[i] for x in by[FEATURES[0]].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f in FEATURES:
                have = {b: x for b, x in by[f].items() if b >= 0}
                all_p, all_n = (sum(x[i] for x in have.values()) for i in (0, 1))
                low_p = low_n = 0
                for k in range(len(cuts[f])):
                    dp, dn = have.get(k, [0, 0])
                    low_p, low_n = low_p + dp, low_n + dn
                    for above, p, n in ((False, low_p, low_n), (True, all_p - low_p, all_n - low_n)):
                        if p >= support and (rule or (f, above) not in refused):
                            gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                            best = max(best, (gain, (f, above, k)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        heads = [rule[: i + 1] for i in range(len(rule))]
        held = rest.where("not grow").agg(*[F.coalesce(F.sum(F.when(covers(h), F.lit(1)).otherwise(0) * (F.col("bad") == y).cast("int")), F.lit(0)).alias(f"c{i}_{y}") for i, h in enumerate(heads) for y in (0, 1)]).first()
        scored = [((held[f"c{i}_1"] - held[f"c{i}_0"]) / max(1, held[f"c{i}_1"] + held[f"c{i}_0"]), -i) for i in range(len(heads))]
        i = -max(scored)[1]
        p, n = held[f"c{i}_1"], held[f"c{i}_0"]
        if p < support or p < precision * (p + n):
            refused.add(rule[0][:2])
            continue
        # Of several thresholds on one side of a feature the tightest says all.
        tight = {(f, above): (max if above else min)(k for g, up, k in heads[i] if (g, up) == (f, above)) for f, above, _ in heads[i]}
        found.append([(f, above, k) for (f, above), k in tight.items()])
        refused.clear()
    return DecisionList([Rule(tuple(Condition(f, above, cuts[f][k]) for f, above, k in cs)) for cs in found])


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document its statistics, base_failed, kept, and the rule that rejected it.

    docs: doc_id, text; labels: doc_id, quality. Other columns stay in `row`, whatever their names. Repeated
    rows are judged one by one; a null doc_id is judged like any other. An empty table gives an empty result.
    """
    rules = fit(labelled(docs, labels, sample))
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", rules.fired()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the rules keep, with the columns they came with."""
    # A filter would be pushed below the statistics and repeat them; a generator isn't.
    return judge(docs, labels, sample).select(F.inline(F.when(F.col("kept"), F.array("row"))))
