"""Personal data: fixed patterns, and bootstrapped contextual extraction, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, saved

KINDS = ("email", "ip", "card", "phone")
#: What each kind's pattern finds is fixed; a lookbehind or possessive quantifier only keeps long runs linear.
#: Of card only runs of 13 to 19 digits are matched, since others are dropped anyway.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # What may be an identifier: a run without white space that holds a digit or an at sign, and groups of digits behind it.
    "token": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[(+]?[0-9][^\x20\x09-\x0D]*+)*+",
}
_QUICK = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": r"[0-9@]"}
#: Runs without white space beside a mention that are looked at; those without letters and digits are passed over.
NEAR = 6
ROUNDS = 3
#: A pattern is trusted from so many distinct known instances, and from this confidence.
SUPPORT, CONFIDENCE = 5, 0.9


def _valid(kind: str) -> str:
    digits = "regexp_replace(s.value, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": "forall(split(s.value, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)",
        "card": f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + element_at(array(0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9), cast(substr({digits}, length({digits}) - i, 1) as int) + 1 + 10 * (i % 2))) % 10 = 0",
        "phone": f"length({digits}) between 9 and 15",
        "token": "true",
    }[kind]


def _let(name: str, value: str, body: str) -> str:
    """body with value bound to name once; the optimiser would copy a column into each use within a lambda."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(name: str, array: str, zero: str, step: str, body) -> str:
    """body(at), where at(i) folds the first i elements of an array of n from zero on: n^(4/3) steps for all i together.

    The array is dealt into blocks; folds of whole blocks are kept, and elements within a block are folded anew.
    (A slice copies its whole array first, so only blocks are sliced.) step: SQL over a and y, with zero neutral.
    """
    values, width, blocks, whole, heads = (f"{name}_{x}" for x in "vwbch")
    at = lambda i: f"aggregate(slice({blocks}[cast(({i}) div {width} as int)], 1, cast(({i}) % {width} as int)), {heads}[cast(({i}) div {width} as int)], (a, y) -> {step})"
    out = _let(heads, f"transform({whole}, (x, j) -> aggregate(slice({whole}, 1, j), {zero}, (a, y) -> {step}))", body(at))
    out = _let(whole, f"transform({blocks}, x -> aggregate(x, {zero}, (a, y) -> {step}))", out)
    out = _let(blocks, f"transform(sequence(0, size({values}) div {width}), j -> transform(sequence(0, {width} - 1), q -> coalesce(get({values}, cast(j * {width} + q as int)), {zero})))", out)
    out = _let(width, f"cast(greatest(16, ceil(power(size({values}), 1 / 3D))) as int)", out)
    return _let(values, array, out)


def _clean(runs: str) -> str:
    """Runs in lower case without marks at their ends; those of marks only are left out."""
    return f"filter(transform({runs}, w -> regexp_replace(lower(w), '^[^\\\\p{{L}}\\\\p{{N}}=]+|[^\\\\p{{L}}\\\\p{{N}}=]+$', '')), w -> w <> '')"


_BLANK = r"'[\\x20\\x09-\\x0D]+'"
#: The text before and after match i, two further matches and the text between them included.
_BEFORE = "concat_ws('', get(c.g, i - 2), get(c.m, i - 2), get(c.g, i - 1), get(c.m, i - 1), c.g[i])"
_AFTER = "concat_ws('', get(c.g, i + 1), get(c.m, i + 1), get(c.g, i + 2), get(c.m, i + 2), get(c.g, i + 3))"


def _found(df: DataFrame, kinds: tuple[str, ...], contexts: bool) -> DataFrame:
    """Adds s_<kind>: array of (start, end, value, and with contexts b and a), code points, of each whole `text`.

    Matches and the texts between them come from the same pattern; starts are running lengths. b: the words before
    a mention, the last first; a: those after it.
    """
    around = "" if not contexts else (
        f", {_clean(f'transform(slice(split(reverse({_BEFORE}), {_BLANK}, {NEAR + 1}), 1, {NEAR}), w -> reverse(w))')} as b"
        f", {_clean(f'slice(split({_AFTER}, {_BLANK}, {NEAR + 1}), 1, {NEAR})')} as a"
    )
    for k in kinds:
        rx = _PATTERN[k].replace("\\", "\\\\")
        spans = _running(
            "p", "transform(c.m, (x, i) -> length(x) + length(c.g[i]))", "0", "a + y",
            lambda at: "transform(c.m, (x, i) -> " + _let("s", f"{at('i')} + length(c.g[i])", f"struct(s as start, s + length(x) as end, x as value{around})") + ")",
        )
        spans = _let("c", f"if(text rlike '{_QUICK[k].replace(chr(92), chr(92) * 2)}', struct(regexp_extract_all(text, '{rx}', 0) as m, split(text, '{rx}', -1) as g), struct(cast(array() as array<string>) as m, array('') as g))", spans)
        df = df.withColumn(f"s_{k}", F.expr(f"filter({spans}, s -> {_valid(k)})"))
    return df


def _keyed(docs: DataFrame) -> DataFrame:
    """`row` with all columns as they came, doc_id, whole text, and a key of both."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return df.withColumn("key", F.xxhash64("doc_id", "text"))


def _patterns(s: str) -> str:
    """Lexical patterns around a mention: two words before it, and one on either side; none where words are missing."""
    return (
        f"filter(array(if(size({s}.b) >= 2, concat('L ', {s}.b[1], ' ', {s}.b[0]), null),"
        f" if(size({s}.b) >= 1 and size({s}.a) >= 1, concat('M ', {s}.b[0], ' _ ', {s}.a[0]), null)), x -> x is not null)"
    )


def discovered(docs: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, end) of identifiers that only their contexts give away.

    Matches of the fixed patterns are seeds. The words around mentions are patterns; patterns and instances form
    a graph. In each round a pattern's confidence is the mean score of its distinct instances, if it has enough
    seeds, and the score of an unknown instance is the noisy-or over its patterns. Unknown mentions in a trusted
    pattern whose score is high are reported under the kind of most of that pattern's seeds. Mentions are counted
    over all documents; edges are distinct, so copies count once.
    """
    df = _found(_keyed(docs), (*KINDS, "token"), contexts=True)
    seeds = "concat(" + ", ".join(f"transform(s_{k}, s -> struct('{k}' as kind, s.start, s.end, lower(s.value) as value, {_patterns('s')} as patterns))" for k in KINDS) + ")"
    head, tail = "'^[^0-9A-Za-z@+]+'", "'[^0-9A-Za-z]+$'"
    unknown = (
        f"transform(s_token, s -> struct(cast(null as string) as kind, s.start + length(s.value) - length(regexp_replace(s.value, {head}, '')) as start,"
        f" s.end - length(s.value) + length(regexp_replace(s.value, {tail}, '')) as end, lower(regexp_replace(regexp_replace(s.value, {head}, ''), {tail}, '')) as value, {_patterns('s')} as patterns))"
    )
    # A filter on mentions would be pushed below all that they are made of.
    mentions = df.select("doc_id", "key", F.explode(F.filter(F.expr(f"concat({seeds}, {unknown})"), lambda m: m["value"] != "")).alias("m")).select("doc_id", "key", "m.*")
    # What overlaps a seed is no unknown: of seeds that start no later the last end, of the others the first start.
    seed, text = F.col("kind").isNotNull(), Window.partitionBy("doc_id", "key")
    reach = F.max(F.when(seed, F.col("end"))).over(text.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    next_ = F.min(F.when(seed, F.col("start"))).over(text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    mentions = mentions.withColumns({"reach": reach, "next": next_})
    mentions = saved(mentions.where(seed | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))).drop("reach", "next"), "mentions")

    edges = saved(mentions.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    known = edges.groupBy("value").agg(F.max("kind").alias("known"))
    edges = saved(edges.join(known, "value").select("pattern", "value", F.col("known").alias("kind")), "edges")
    votes = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("of"), F.sum("n").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    # Only patterns with seeds enough, and unknown instances near them, can change anything.
    graph = saved(edges.join(votes, "pattern"), "graph")
    score = graph.select("value", "kind").distinct().select("value", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    for _ in range(ROUNDS):
        conf = graph.join(score, "value").groupBy("pattern", "of").agg(F.avg("score").alias("conf"))
        gained = graph.where("kind is null").join(conf.select("pattern", "conf"), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))))).alias("score"))
        score = saved(graph.where("kind is not null").select("value", F.lit(1.0).alias("score")).distinct().unionByName(gained), "score")
    trusted = saved(conf.where(F.col("conf") >= CONFIDENCE).select("pattern", F.col("of").alias("kind")), "trusted")
    unseen = mentions.where("kind is null").drop("kind").join(score.where(F.col("score") >= CONFIDENCE), "value").withColumn("pattern", F.explode("patterns"))
    return unseen.join(trusted, "pattern").groupBy("doc_id", "key", "start", "end").agg(F.min("kind").alias("kind"))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: row (its columns), doc_id, text, n_<kind>, base_spans and spans (arrays of kind, start, end).

    docs: doc_id, text; null text counts as empty. Starts and ends are code points, end exclusive. base_spans
    holds the fixed patterns' matches only; spans adds what contexts give away. Both are ordered by kind as
    listed, then start. Repeated rows give repeated rows; an empty table an empty result.
    """
    more = saved(discovered(docs).groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")), "discovered")
    df = _found(_keyed(docs), KINDS, contexts=False)
    df = df.withColumn("base_spans", F.expr("concat(" + ", ".join(f"transform(s_{k}, s -> struct('{k}' as kind, s.start as start, s.end as end))" for k in KINDS) + ")"))
    df = df.withColumns({f"n_{k}": F.size(f"s_{k}").cast("long") for k in KINDS}).drop(*[f"s_{k}" for k in KINDS])
    more = hinted(more).withColumnsRenamed({"doc_id": "its_id", "key": "its_key"})
    df = df.join(more, F.col("key").eqNullSafe(F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left")
    place = "array_position(array('" + "','".join(KINDS) + "'), s.kind)"
    ordered = f"transform(array_sort(transform(concat(base_spans, coalesce(more, filter(base_spans, x -> false))), s -> struct({place} as k, s.start as start, s.end as end, s.kind as kind))), s -> struct(s.kind as kind, s.start as start, s.end as end))"
    return df.withColumn("spans", F.expr(ordered)).select("row", "doc_id", "text", *[f"n_{k}" for k in KINDS], "base_spans", "spans")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by [KIND] and n_chars, where there is one, counted anew; other columns as they came."""
    df = scan(docs)
    # Overlapping spans go as one, under the kind of the first: a span opens a cut if none before it reaches it.
    order = "array_sort(transform(spans, s -> struct(s.start as start, -s.end as last, s.end as end, s.kind as kind)))"
    heads = _running(
        "r", "transform(o, s -> s.end)", "0", "greatest(a, y)",
        lambda at: _let("h", f"filter(transform(o, (s, i) -> if({at('i')} <= s.start, i, null)), x -> x is not null)", f"transform(h, (i, j) -> struct(o[i].start as start, {at('coalesce(get(h, j + 1), size(o))')} as end, o[i].kind as kind))"),
    )
    df = df.withColumn("cut", F.expr(_let("o", order, heads)))
    # A substring is counted from the text's start each time, so texts with many cuts are made of single characters.
    gap = lambda piece: f"transform(cut, (s, i) -> concat({piece('coalesce(get(cut, i - 1).end, 0)', 's.start')}, '[', upper(s.kind), ']'))"
    few = gap(lambda a, b: f"substr(text, {a} + 1, {b} - {a})")
    characters = lambda a, b: f"if({a} < {b}, array_join(transform(sequence({a}, {b} - 1), q -> c[q]), ''), '')"
    many = gap(characters)
    clean = F.expr(
        f"case when size(cut) = 0 then text when size(cut) <= 32 then concat(array_join({few}, ''), substr(text, element_at(cut, -1).end + 1))"
        f" else {_let('c', 'split(text, ' + chr(39) * 2 + ')', f'concat(array_join({many}, {chr(39) * 2}), {characters('element_at(cut, -1).end', 'length(text)')})')} end"
    )
    df = df.withColumn("clean", F.when(F.col("row.text").isNotNull(), clean))
    out = []
    for c in docs.columns:
        out.append(F.col("clean").alias(c) if c == "text" else F.length("clean").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c))
    return df.select(*out)
