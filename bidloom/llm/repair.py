"""Conversation structure repair: cheapest edits to a legal order of roles, by arcs that are tight in both directions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import having, hinted, lacking, saved

DELETE, INSERT, KEEP_TRUNCATED, REROLE = 4, 3, 3, 3
#: Messages, and characters about, of one chunk of a conversation.
CHUNK_ROWS, CHUNK_CHARS = 4096, 8 << 20
#: States of a legal order `(s?(ua)+)?`: nothing yet, after system, after user, after assistant; and what a new role must be there.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
FITS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}


def _arcs(code: str) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, next state) by state for a message: x must go; else the role's initial, o for others, capital if truncated."""
    extra = KEEP_TRUNCATED * code.isupper()
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if code != "x":
            if (to := FITS.get((q, code.lower()))) is not None:
                arcs.append(("K", extra, to))
            arcs.append(("R", REROLE + extra, WANTED[q][1]))
        out.append(arcs)
    return out


ARCS = {c: _arcs(c) for c in "suaoSUAOx"}


def _after_inserts(f: list[int]) -> list[int]:
    """Forward costs at a node, with insertions there."""
    user = min(f[USER], INSERT + min(f[START], f[SYSTEM], f[ASSISTANT]))
    return [f[START], f[SYSTEM], user, min(f[ASSISTANT], INSERT + user)]


def _before_inserts(b: list[int]) -> list[int]:
    """Backward costs at a node, with insertions there."""
    user = min(b[USER], INSERT + b[ASSISTANT])
    return [min(b[START], INSERT + user), min(b[SYSTEM], INSERT + user), user, min(b[ASSISTANT], INSERT + b[USER])]


#: Costs from the end of a conversation: nothing or a closed pair are legal there.
END = _before_inserts([0, FAR, FAR, 0])
BEGIN = [0, FAR, FAR, FAR]


def forward(codes: str, f: list[int]) -> list[list[int]]:
    """Least costs of each state before each message and after the last: insertions there are counted before messages only."""
    out = []
    for c in codes:
        f = _after_inserts(f)
        out.append(f)
        new = [FAR] * 4
        for q, arcs in enumerate(ARCS[c]):
            if f[q] < FAR:
                for _, cost, to in arcs:
                    if f[q] + cost < new[to]:
                        new[to] = f[q] + cost
        f = new
    return [*out, f]


def backward(codes: str, b: list[int]) -> list[list[int]]:
    """Least costs to the end from each state before each message; b: those behind the last, insertions there included."""
    out = [b]
    for c in reversed(codes):
        b = _before_inserts([min(cost + b[to] for _, cost, to in arcs) for arcs in ARCS[c]])
        out.append(b)
    return out[::-1]


def least(codes: str, f: list[list[int]], b: list[list[int]], best: int, start: int, last: bool) -> tuple[str, int]:
    """(letters, end state) of the least string of edits along tight arcs: those whose cost makes the forward cost before and
    the backward cost behind them up to the best total. The frontier, all states that the letters so far lead to, takes
    the least letter that a tight arc from it bears. Insertions behind the last message: only if `last`."""
    frontier, letters, i = {start}, [], 0
    while i < len(codes) or last and not any(f[i][q] == best and q in (START, ASSISTANT) for q in frontier):
        steps: dict[str, set[int]] = {}
        for q in frontier:
            arcs = [("I", INSERT, WANTED[q][1], i)]
            if i < len(codes):
                arcs += [(letter, cost, to, i + 1) for letter, cost, to in ARCS[codes[i]][q]]
            for letter, cost, to, j in arcs:
                if f[i][q] + cost + b[j][to] == best:
                    steps.setdefault(letter, set()).add(to)
        letter = min(steps)
        letters.append(letter)
        frontier, i = steps[letter], i + (letter != "I")
    return "".join(letters), min(frontier)


def edited(letters: str, start: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the messages that the edits leave or make."""
    out, q, i = ([], []), start, 0
    for letter in letters:
        role, text = ("", "") if letter == "I" else (roles[i], texts[i])
        if letter in "IR":
            role, q = WANTED[q]
        elif letter == "K":
            q = FITS[q, role[:1]]
        i += letter != "I"
        if letter != "D":
            out[0].append(role)
            out[1].append(text)
    return out


def coded(role: str, text: str, seen: set) -> tuple[str, str]:
    """(fault or "", code) of a message; seen: roles and texts before it, to which it is added."""
    body = text.rstrip("\x20\t\n\x0b\x0c\r")
    if not body:
        return "blank", "x"
    if (role, text) in seen:
        return "duplicate", "x"
    seen.add((role, text))
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return ("", initial) if body[-1] in ".!?" else ("truncated", initial.upper())


STATS = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
NAMES = [x.split(" ")[0] for x in STATS.split(", ")]
MADE = f"conv_id long, conv string, seq long, n int, codes string, {STATS}, first string, last string, roles array<string>, texts array<string>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """rows as batches, cut by number and by the characters of their strings."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) if isinstance(x, str) else sum(len(y) for y in x if isinstance(y, str)) if isinstance(x, list) else 8 for x in r)
        if len(held) >= most or chars >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _mapped(df: DataFrame, each, ddl: str) -> DataFrame:
    """df with each(rows as tuples) -> rows, in batches."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        return _batches(each(rows), schema)

    return df.mapInArrow(run, ddl)


def chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """conv_id, seq, codes, roles, texts and figures of chunks of conversations: rows in order of conversation, turn (nulls
    first), role and text are dealt by ranges of all four, so that a conversation of any share lies over many tasks.

    rows: conv_id, turn, role, text, copies; copies follow each other, and 0 of them leave no more than the
    conversation's id. A chunk ends with its conversation or task, or when it is full; seq orders a conversation's.
    Duplicates are found within a chunk here.
    """
    order = ["conv_id", "turn", "role", "text"]
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = rows.select(*order, "copies").repartitionByRange(many, *order).sortWithinPartitions(*order)

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        k, own, conv = TaskContext.get().partitionId() << 32, None, None
        for conv_id, turn, role, text, copies in rows:
            if own is None or conv_id != conv or own["n"] >= chunk_rows or own["chars"] >= CHUNK_CHARS:
                if own is not None:
                    yield made(conv, k, own)
                    k += 1
                conv, own = conv_id, {"n": 0, "chars": 0, "codes": [], "roles": [], "texts": [], "turns": [], "seen": set(), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            for _ in range(copies):
                fault, code = coded(role, text, own["seen"])
                if fault:
                    own[fault] += 1
                if own["roles"]:
                    own["illegal"] += own["roles"][-1][:1] + role[:1] not in LEGAL
                for name, x in (("codes", code), ("roles", role), ("texts", text)):
                    own[name].append(x)
                if turn is not None:
                    own["turns"].append(turn)
                own["n"] += 1
                own["chars"] += len(text)
        if own is not None:
            yield made(conv, k, own)

    def made(conv: int | None, k: int, x: dict) -> tuple:
        t, r = x["turns"], x["roles"]
        return (conv, "" if conv is None else str(conv), k, x["n"], "".join(x["codes"]), x["blank"], x["duplicate"], x["truncated"], x["illegal"], t[0] if t else None, t[-1] if t else None, len(set(t)), r[0][:1] if r else None, r[-1][:1] if r else None, r, x["texts"])

    return _mapped(df, each, MADE)


def _matrix(codes: str) -> list[int]:
    """Least cost from each state to each over a chunk, 16 numbers."""
    return [x for q in range(4) for x in forward(codes, [0 if p == q else FAR for p in range(4)])[-1]]


def _linked(found: DataFrame) -> DataFrame:
    """conv, seq, start, letters, cost and figures for chunks of conversations that have several.

    A message is a duplicate if its digest came in an earlier chunk: the first places of digests are an aggregation, met by an equi
    join of digests. Each chunk then is a 4 by 4 table of least costs; running products of these over a conversation's
    chunks, one narrow row for each, give forward costs at its begin and backward costs at its end. With both, a chunk's
    tight arcs are known, and so the letters that follow from each state; which state it starts in is a second walk
    over the narrow rows.
    """

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, seq, codes, roles, texts in rows:
            for i, (c, r, t) in enumerate(zip(codes, roles, texts, strict=True)):
                if c != "x":
                    yield conv, hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest(), seq, i

    every = saved(_mapped(found.select("conv", "seq", "codes", "roles", "texts"), digests, "conv string, digest binary, seq long, i int"), "digests")
    first = every.groupBy("conv", "digest").agg(F.min("seq").alias("first"))
    again = every.join(first, ["conv", "digest"]).where("seq > first").groupBy("conv", "seq").agg(F.collect_list("i").alias("again"))
    narrow = found.select("conv", "seq", "n", "codes", *NAMES, "first", "last").join(hinted(saved(again, "again")), ["conv", "seq"], "left")

    def tables(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, seq, _, codes, blank, duplicate, truncated, *rest, repeated in rows:
            own = list(codes)
            for i in repeated or ():
                duplicate += 1
                truncated -= own[i].isupper()
                own[i] = "x"
            codes = "".join(own)
            yield conv, seq, codes, blank, duplicate, truncated, *rest, _matrix(codes)

    seen = f"conv string, seq long, codes string, {STATS}, first string, last string, matrix array<long>"
    narrow = saved(_mapped(narrow, tables, seen), "tables")

    def walk(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seq", ignore_index=True)
        tables = [[list(m[4 * q : 4 * q + 4]) for q in range(4)] for m in df["matrix"]]
        f, before, last, high, extra = BEGIN, [], None, None, []
        for m, a, z, low, top in zip(tables, df["first"], df["last"], df["low"], df["high"]):
            before.append(f)
            f = [min(FAR, *(f[p] + m[p][q] for p in range(4))) for q in range(4)]
            some = isinstance(a, str)
            extra.append((int(some and last is not None and last + a not in LEGAL), int(isinstance(low, str) and low == high)))
            last, high = (z if some else last), (top if isinstance(top, str) else high)
        best = min(f[q] + END[q] for q in range(4))
        b, behind = END, []
        for m in reversed(tables):
            behind.append(b)
            b = [min(FAR, *(m[q][p] + b[p] for p in range(4))) for q in range(4)]
        return pd.DataFrame({"conv": df["conv"], "seq": df["seq"], "before": before, "behind": behind[::-1], "cost": best, "final": [*[0] * (len(df) - 1), 1], "illegal_more": [x for x, _ in extra], "turns_less": [x for _, x in extra]})

    costs = saved(narrow.select("conv", "seq", "matrix", "first", "last", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high")).groupBy("conv").applyInPandas(walk, "conv string, seq long, before array<long>, behind array<long>, cost long, final int, illegal_more long, turns_less long"), "costs")

    def ways(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, seq, codes, before, behind, cost, final in rows:
            f, b = forward(codes, before), backward(codes, behind)
            if final:
                f[-1] = _after_inserts(f[-1])
            found = [least(codes, f, b, cost, q, bool(final)) if f[0][q] + b[0][q] == cost else (None, -1) for q in range(4)]
            yield conv, seq, [x for x, _ in found], [x for _, x in found]

    paths = narrow.select("conv", "seq", "codes").join(hinted(costs), ["conv", "seq"]).select("conv", "seq", "codes", "before", "behind", "cost", "final")
    paths = saved(_mapped(paths, ways, "conv string, seq long, letters array<string>, ends array<int>"), "paths")

    def started(df: pd.DataFrame) -> pd.DataFrame:
        df, q, out = df.sort_values("seq", ignore_index=True), START, []
        for ends in df["ends"]:
            out.append(q)
            q = int(ends[q])
        return pd.DataFrame({"conv": df["conv"], "seq": df["seq"], "start": out})

    starts = saved(paths.select("conv", "seq", "ends").groupBy("conv").applyInPandas(started, "conv string, seq long, start int"), "starts")
    figures = [(F.col(c) + F.col("illegal_more")).alias(c) if c == "illegal" else (F.col(c) - F.col("turns_less")).alias(c) if c == "turns" else F.col(c) for c in NAMES]
    out = narrow.join(hinted(costs), ["conv", "seq"]).select("conv", "seq", "cost", *figures)
    chosen = paths.join(hinted(starts), ["conv", "seq"]).select("conv", "seq", "start", F.get("letters", "start").alias("letters"))
    return saved(out.join(hinted(chosen), ["conv", "seq"]), "letters")


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Chunks of conversations with edits: (of those that are whole in one chunk, of the others). Columns: conv_id, conv, seq,
    cost (the conversation's), letters, start, the figures of STATS, roles and texts as they were; figures of a conversation's
    chunks add up (low and high: least and greatest).

    rows: conv_id, turn, role, text (not null but for conv_id and turn), copies. A message is blank (nothing but white
    space), a duplicate (its role and text came before) or truncated (its last character isn't one of .!?), whichever fits
    first. Null ids are one conversation; messages of equal turns are ordered by role and text; an empty role fits
    nowhere; further columns are left out; an empty table gives no chunks.
    """
    made = saved(chunks(rows, chunk_rows), "chunks")
    several = saved(made.groupBy("conv").count().where("count > 1").select("conv"), "several")

    def alone(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, conv, seq, codes, *figures, roles, texts in rows:
            f, b = forward(codes, BEGIN), backward(codes, END)
            f[-1] = _after_inserts(f[-1])
            cost = b[0][START]
            yield conv_id, conv, seq, cost, least(codes, f, b, cost, START, True)[0], START, *figures, roles, texts

    columns = ["conv_id", "conv", "seq", "codes", *NAMES, "roles", "texts"]
    ddl = f"conv_id long, conv string, seq long, cost long, letters string, start int, {STATS}, roles array<string>, texts array<string>"
    ones = _mapped(lacking(made, several, "conv").select(*columns), alone, ddl)
    found = having(made, several, "conv")
    if several.isEmpty():
        return ones, ones.limit(0)
    edits = _linked(found)
    rest = found.select("conv_id", "conv", "seq", "roles", "texts").join(hinted(edits), ["conv", "seq"])
    return ones, rest.select("conv_id", "conv", "seq", "cost", "letters", "start", *NAMES, "roles", "texts")


def messages(edits: tuple[DataFrame, DataFrame]) -> DataFrame:
    """conv_id, seq, position (in the chunk), role, text: the repaired conversations, ordered by seq and position."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, seq, letters, start, roles, texts in rows:
            for i, (r, t) in enumerate(zip(*edited(letters, start, roles, texts), strict=True)):
                yield conv_id, seq, i, r, t

    every = edits[0].unionByName(edits[1])
    return _mapped(every.select("conv_id", "seq", "letters", "start", "roles", "texts"), each, "conv_id long, seq long, position int, role string, text string")


def digested(edits: tuple[DataFrame, DataFrame]) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    A conversation's digest and letters are one stream, so its chunks pass one task in order, a batch at a time; those in
    one chunk don't move."""

    def streamed(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for conv_id, conv, _, cost, letters, start, *figures, roles, texts in rows:
            if now is None or now["conv"] != conv:
                if now is not None:
                    yield done(now)
                now = {"conv": conv, "conv_id": conv_id, "cost": cost, "sum": [0] * 5, "low": None, "high": None, "letters": [], "sha": hashlib.sha256(), "any": False}
            blank, duplicate, truncated, illegal, low, high, turns = figures
            now["sum"] = [x + y for x, y in zip(now["sum"], (blank, duplicate, truncated, illegal, turns), strict=True)]
            now["low"] = low if now["low"] is None else now["low"] if low is None else min(now["low"], low)
            now["high"] = high if now["high"] is None else now["high"] if high is None else max(now["high"], high)
            now["letters"].append(letters)
            for r, t in zip(*edited(letters, start, roles, texts), strict=True):
                now["sha"].update(f"{'\n' if now['any'] else ''}{r}:{t}".encode())
                now["any"] = True
        if now is not None:
            yield done(now)

    def done(x: dict) -> tuple:
        blank, duplicate, truncated, illegal, turns = x["sum"]
        gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - turns
        return x["conv_id"], gaps, blank, duplicate, truncated, illegal, x["cost"], "".join(x["letters"]), x["sha"].hexdigest()

    ddl = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ones, rest = edits
    return _mapped(ones, streamed, ddl).unionByName(_mapped(rest.repartition("conv").sortWithinPartitions("conv", "seq"), streamed, ddl))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: conversations with faults by crc32("conv_id:turn") % 20. Nulls count as one space;
    ids and turns only in that key."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _oracle() -> str:
    """Forward over messages with, for each state, the least (cost, letters) and what is left: no backward pass, no arcs."""
    state = lambda cost, letters, out: f"{{'c': {cost}, 'a': {letters}, 'o': {out}}}"
    insert = lambda q, role: state(f"{q}.c + 3", f"{q}.a || 'I'", f"{q}.o || chr(10) || '{role}:'")
    drop = lambda q: state(f"{q}.c + 4", f"{q}.a || 'D'", f"{q}.o")
    keep = lambda q, i: f"CASE WHEN code = '{i}' THEN {state(f'{q}.c + extra', f"{q}.a || 'K'", f"{q}.o || chr(10) || role || ':' || text")} END"
    rerole = lambda q, role: f"CASE WHEN code <> 'x' THEN {state(f'{q}.c + 3 + extra', f"{q}.a || 'R'", f"{q}.o || chr(10) || '{role}:' || text")} END"
    best = lambda *x: f"list_min([{', '.join(x)}])"
    far = state("1000000000000", "''", "''")
    closed = f"(SELECT *, {best('a0', insert('u', 'assistant'))} AS a FROM (SELECT *, {best('u0', insert('s', 'user'), insert('y', 'user'), insert('a0', 'user'))} AS u FROM w) t1)"
    return rf"""WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (SELECT * EXCLUDE key, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM k),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final FROM m),
p AS (SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM n),
q AS MATERIALIZED (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' ELSE role[1] END AS code, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM p),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {state('0::BIGINT', "''", "''")} AS s, {far} AS y, {far} AS u0, {far} AS a0 FROM conversations
 UNION ALL
 SELECT t.conv_id, q.i, {drop('s')}, {best(drop('y'), keep('s', 's'))}, {best(drop('u'), keep('s', 'u'), keep('y', 'u'), keep('a', 'u'), rerole('s', 'user'), rerole('y', 'user'), rerole('a', 'user'))}, {best(drop('a'), keep('u', 'a'), rerole('u', 'assistant'))}
 FROM {closed} t JOIN q ON t.conv_id IS NOT DISTINCT FROM q.conv_id AND q.i = t.i + 1),
e AS (SELECT conv_id, {best('s', 'a')} AS b FROM {closed} t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(b.o[2:]) AS repaired_sha256
FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id"""


ORACLE = _oracle()
