"""Repaired conversations against a search over whole strings of edits, in one chunk and in many, and against SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import duckdb

from bidloom.llm import queries, repair

FOLDER = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"s?(ua)*u?")


def hurt(rows: list[tuple]) -> dict:
    """Conversations after damage, in order."""
    out: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def searched(rows: list[tuple]) -> tuple:
    """The row of one conversation: strings of edits are tried in order of cost and letters until one gives a legal order."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(initials):
            break
        if (i, initials[-1:] if len(initials) else "", initials == "s") in done:
            continue
        done.add((i, initials[-1:], initials == "s"))
        steps = [("I", 3, r, "", i) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append(("D", 4, None, None, i + 1))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                steps += [("K", more, role, text, i + 1), ("R", 3 + more, "user", text, i + 1), ("R", 3 + more, "assistant", text, i + 1)]
        for letter, more, role, text, j in steps:
            new = initials + ("" if role is None else role[:1] or "?")
            if PREFIX.fullmatch(new):
                heapq.heappush(heap, (cost + more, letters + letter, j, new, out if role is None else (*out, f"{role}:{text}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def rows_of(df) -> dict:
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def messy(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "so", "", " \t", "A long answer", "Fine. ", "Ä.", None, *[f"text {i}." for i in range(6)]]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_in_one_chunk_and_in_many(spark):
    for n, seed in ((60, 1), (150, 2)):
        rows = messy(n, seed)
        want = {c: searched(x) for c, x in hurt(rows).items()}
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, letters string")
        for size in (repair.CHUNK_ROWS, 3):
            assert rows_of(repair.digested(repair.repaired(repair.damaged(df), size))) == want


def test_long_conversation(spark):
    """One conversation of most rows, with turns and texts of its own, over many chunks: as in one piece."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "again."])) for t in range(1500)] + [(i, t, "user", "Hi.") for i in range(40) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {c: searched(x) for c, x in hurt(rows).items()}
    edits = repair.repaired(repair.damaged(df), 64)
    assert rows_of(repair.digested(edits)) == want
    out = [r for r in repair.messages(edits).collect() if r["conv_id"] == 7]
    text = "\n".join(f"{r['role']}:{r['text']}" for r in sorted(out, key=lambda r: (r["seq"], r["position"])))
    assert hashlib.sha256(text.encode()).hexdigest() == want[7][-1]


def test_repair_of_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet'").fetchall()
    got = rows_of(queries.op13_conversation_repair(spark, FOLDER))
    assert got == {c: searched(x) for c, x in hurt(rows).items()}


def sql(rows: list[tuple]) -> dict:
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r[0]: r[1:] for r in db.execute(f"SELECT conv_id, {', '.join(names)} FROM ({queries.ORACLE_SQL['op13_conversation_repair']})").fetchall()}


def test_repair_against_sql(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{FOLDER}/conversations.parquet'").fetchall()
    assert sql(rows) == {c: searched(x) for c, x in hurt(rows).items()}


def test_no_rows_after_damage(spark):
    """Every id comes back: here one whose only message is dropped; an empty table gives none."""
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(drop, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert rows_of(repair.digested(repair.repaired(repair.damaged(df)))) == {drop: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.digested(repair.repaired(repair.damaged(df.limit(0)))).count() == 0
