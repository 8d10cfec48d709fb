"""Page ranges against plain splits, likeness against the standard library, key paths."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from bidloom.functions import text
from bidloom.operators import matches
from bidloom.sources.page_source import PageSource


def test_pages_in_ranges(spark, tmp_path):
    rng = random.Random(2)
    files = {"a.txt": ["one"], "b/c.txt": ["", "x" * 150, "ä" * 40, "", "last"], "b/d.txt": [], "e.txt": ["p" * rng.randrange(0, 90) for _ in range(60)], "~$a.txt": ["no"], "f.pdf": ["no"]}
    for name, pages in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes("".join(p + "\f" for p in pages).encode() if name != "e.txt" else "\f".join(pages).encode())
    spark.dataSource.register(PageSource)
    want = sorted([("a.txt", 1, "one"), *(("b/c.txt", i + 1, p) for i, p in enumerate(files["b/c.txt"])), ("b/d.txt", 1, ""), *(("e.txt", i + 1, p) for i, p in enumerate(files["e.txt"]))])
    if not files["e.txt"][-1]:
        want.remove(("e.txt", 60, ""))
    for size in (1, 7, 64, 1 << 20):
        df = spark.read.format("page_texts").option("bytes", size).load(str(tmp_path))
        assert sorted((r["file"], r["page"], r["text"]) for r in df.collect()) == want
    assert df.where("has_text").count() == 1


def test_ranges_are_read_once_for_texts(spark, tmp_path):
    """Pages of all sizes of ranges, with parts as one file, and no range that reads what stands before it."""
    from bidloom.sources import page_source

    rng = random.Random(4)
    files = {f"f={f}/part-{p}.txt": ["q" * rng.randrange(0, 7) for _ in range(rng.randrange(1, 6))] for f in (1, 2) for p in range(3)}
    for name, pages in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes("".join(p + "\f" for p in pages).encode())
    want = sorted((f, i + 1, p) for f in "12" for i, p in enumerate(x for n in sorted(files) if n.startswith(f"f={f}") for x in files[n]))
    for size in (1, 5, 1 << 20):
        got = page_source.pages(spark, str(tmp_path), size, "f=([0-9]+)")
        assert sorted((r["file"], r["page"], r["text"]) for r in got.collect()) == want
    one = page_source.pages(spark, str(tmp_path), 7)
    assert sorted((r["file"], r["page"], r["text"]) for r in one.collect()) == sorted((n, i + 1, p) for n, ps in files.items() for i, p in enumerate(ps))


def test_similarity(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc d", k=rng.randrange(0, 300))), "".join(rng.choices("abc d", k=rng.randrange(0, 300)))) for _ in range(100)] + [("", ""), ("a", ""), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.similarity("a", "b").alias("s")).collect()
    for r in got:
        assert r["s"] == (None if r["a"] is None else difflib.SequenceMatcher(None, r["a"], r["b"]).ratio())


def test_key_paths(spark):
    want = {
        "ToT:3.3(a)(i)": [["3.3", "(3.3)"], ["(a)"], ["(i)"]], "I:TableB:Row(c)": [["PB", "TB"], ["c", "(c)"]], "P:PartA:Item1": [["PA", "TA"], ["1", "(1)"]], "NCTC": [], "T:2:Glossary": None, "P:Notes": None, "P:Note(ii)": None, "X:PartIA": [["PIA", "TIA"]],
    }
    df = spark.createDataFrame(list(want), "string").select("value", matches.marker_path(F.col("value")).alias("p"))
    assert {r["value"]: r["p"] for r in df.collect()} == want


def test_titles(spark):
    long = "word " * 30
    want = {"(a) Proof, i.e. a letter. More": "Proof, i.e. a letter.", "(b)\n x; y": "x;", "3. z": "3.", long: ("word " * 24).strip() + " ...", "(ab) q": "(ab) q"}
    df = spark.createDataFrame(list(want), "string").select("value", text.title("value").alias("t"))
    assert {r["value"]: r["t"] for r in df.collect()} == want


def test_keys_met_by_shuffles(spark):
    """However small the planner takes exploded nodes and packed keys for, no side of a join goes through the driver."""
    from bidloom.plans import registry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = registry.QUERIES["key_matches"](spark, "/root/testdata/sf0.001")
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 10 * spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
