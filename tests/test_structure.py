from __future__ import annotations

from bidloom.operators import documents as d
from bidloom.operators import graph, store
from bidloom.streaming import runs


def test_chains_and_levels():
    assert d.longest_chain(["a", "b", "x", "c", "a"]) == [0, 1, 3]
    assert d.longest_chain(["a", "a", "b"]) == [1, 2]
    assert d.levels(["a", "b", "i", "ii", "c"]) == [0, 0, 1, 1, 0]
    assert d.reading_lines([(0, 10), (1, 11), (30, 40)]) == [0, 0, 1]


def test_per_group(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "i")], "g int, o int, m string")
    got = d.per_group(df, ["g"], "o", "m", "level", "int", d.levels).orderBy("o").collect()
    assert [r["level"] for r in got] == [0, 0, 1]


def test_ambiguous_citation(spark):
    nodes = spark.createDataFrame([("d", "document", "d"), ("d:1", "clause", "1"), ("d:x:1", "clause", "1"), ("d:2", "clause", "2")], "id string, kind string, ident string")
    cites = spark.createDataFrame([("a", "d", [("clause", "1")]), ("b", "d", [("clause", "2")]), ("c", "d", [("clause", "9")])], "cite string, scope string, path array<struct<kind:string,ident:string>>")
    got = {r["cite"]: (r["id"], r["outcome"]) for r in graph.resolved(cites, nodes).collect()}
    assert got == {"a": (None, "ambiguous"), "b": ("d:2", "unique"), "c": (None, "unresolved")}


def test_states():
    assert [s for s, _, _ in runs.replayed(["queued", "running", "queued", "running", "done", "running"])] == ["queued", "running", "queued", "running", "done", "done"]
    assert runs.replayed(["queued", *["running", "queued"] * 5])[-1][0] == "dead"


def test_state_stream(spark, tmp_path):
    rows = [(1, 1, "queued"), (1, 2, "running"), (2, 1, "running"), (1, 3, "done")]
    events = spark.createDataFrame(rows, "run_id long, ord long, wanted string")
    assert {(r["run_id"], r["ord"], r["state"], r["effect"]) for r in runs.batch_transitions(events).collect()} == {(1, 1, "queued", "moved"), (1, 2, "running", "moved"), (1, 3, "done", "moved"), (2, 1, "", "refused")}


def test_windows_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (1, "2024-01-01 00:02:00")], "key long, t string").selectExpr("key", "cast(t as timestamp) as at")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = runs.call_windows(stream).writeStream.outputMode("complete").format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["calls"] for r in spark.table("calls").collect()) == [1, 2]


def test_corrections(spark):
    f = spark.createDataFrame([(1, "a", "5", "5 mg", True), (1, "b", "x", "x", False)], "run_id int, field_id string, value string, printed string, verified boolean")
    c = spark.createDataFrame([(1, "a", "6", "r"), (1, "b", "text", "r")], "run_id int, key string, value string, reason string")
    got = {r["field_id"]: (r["value"], r["printed"], r["verified"], r["model_value"]) for r in store.with_corrections(f, c).collect()}
    assert got == {"a": ("6", "5 mg", None, "5"), "b": ("text", None, None, "x")}


def test_footers(spark):
    from pyspark.sql import functions as F

    from bidloom.operators import structure as s

    pages = {
        "text\nTerms of Tender Page 4 of 9": ("Terms of Tender", 4, 9), "a 3.2 Price (Rev) Form - B Page 1 of 2": ("Price (Rev) Form - B", 1, 2), "Ref. No. 7 (x)\nPage 2 of 3": ("Ref. No. 7 (x)", 2, 3), "Page 2 of 3\nG.F. 1\nbody": ("G.F. 1", 2, 3),
        "Page 2 of 3\nG.F. 1": None, "Page 1 of 2\nPage 2 of 2\n": ("Page 2 of 2", 1, 2), "第十頁，共一百二十三頁\nG.F. 9\n正文": ("G.F. 9", 10, 123), "第百頁，共二〇頁\nG.F. 9\n正文": ("G.F. 9", 100, 0), "no numbers": None, "abc Page 1 of 2": None, "": None, None: None,
        "G.F. 1\nPage 9 of 10\nLater Words Page 1 of 2": ("Later Words", 1, 2), "the Long " + "Name " * 12 + "Page 3 of 4": ("Name Name Name Name Name Name Name Name Name", 3, 4),
    }
    df = spark.createDataFrame(list(enumerate(pages)), "i int, text string").select("i", s.page_footer(F.col("text")).alias("f"))
    got = {r["i"]: None if r["f"] is None else tuple(r["f"]) for r in df.collect()}
    for i, (text, want) in enumerate(pages.items()):
        assert got[i] == want, text
    numbers = {"一": 1, "十": 10, "十二": 12, "二十": 20, "九十九": 99, "一百": 100, "一百零三": 103, "二百一十": 210, "九百九十九": 999}
    df = spark.createDataFrame(list(numbers), "string").select("value", s.zh_number(F.col("value")).alias("n"))
    assert {r["value"]: r["n"] for r in df.collect()} == numbers


def test_line_marks():
    from bidloom.operators.structure import line_mark

    cases = {
        ("PART 4 — OFFER", "", ""): ("part_inline", "4", "OFFER"), ("PART 3A", "TITLE", ""): ("part", "3A", "TITLE"), ("PART XI-Title", "", ""): ("part_inline", "XI", "Title"), ("PART 4 – OFFER", "", ""): None, ("PART THE", "LAST", ""): None, ("PART 4 of", "A", ""): None,
        ("Annex D", "Form of offer", ""): None, ("Annex D to the Terms", "Form", ""): ("annex", "D", "Form"), ("Annex 2 to the Terms", " ", "Form"): ("annex", "2", "Form"), ("Annex D to the Terms", "Page 1 of 2", ""): None, ("ANNEX D to the Terms", "Form", ""): None, ("Annex D to the Terms", "form", ""): None,
        ("20. Title", "", ""): ("clause", "20", "Title"), ("20.", "  Title", ""): ("clause", "20", "Title"), ("20. title", "", ""): None, ("20.Title", "", ""): ("clause", "20", "Title"), ("20.2 For", "", ""): ("subclause", "20.2", None), ("20.2", "(For", ""): ("subclause", "20.2", None),
        ("20.2 of", "", ""): None, ("20.2. For", "", ""): None, ("1.2.3 \"For", "", ""): ("subclause", "1.2.3", None), ("(a) x", "", ""): ("subitem", "a", None), ("(xiii)", "", ""): ("subitem", "xiii", None) if len("xiii") <= 4 else None, ("(abc)", "", ""): None, ("(1) x", "", ""): None, ("", "", ""): None,
    }
    for args, want in cases.items():
        assert line_mark(*args) == want, args


def test_subtree(spark):
    import pytest

    rows = [("a", None, 1), ("b", "a", 2), ("c", "b", 3), ("d", "a", 4), ("e", None, 5), ("f", "e", 6), ("x", "y", 7), ("y", "x", 8)]
    nodes = spark.createDataFrame(rows, "id string, parent string, ord int")
    roots = spark.createDataFrame([("a",), ("b",), ("gone",)], "id string")
    got = sorted((r["root"], r["path"], r["id"], r["depth"]) for r in graph.subtree(nodes, roots).collect())
    assert got == [("a", [1], "a", 0), ("a", [1, 2], "b", 1), ("a", [1, 2, 3], "c", 2), ("a", [1, 4], "d", 1), ("b", [2], "b", 0), ("b", [2, 3], "c", 1)]
    with pytest.raises(ValueError, match="cycle"):
        graph.subtree(nodes, spark.createDataFrame([("x",)], "id string"))


def test_many_groups(spark):
    """Groups go through Python by thousands, an array each."""
    import time

    k = spark.range(60_000).selectExpr("id AS g", "explode(array(2, 1, 3)) AS o").selectExpr("g", "o", "element_at(array('a', 'b', 'i'), o) AS m", "named_struct('x', g) AS more")
    begin = time.time()
    got = d.per_group(k, ["g"], "o", "m", "level", "int", d.levels)
    assert got.where("level = IF(o = 3, 1, 0) AND more.x = g").count() == 180_000
    assert time.time() - begin < 30
