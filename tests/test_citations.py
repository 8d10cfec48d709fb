"""Citations, scopes and mentions on hand-built files, and mentions against a plain search."""

from __future__ import annotations

import random
import re
import time

import pytest

from bidloom.operators import citations as cite
from bidloom.plans.citations import NODE

P = "Works Pricing Booklet"
NODES = [
    ("F", "document", None, None, None, None, None, ["OFFER SHEET"], "up/03 Offer Sheet (X.9).pdf"),
    ("F:P2", "part", "2", None, "SIGNATURES", None, None, None, None),
    ("B", "document", None, None, None, None, None, None, None),
    ("B:0", "subdocument", None, None, None, P, None, None, None),
    ("B:0:PA", "part", "A", None, "Unit Rates", None, None, None, None),
    ("B:0:PA:1", "clause", "1", None, None, None, None, None, None),
    ("B:0:PA:4", "clause", "4", None, None, None, None, None, None),
    ("B:0:PA:4.2", "subclause", "4.2", None, None, None, None, None, None),
    ("B:0:PA:4.2:(a)", "subitem", None, "(a)", None, None, None, None, None),
    ("B:0:PA:4.2:(b)", "subitem", None, "(b)", None, None, None, None, None),
    ("B:0:PB", "part", "B", None, None, None, None, None, None),
    ("B:0:PB:(a)", "subitem", None, "(a)", None, None, None, None, None),
    ("B:0:PB:(a):(i):(a)", "subitem", None, "(a)", None, None, None, None, None),
    ("B:1", "subdocument", None, None, None, "Method of Work for Sea Level", None, None, None),
    ("B:1:7", "clause", "7", None, None, None, None, None, None),
    ("B:2", "subdocument", None, None, None, "Sea Level", None, None, None),
    ("B:2:7", "clause", "7", None, None, None, None, None, None),
    ("C", "document", None, None, None, None, None, None, None),
    ("C:P1", "part", "1", None, "GENERAL RULES", None, None, None, None),
    ("C:P1:3", "clause", "3", None, None, None, None, None, None),
    ("C:ANNEX-D", "annex", "D", None, None, None, "Annex D to the General Rules\nBond", None, None),
    ("C:ANNEX-D:PIA", "part", "IA", None, None, None, None, None, None),
    ("C:ANNEX-D:PIB", "part", "IB", None, None, None, None, None, None),
    ("G", "document", None, None, None, None, None, None, None),
    ("G:(6)", "subitem", None, "(6)", None, "Appendix to the General Rules - Visits", None, None, None),
]

CASES = {
    "Paragraph 4.2(b) of the Works Pricing Booklet": ["B:0:PA:4.2:(b)"],
    "Paragraphs 4.2(a) to (c) of the Works Pricing Booklet": ["B:0:PA:4.2", "B:0:PA:4.2:(a)", "B:0:PA:4.2:(b)"],
    "Items 1 and 4 in Part A of the Works Pricing Booklets": ["B:0:PA:1", "B:0:PA:4"],
    "Table A, Table B and Part C of the Works Pricing Booklet in Foreign Currency": [None, "B:0:PA", "B:0:PB"],
    "Clause (a) of Part B of the Works Pricing Booklet": ["B:0:PB:(a)"],
    "Paragraph A of the Works Pricing Booklet": [None],
    "Clause 3 of the General Rules and Part 2 of the Offer Sheet (signed)": ["C:P1:3", "F:P2"],
    "as Annex D to the General Rules - (Part IA - Cash and Part IB - Cheque (if any)) says": ["C:ANNEX-D:PIA", "C:ANNEX-D:PIB"],
    "Part IB in Annex D to the General Rules": ["C:ANNEX-D:PIB"],
    "parts (6) and (7) respectively in the Appendix to the General Rules (Visits)": [None, "G:(6)"],
    "Paragraph 7 of the Outline Method of Work for Sea Level": ["B:1:7"],
    "Paragraph 7 of the Annex 2 to the Method of Work for Sea Level": [None],
    "Paragraph 7 of the Supplement to the Method of Work for Sea Level": [None],
    "Paragraph 7 of the Port of Sea Level": [None],
    "Paragraph 9 of the Unknown Manual": [None],
    "Paragraphs 1 to 3 below": [],
}


def node_frame(spark):
    return spark.createDataFrame([(1, n[0], *n[1:]) for n in NODES], NODE)


@pytest.fixture(scope="module")
def registry(spark):
    return cite.names(node_frame(spark))


def test_where_citations_lead(spark, registry):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    found = cite.citations(cite.chains(docs)).select(F_lit_project(), "doc_id", "name", "path", cite.F.concat_ws("/", "doc_id", "chain", "ord").alias("cite"))
    out = cite.resolved(found, node_frame(spark), registry).join(found.select("cite", "doc_id"), "cite")
    got: dict[int, list] = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["node_id"])
        assert (r["outcome"] == "unresolved") == (r["node_id"] is None)
    for i, (text, want) in enumerate(CASES.items()):
        assert sorted(got.get(i, []), key=str) == sorted(want, key=str), text


def F_lit_project():
    return cite.F.lit(1).alias("project")


def test_registry(registry):
    rows = {(r["key"], r["node_id"]): r["document"] for r in registry.collect()}
    assert rows[("offer sheet", "F")] and rows[("offer sheet x 9", "F")] and not rows[("unit rate", "B:0:PA")]
    assert rows[("annex d to the general rule", "C:ANNEX-D")] and rows[("appendix to the general rule visit", "G")]
    assert ("sea level", "B:2") in rows and ("work pricing booklet", "B:0") in rows


def test_minimal_roots(spark):
    rows = [(1, n, "subdocument", None, None, None, d, None, None, None) for n, d in (("A:0", "Same Name"), ("A:0:x", "Same Name"), ("A:1", "Same Names"), ("B:0", "Other"))]
    rows = [(r[0], r[1], r[2], None, None, None, r[6], None, None, None) for r in rows]
    got = {(r["key"], r["node_id"]) for r in cite.names(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {("same name", "A:0"), ("same name", "A:1"), ("other", "B:0")}


def test_reading_is_quick():
    """Lists that no name follows are read once: no list is tried again from each of its words."""
    texts = ["Paragraphs " + ", ".join(map(str, range(1, 20))) + " and 20 above", " and ".join(f"paragraph {i} of Table A" for i in range(3000)) + " below", "Paragraphs 1" + ", 2" * 5000 + " of the Terms Book", "Terms " * 5000 + "- "]
    begin = time.perf_counter()
    found = [list(cite._Reader(t).chains()) for t in texts]
    assert time.perf_counter() - begin < 2
    assert [len(x) for x in found] == [0, 0, 1, 0] and len(found[2][0][3][0]) == 5001


def test_fields_of_a_citation(spark):
    docs = spark.createDataFrame([(0, "under\n Clause 24.4(b)(i) to (iii) of the Long Terms Shall"), (1, None), (2, "")], "doc_id long, text string")
    got = [(r["name"], r["number"], r["items"]) for r in cite.citations(cite.chains(docs)).orderBy("chain", "ord").collect()]
    assert got == [("Long Terms", "24.4", ["b", x]) for x in ("i", "ii", "iii")]


def test_mentions_against_plain_search(spark):
    rng = random.Random(3)
    keys = ["red book", "red book part", "book part list", "old red", "list of thing"]
    vocabulary = ["Red", "red", "Book", "Books", "Part", "List", "of", "Things", "old", "Old", "x"]
    texts = [(i, 1, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", ", ". ", " - ", "; "]) for _ in range(60))) for i in range(60)]
    reg = spark.createDataFrame([(1, k, k, True) for k in keys] + [(2, "x red", "n", True), (1, "part list", "n", False)], "project int, key string, node_id string, document boolean")
    got = sorted((r["doc_id"], r["run"], r["start"], r["name"], r["key"]) for r in cite.mentions(spark.createDataFrame(texts, "doc_id long, project int, flat string"), reg).collect())
    fold = lambda w: w.lower()[:-1] if len(w) > 3 and w.endswith("s") else w.lower()
    want = []
    for d, _, text in texts:
        for run, said in enumerate(re.split(r"[.;:]\s", text)):
            words = list(re.finditer(r"[A-Za-z0-9]+", said))
            taken: set[int] = set()
            for n in (3, 2):
                for i in range(len(words) - n + 1):
                    key = " ".join(fold(w.group()) for w in words[i : i + n])
                    if key in keys and words[i].group()[0].isupper() and not taken & set(range(i, i + n)):
                        taken |= set(range(i, i + n))
                        want.append((d, run, i, said[words[i].start() : words[i + n - 1].end()], key))
    assert got == sorted(want) and len(want) > 50
    assert cite.mentions(spark.createDataFrame(texts, "doc_id long, project int, flat string"), reg.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["citations_resolved", "cited_places"])
def test_nodes_met_by_shuffles(spark, monkeypatch, name):
    """However small the planner takes what is made of nodes for, no side of a join on it goes through the driver."""
    from bidloom.operators import citations
    from bidloom.plans import registry

    plans, plain = [], citations.cut
    monkeypatch.setattr(citations, "cut", lambda df, step: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, step))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) > 5 and not any("Broadcast" in x for x in plans)


def test_reading_begins_at_openings():
    """Chains of a text are those of the text without prose that opens none, and such prose is hardly read."""
    said = "Paragraphs 1.1(a) to (b) and 1.2 of Parts A and C of the Blue Terms of Tender please note. The Blue Terms of Tender - (Part A - Fees and Part B) end; Annex A to the Blue Terms of Tender - Part IA - Refunds"
    prose = "Some Words of the Long Name and others, a part of it in parts; the Table is - items. "
    alone = [x[2:] for x in cite._Reader(said).chains()]
    reader, begun = cite._Reader(prose * 500 + said + ". " + prose * 500), []
    name = reader._name
    reader._name = lambda i: begun.append(i) or name(i)
    assert len(alone) == 4 and [x[2:] for x in reader.chains()] == alone
    assert len(begun) < 100


def test_mentions_with_odd_letters(spark):
    """A Kelvin sign is a k in lower case: a window with one folds as a whole."""
    reg = spark.createDataFrame([(1, "blue kook", "n", True), (1, "blue rule book", "m", True)], "project int, key string, node_id string, document boolean")
    texts = spark.createDataFrame([(1, 1, "See Blue Rules Book and Blue \u212aook now"), (2, 1, "Blue Rule Books; blue rule book")], "doc_id long, project int, flat string")
    got = sorted((r["doc_id"], r["name"], r["key"]) for r in cite.mentions(texts, reg).collect())
    assert (1, "Blue Rules Book", "blue rule book") in got and (2, "Blue Rule Books", "blue rule book") in got
