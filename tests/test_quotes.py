"""Quotes on texts: few go to the texts, more meet them by hashes of runs; both find the same."""

from __future__ import annotations

import random

from bidloom.operators import documents as docs


def test_few_and_many_quotes(spark, monkeypatch):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choices(["a", "B", "c.", "May", "d-e"], k=n))
    texts = spark.createDataFrame([(i, say(rng.randrange(0, 30)) if i else None) for i in range(60)] + [(None, "a b c"), (5, "a")], "doc_id long, text string")
    quotes = spark.createDataFrame([(i, say(rng.randrange(0, 9))) for i in range(40)], "item_id int, quote string")
    few = docs.quotes_on_texts(quotes, texts)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "explode" not in plan
    monkeypatch.setattr(docs, "FEW_QUOTES", 0)
    many = docs.quotes_on_texts(quotes, texts)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 40
