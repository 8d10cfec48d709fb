"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    from bidloom.llm.common import saved

    from .test_operators import WORD, base, linked, statistics

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for name, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, FOLDER), name)
        seen.append(docs.toPandas())
        if name != "packing":
            assert docs.columns == columns
    raw, good, once, clean, mixed, packed = seen
    failed = {d for d, t in zip(raw.doc_id, raw.text) for s in [statistics(t)] if s[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert not failed & set(good.doc_id) and set(good.doc_id) <= set(raw.doc_id)
    groups = linked(list(zip(good.doc_id, good.text)), 5, 80)
    assert set(once.doc_id) == {d for d, (_, r) in groups.items() if d == r}
    texts = dict(zip(clean.doc_id, clean.text))
    for d, t in zip(once.doc_id, once.text):
        spans = sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in base(t))
        for a, b in spans:
            assert t[a:b] not in texts[d] or t.count(t[a:b]) > 1 or len(set(spans)) != len(spans)
        if not spans:
            assert texts[d] == t or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", texts[d])
    size = lambda t: len(WORD.findall(t))
    total = sum(map(size, clean.text))
    assert abs(sum(map(size, mixed.text)) - 1.5 * total) <= 25
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    assert packed.length.sum() > 0 and packed.groupby("sequence_id").length.sum().max() <= 1024
    assert len(packed[packed.piece == 0]) == len(mixed)
    assert not packed.duplicated(["place", "piece"]).any() and packed.place.nunique() == len(mixed)


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, shared ids, clashing columns and an empty table, through all stages."""
    from bidloom.llm.common import saved

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert labels.count()
    text = lambda i, n: " ".join(f"t{i}w{j}" for j in range(n))
    rows = [(1, text(1, 40), "en", "s"), (1, text(1, 40), "en", "s"), (1, text(2, 30), None, None), (None, text(3, 30), "en", "s"), (None, text(4, 30), "en", "t"), (2, None, "en", "s"), (3, "", "en", "s"), (4, text(5, 30_000), "de", "t")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, place string, key int, bucket int")
    for table, left in ((docs, 5), (docs.limit(0), 0)):
        for name, stage in pipeline.STAGES[:-1]:
            columns = table.columns
            table = saved(stage(spark, table, FOLDER), name)
            assert table.columns == columns
            if name == "near_duplicates":
                assert table.count() == left
        # The column place of the documents clashes with that of the training order, which wins.
        pieces = pipeline.packing(spark, table, FOLDER)
        assert pieces.where("piece = 0").count() == table.count()
        assert dict(pieces.dtypes)["place"] == "bigint"


def test_run_on_awkward_rows(spark, tmp_path):
    """run() over a folder: nulls, copies, a shared id and a clashing column, from the files to sequences."""
    text = lambda i, n: " ".join(f"t{i}w{j}" for j in range(n))
    rows = [(1, text(1, 40), "en", "s"), (1, text(1, 40), "en", "s"), (1, text(2, 30), None, None), (None, text(3, 30), "en", "t"), (2, None, "en", "s"), (4, text(5, 3000), "de", "t")]
    spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, place string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id.dropna()) <= {1, 4} and (out.groupby("sequence_id").length.sum() <= 1024).all()
    starts = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset.to_numpy() == g.length.cumsum().shift(fill_value=0).to_numpy()).all() for _, g in starts)
    assert not out.duplicated(["place", "piece"]).any()
