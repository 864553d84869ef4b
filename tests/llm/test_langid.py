import zlib

import pytest

from trolley.llm import langid as G


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, docs):
    rows = G.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 150
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_are_not_learned_from(spark, docs):
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'xx', lang) as lang")
    assert set(G.fit(other.where(~G.held_out())).languages) == {"de", "en", "es", "fr"}


def test_edges(spark, docs_of):
    model = G.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(~G.held_out()))
    long = "the thing and that " * 120_000
    rows = [(1, None), (2, ""), (3, "12 %$ ..."), (4, "the and that with the thing"), (4, "the and that with the thing"), (None, "x"), (5, long)]
    got = {}
    for r in G.predict(docs_of(rows), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [got[i][0].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1][0].score == 0
    assert [r.lang_pred for r in got[4]] == ["en", "en"] and got[5][0].lang_pred == "en"
    assert not got[None][0].held_out and got[None][0].lang_pred in model.languages
    none = G.fit(docs_of([]))
    assert [r.lang_pred for r in G.predict(docs_of(rows[:4]), none).collect()] == ["und"] * 4


def test_filter_returns_the_languages_of_each_gram():
    import numpy as np
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**63, 5000).astype(np.uint64)
    masks = rng.integers(1, 8, 5000).astype(np.uint64)
    model = G.build(["a", "b", "c"], grams, masks)
    assert ((model.masks(grams) & masks) == masks).all()
    unknown = model.masks(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    for k in range(3):
        rate = ((unknown >> np.uint64(k)) & np.uint64(1)).mean()
        assert abs(rate - model.chance[k]) < 0.01
