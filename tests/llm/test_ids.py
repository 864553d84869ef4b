"""Ids beside a null and ids over 2^53 come back unchanged from every operator with Python tasks."""

import pytest

from trolley.llm import (html_extract, langid, periodic, quality, sentencepiece_bpe, simhash, urlfilter, winnow)
from trolley.llm.queries import piece_model

BIG = 2 ** 53
IDS = [None, BIG + 1, BIG + 3, -BIG - 1]
TEXT = "the quick brown fox jumps over the lazy dog while many other words of a plain text follow it here and there today"


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{TEXT} number{n} is a different one{n}", "en", "s", None if i is None else i) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


WANT = sorted(IDS, key=repr)


def test_documents(spark, docs):
    assert ids(quality.quality(docs)) == WANT
    kept = quality.keep_good(docs)
    assert ids(kept) == WANT == ids(kept, "n_chars") and kept.schema == docs.schema
    near = simhash.near_duplicates(docs)
    assert ids(near) == WANT
    assert {r.doc_id for r in near.where("doc_id = component_id").collect()} <= set(IDS)
    assert ids(sentencepiece_bpe.encode_decode(docs, piece_model())) == WANT
    assert ids(sentencepiece_bpe.encode_ids(docs, piece_model())) == WANT
    assert ids(langid.predict(docs, langid.fit(docs))) == WANT
    assert ids(periodic.detect(docs)) == WANT
    assert ids(winnow.fingerprints(docs)) == WANT
    assert ids(winnow.with_next(docs)) == WANT


def test_pages(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/p/{n}", f"<article><p>text {n}</p></article>") for n, i in enumerate(IDS)],
                                  "page_id long, url string, html string").coalesce(1)
    assert ids(urlfilter.judge(pages), "page_id") == WANT
    assert ids(html_extract.extract(pages), "page_id") == WANT
