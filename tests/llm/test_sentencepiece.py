import hashlib

import pytest

from trolley.llm import sentencepiece_bpe as B
from trolley.llm.queries import piece_model

ODD = [None, "", " ", "  a  b ", "a\tb\r\nc", "é ﬁ ½ Ⅳ e\u0301", "a▁b", "▁▁ ▁", "\u200bx", "日本 한국 नमस्ते", "</s> <s> <0x41>", "\x00a",
       "😀😀 x", "a" * 3000, " " * 70, "the " * 400, "don't stop… “quoted”, (yes) 12,5 %", "Ünïcödé wörds", "a_b __c__ 1_000"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_equals_the_library(spark, docs_of, library):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (None, "x")]
    got = sorted((tuple(r) for r in B.encode_decode(docs_of(rows), piece_model()).drop("decoded").collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    assert got == sorted(want, key=repr)


def test_whole_documents_equal_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.ids for r in B.encode_ids(docs, piece_model()).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == library.encode(r.text, add_eos=True)


def test_memo_generations_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(B, "MEMO_ENTRIES", 3)
    v = B.Vocabulary(piece_model())
    text = "one two three four five, one two three four five. seven one"
    assert v.encode(text, {}) == v.encode(text, {}) == library.encode(text, add_eos=True)


def test_a_wrong_merge_is_told(library):
    v = B.Vocabulary(piece_model())
    fresh = {}
    v.encode("hello world", fresh)
    assert not v.wrong(fresh)
    fresh["▁world"] = [5]
    assert v.wrong(fresh) == {"▁world"}


def test_empty_table(spark, docs_of):
    assert B.encode_decode(docs_of([]), piece_model()).count() == 0
