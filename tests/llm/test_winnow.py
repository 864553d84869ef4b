import hashlib
import random

import pytest

from trolley.llm import winnow as W
from trolley.llm.queries import op13_winnow

SMOKE = "/root/testdata/sf0.001"


def slow_winnow(text, gram=W.GRAM, window=W.WINDOW):
    """Window by window, with each gram hashed by itself."""
    import numpy as np
    if not text:
        return []
    gram = min(gram, len(text))
    codes = np.array([ord(c) for c in text], np.uint32)
    h = [int(W.gram_hashes(codes[i:i + gram], gram)[0]) for i in range(len(text) - gram + 1)]
    kept = set()
    for i in range(max(1, len(h) - window + 1)):
        part = h[i:i + window]
        kept.add(max(i + j for j, x in enumerate(part) if x == min(part)))
    return [(h[p], p) for p in sorted(kept)]


def pairs(text, **settings):
    h, p = W.winnow(text, **settings)
    return list(zip(h.tolist(), p.tolist()))


def test_winnowing_equals_its_definition(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "ab" * 8, "x" * 15, "x" * 16, "x" * 17, "x" * 79, "x" * 300, "é\U0001f600\u0000b" * 40]
    texts += ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 500))) for _ in range(40)]
    for piece in (1 << 16, 50):
        monkeypatch.setattr(W, "PIECE", piece)
        for t in texts:
            assert pairs(t) == slow_winnow(t)
            assert pairs(t, gram=3, window=5) == slow_winnow(t, 3, 5)
    assert pairs("x" * 300)[0][1] == W.WINDOW - 1      # rightmost of equal hashes


def test_shared_passages_share_a_hash_at_the_same_place():
    rng = random.Random(6)
    letters = "abcdefghij "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(100):
        common = make(W.GRAM + W.WINDOW - 1)
        a, b = make(rng.randint(0, 300)), make(rng.randint(0, 300))
        first = {(h, p - len(a)) for h, p in pairs(a + common + make(50))}
        second = {(h, p - len(b)) for h, p in pairs(b + common + make(50))}
        assert any(0 <= p <= W.WINDOW - 1 for _, p in first & second)
    long = make(60_000)
    assert len(pairs(long)) < 2.3 / (W.WINDOW + 1) * len(long)


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_rows(rows):
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        a, e, n = slow_winnow(text), slow_winnow(edited), slow_winnow(after)
        shown = lambda x: ",".join(f"{h:x}@{p}" for h, p in x)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(e), jaccard(a, e), jaccard(a, n)))
    return out


def listed(df):
    return [tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", W.as_text("hashes", "positions"),
                                        W.as_text("edited_hashes", "edited_positions"), "near_edited", "near_next").collect()]


@pytest.mark.parametrize("per_range", [3, 20_000])
def test_documents(spark, docs_of, per_range):
    rng = random.Random(2)
    rows = [(i * 3 - 40, "".join(rng.choice("ab cé") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, rows[3][1]), (503, rows[3][1]), (2 ** 60, "the last one of all texts")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = listed(W.with_next(docs_of(shuffled).repartition(5), rows_per_range=per_range))
    assert sorted(got) == slow_rows(rows)
    same = {r[0]: r[3] for r in got}
    assert same[502] == same[503] == slow_rows(rows)[3][3]


def test_repeated_and_missing_ids(spark, docs_of):
    text = "some text that is long enough to have more than one gram in it, and a little more"
    for per_range in (8, 1000):
        copies = [(7, text)] * 40 + [(9, "another text")]      # an id that holds most rows
        got = sorted(listed(W.with_next(docs_of(copies), rows_per_range=per_range)))
        want = sorted(slow_rows(copies))
        assert got == want
        missing = [(5, text), (None, text), (None, text), (None, text)]     # rows without an id come last
        assert sorted(listed(W.with_next(docs_of(missing), rows_per_range=per_range)), key=repr) == sorted(slow_rows(missing), key=repr)
        several = [(1, "a" * 30), (1, "b" * 30), (1, "c" * 30), (2, "d" * 30)]
        chain = W.with_next(docs_of(several), rows_per_range=per_range).collect()
        assert sorted(r.doc_id for r in chain) == [1, 1, 1, 2]
        ends = {hashlib.sha256((c * 23 + d * 7).encode()).hexdigest(): c + d for c in "abcd" for d in "abcd"}
        ring = {x[0]: x[1] for x in (ends[r.edited_sha256] for r in chain)}      # each text is the next of one other
        at, seen = "d", []
        for _ in range(4):
            at = ring[at]
            seen.append(at)
        assert sorted(seen) == list("abcd") and seen[-1] == "d"
    assert listed(W.with_next(docs_of([(3, text)]))) == slow_rows([(3, text)])      # alone it is its own next
    assert W.with_next(docs_of([])).count() == 0 == W.fingerprints(docs_of([])).count()


def test_fingerprints(spark, docs_of):
    rows = [(1, "abc " * 60), (1, "abc " * 60), (2, None), (None, "")]
    got = W.fingerprints(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, list(zip(r.hashes, r.positions))) for r in got), key=repr) == \
        sorted(((i, len(t or ""), slow_winnow(t)) for i, t in rows), key=repr)


def test_query(spark):
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect())
    short = [i for i, (_, t) in enumerate(docs[:-1]) if len(t) < 1200]
    got = {r.doc_id: tuple(r) for r in op13_winnow(spark, SMOKE).collect()}
    assert len(got) == len(docs)
    for i in short[:20]:
        assert got[docs[i][0]] == slow_rows(docs[i:i + 2])[0]
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got.values())
