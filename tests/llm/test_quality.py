import random
import re

from trolley.llm import quality as Q


def slow(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    base_failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), base_failed)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows():
    rng = random.Random(8)
    clean = [prose(rng, n) for n in (25, 100, 400, 1500, 6000)]
    part = prose(rng, 30)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "x " * 500), (6, part + "\n" + part + " " + prose(rng, 200)), (6, part + "\n" + part + " " + prose(rng, 200)),
            (7, "# * $ % & | < > " * 9), (8, "é\u00a0ü\u2003x\x0bz\x1cq " * 30), (None, clean[1]), *((20 + i, c) for i, c in enumerate(clean)),
            (30, clean[3] + "\n" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + " " * (i % 40 == 0) for i in range(9000))),
            (31, prose(rng, 5000) + " " + "".join(f"{i % 10} " for i in range(9)) * 3)]


def test_base_counts(spark, docs_of):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality(docs_of(rows())).collect()), key=repr)
    assert got == sorted(((i, *slow(t)) for i, t in rows()), key=repr)


def test_bands_reject_noise_and_keep_prose(spark, docs_of):
    got = {r.doc_id: r for r in Q.quality(docs_of(rows())).collect()}
    assert all(got[20 + i].kept for i in range(5)) and got[None].kept
    assert got[30].method_failed and not got[30].kept
    assert not got[1].kept and got[1].ratio == 0
    one = Q.quality(docs_of([(1, "ab cd ef gh " * 3000)])).first()
    assert one.method_failed


def test_chunks_see_what_the_whole_hides():
    import zstandard
    rng = random.Random(1)
    whole, parts = Q.ratios((prose(rng, 20000) + "z" * 5000 + prose(rng, 20000)).encode(), zstandard.ZstdCompressor(level=3))
    assert whole > 0.05 and min(r for _, r in parts) < 0.05


def test_keep_good_keeps_rows_and_columns(spark, docs_of):
    docs = docs_of(rows())
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    want = [r.doc_id for r in Q.quality(docs).where("kept").collect()]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert Q.quality(docs_of([])).count() == 0 and Q.keep_good(docs_of([])).count() == 0


def test_noise_or_repetition_in_a_short_tail_fails(spark, docs_of):
    rng = random.Random(4)
    body = prose(rng, 2000)[:8192]
    noise = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    tails = {1: noise(2000), 2: noise(1500), 3: "z" * 1900, 4: "z" * 300, 5: prose(rng, 300)[:1500], 6: "end", 7: prose(rng, 40)[:150]}
    got = {r.doc_id: r.method_failed for r in Q.quality(docs_of([(i, body + t) for i, t in tails.items()])).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}
