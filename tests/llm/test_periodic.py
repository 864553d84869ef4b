import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trolley.llm import periodic as P
from trolley.llm.queries import op11_periodic

SMOKE = "/root/testdata/sf0.001"


def slow_runs(w):
    """Every maximal stretch of every period, then the smallest period of each by trying all."""
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                run = w[i:j + q]
                if all(any(run[x] != run[x + p] for x in range(len(run) - p)) for p in range(1, q)):
                    out.add((i, len(run), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text, planted=True):
    w = [x for x in (text or "").encode().split()]
    n = len(w)
    if planted and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    if runs:
        s, length, q = max(runs, key=lambda r: (r[1] * 10 ** 9 // r[2], -r[0], -r[2]))
        best = (s, length, q, 1000 * length // q)
    digest = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, n, len(runs), *best, hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts(rng):
    word = lambda k: [f"w{rng.randint(0, k)}" for _ in range(rng.randint(1, 12))]
    for case in range(400):
        out = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                phrase = word(rng.choice((1, 2, 5, 50)))
                out += (phrase * rng.randint(2, 12))[:rng.randint(1, 90)]
            else:
                out += [f"w{rng.randint(0, rng.choice((1, 3, 30)))}" for _ in range(rng.randint(0, 40))]
        yield out


def test_runs_equal_brute_force():
    for w in texts(random.Random(3)):
        assert P.find_runs(w) == slow_runs(w), w


def test_runs_in_runs():
    inner = ["a"] * 24 + list("bcdefgh") + ["x", "y"] * 13
    w = inner * 4 + ["q"] + inner[:40]
    assert P.find_runs(w) == slow_runs(w) and len({q for _, _, q in P.find_runs(w)}) == 3
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    assert P.find_runs(fib[1]) == slow_runs(fib[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_few_words(w):
    assert P.find_runs(w) == slow_runs(w)


def slow_survivors(ids, lo, hi):
    if hi - lo < 24:
        return []
    count = {w: ids[lo:hi].count(w) for w in ids[lo:hi]}
    edges = [lo - 1, *(i for i in range(lo, hi) if count[ids[i]] < 3), hi]
    if len(edges) == 2:
        return [(lo, hi)]
    return [x for a, b in zip(edges, edges[1:]) for x in slow_survivors(ids, a + 1, b)]


def test_splitting_is_stable_and_loses_no_run():
    rng = random.Random(5)
    for case in range(200):
        ids = [rng.randint(0, rng.choice((4, 12, 25))) for _ in range(rng.randint(0, 300))]
        got = P.survivors(ids)
        assert got == slow_survivors(ids, 0, len(ids))
    peel = [x for i in range(20_000) for x in (i, i - 1, i - 2)]     # every cut makes the next word rare
    assert P.survivors(peel) == slow_survivors(peel[:600], 0, 600) == []


def test_very_long_texts():
    same = P.find_runs(["a"] * 200_000)
    assert same == [(0, 200_000, 1)]
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 50, 30_000).tolist()
    assert (0, 120_000, 30_000) in P.find_runs(phrase * 4)
    assert P.find_runs(rng.integers(0, 500, 200_000).tolist()) == []


def test_documents(spark, docs_of):
    loop = " ".join(["one", "two", "three"] * 12)
    rows = [(i, f"start {i} " + " ".join(f"w{j % (i + 3)}" for j in range(60))) for i in range(120)]
    rows += [(500, loop), (500, loop), (501, None), (502, ""), (503, " \n\t"), (None, loop), (None, None),
             (504, "É\x0bé " * 30), (505, "a b " * 40)]
    got = P.report(P.detect(P.plant(docs_of(rows)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((slow_row(*r) for r in rows), key=repr)
    plain = {r.doc_id: r for r in P.detect(docs_of([(500, "x " + loop + " end"), (7, None)])).collect()}
    assert [tuple(x) for x in plain[500].runs] == [(1, 36, 3)] and plain[500].collapsed == "x one two three end"
    assert plain[7].runs == [] and plain[7].collapsed == "" and plain[7].n_words == 0
    assert P.report(P.detect(P.plant(docs_of([])))).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op11_periodic(spark, SMOKE).collect()))
    small = {d.doc_id for d in docs if len(d.text or "") < 6000}     # the brute force is cubic
    assert len(got) == len(docs) and len(small) > 150
    assert [r for r in got if r[0] in small] == sorted(slow_row(d.doc_id, d.text) for d in docs if d.doc_id in small)
    assert sum(r[2] > 0 for r in got) >= 10
