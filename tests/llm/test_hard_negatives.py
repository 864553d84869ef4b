import math
import random

import numpy as np

from trolley.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, key string, vector string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y", "z") for i, v, l in rows], SCHEMA)


def brute(rows, every=50, positives=5, negatives=3):
    seen, good = set(), []
    for i, v, l in rows:
        if i is None or l is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in seen:
            seen.add(row)
            good.append(row)
    out = []
    for i, l, v in good:
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        same = sorted((-score(w), j) for j, m, w in good if m == l and j != i)[:positives]
        for s, j in same:
            far = sorted((-score(w), k) for k, m, w in good if m != l and -50 * s <= 100 * score(w) <= -95 * s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(far[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **settings):
    t = H.prepared(table(spark, rows))
    return sorted(map(tuple, H.mine(t, t.where("vec_id % 50 = 0"), **settings).collect()))


def clustered(rng, n, dims, labels):
    centres = rng.normal(size=(labels, dims))
    return [(i, (centres[i % labels] + 0.9 * rng.normal(size=dims)).tolist(), int(i % labels)) for i in range(n)]


def test_equals_brute_force_in_any_dealing(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 900, 24, 3)
    rows = [(i, v, 0 if rng.random() < 0.3 else l) for i, v, l in rows]     # one label holds half of all rows
    want = brute(rows)
    assert len(want) > 50
    for settings in ({}, {"rows_per_block": 100, "anchors_per_group": 5}, {"rows_per_block": 10_000, "anchors_per_group": 1}):
        assert mined(spark, rows, **settings) == want


def test_ties_nulls_and_odd_rows(spark):
    v = [1.0, -0.5, 0.25]
    rows = [(50 * i, v, 1) for i in range(4)] + [(i, [0.8 * x for x in v], 2) for i in range(1, 40)]     # ties everywhere
    rows += [(50, v, 1), (3, [0.8 * x for x in v], 2)]                          # repeated rows count once
    rows += [(None, v, 1), (900, None, 1), (901, v, None), (902, [1.0, None, 1.0], 2), (903, [1.0, math.inf, 0.0], 2),
             (904, [math.nan] * 3, 2), (950, [], 1), (951, [-1.0, 0.5, -0.25], 1), (952, [0.0, 0.0, 0.0], 1)]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert [r[3] for r in want if r[:2] == (0, 50)] == [1, 2, 3]
    assert mined(spark, []) == [] == mined(spark, [(1, v, 1), (2, v, 2)])       # no rows, no anchors
    assert mined(spark, [(0, v, 1), (2, v, 2)]) == []                           # no positives


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2 ** 20, 2 ** 20)) for _ in range(8)], i // 10 % 2) for i in range(0, 1000, 10)]
    rows.append((5, [1e30] * 8, 0))      # its scores could pass 63 bits: takes no part
    assert mined(spark, rows) == brute(rows[:-1]) != []


def test_scan_prunes_and_stays_exact():
    rng = np.random.default_rng(8)
    n, dims = 4000, 64
    weight = 0.9 ** np.arange(dims)
    vectors = np.floor(256 * rng.normal(size=(n, dims)) * weight)
    labels = np.arange(n) % 2
    block = H.Block(np.arange(n), labels, np.arange(n), list(vectors), dims)
    read = []
    plain = H.Block.scan

    def counting(self, anchor, rows, prune):
        def seen(rows, *rest):
            stays = prune(rows, *rest)
            read.append((len(rows), int(stays.sum())))
            return stays
        return plain(self, anchor, rows, seen)

    H.Block.scan = counting
    try:
        rows, scores = H.positives_in(block, vectors[7], 7, 1, 5)
        exact = vectors @ vectors[7]
        order = sorted((-exact[i], i) for i in range(1, n, 2) if i != 7)[:5]
        assert [(-s, r) for r, s in zip(rows.tolist(), scores.tolist())] == order
        low, high = int(scores[0]) // 2, int(scores[0]) * 95 // 100
        (rows, scores), (none, _) = H.negatives_in(block, vectors[7], 1, [(low, high), (5, 4)], 3)
        order = sorted((-exact[i], i) for i in range(0, n, 2) if low <= exact[i] <= high)[:3]
        assert [(-s, r) for r, s in zip(rows.tolist(), scores.tolist())] == order and len(none) == 0
    finally:
        H.Block.scan = plain
    assert read[0][0] > 1900 and min(b for _, b in read) < 400     # the bitmap shrinks before all columns are read
