import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trolley.llm import simhash as S


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_documents(spark, docs_of):
    rng = random.Random(4)
    base = [f"word{rng.randint(0, 200)}" for _ in range(400)]
    rows = [(50 - i, " ".join(base[:i * 9] + ["New"] + base[i * 9 + 1:])) for i in range(30)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "One"), (104, "one"), (105, "É a"), (106, "é a"), (100, None), (None, "one")]
    got = S.near_duplicates(docs_of(rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = brute(fps)
    lowest = {r: min(i for (i, _), q in zip(rows, roots) if q == r and i is not None) for r in set(roots)}
    want = sorted(((i, f"{f:016x}", lowest[r]) for (i, _), f, r in zip(rows, fps, roots)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    kept = S.keep_one(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*set(lowest.values()), *([100] if 100 in lowest.values() else [])])
    assert S.near_duplicates(docs_of([])).count() == 0


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(150)}
    dense = rng.getrandbits(64)
    for _ in range(250):   # a dense ball: many members of one cell
        f = dense
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randint(0, 63)
        fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = brute(fps)
    for block in (2048, 16):
        links = S.links(frame, block=block)
        assert links.where("bit_count(u ^ v) > 3").count() == 0
        found = {r.node: r.root for r in S.components(links).collect()}
        mine = [found.get(x, x) for x in signed]
        assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 4000).astype(np.uint64) for _ in range(2))
    low = S.manhattan(S.segment_counts(a), S.segment_counts(b))
    slow = [sum(abs(bin(int(x) >> s & 3).count("1") - bin(int(y) >> s & 3).count("1")) for s in range(0, 64, 2)) for x, y in zip(a[:200], b[:200])]
    assert (low <= np.bitwise_count(a ^ b)).all() and low[:200].tolist() == slow


def test_components_of_a_chain_and_a_hub(spark):
    from trolley.llm.components import components
    chain = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}}
    assert components(spark.createDataFrame([], "u long, v long")).agg(F.count("*")).first()[0] == 0
