"""Neighbour-table goldens (4 users x 5 items, k = 2) and kernel checks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.functions.blockdot import topk_per_owner
from trolley.operators import similarity as K

F1 = {0: [0, 1, 2, 4], 1: [1, 3], 2: [1, 2, 4], 3: [3]}
F1_BUILD = {0: {2: 0.8660254, 1: 0.35355339}, 1: {3: 0.70710678, 2: 0.40824829},
            2: {0: 0.8660254, 1: 0.40824829}, 3: {1: 0.70710678}}


def interactions(spark, rows):
    return spark.createDataFrame([(u, i, 1.0) for u, items in rows.items() for i in items],
                                 "user_id long, item_id long, value double")


def as_lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["user_id"], {})[r["neighbor_id"]] = r["similarity"]
    return out


def assert_lists(got, want):
    assert set(got) == set(want)
    for u in want:
        assert set(got[u]) == set(want[u]), u
        for v, s in want[u].items():
            assert got[u][v] == pytest.approx(s, abs=1e-4)


@pytest.mark.parametrize("blocks,hot", [(1, None), (2, None), (3, None), (5, None), (2, 2), (1, 0)])
def test_build_golden(spark, blocks, hot):
    n = K.build_neighbors(interactions(spark, F1), k=2, num_blocks=blocks, hot_threshold=hot)
    assert_lists(as_lists(n), F1_BUILD)


def test_asymmetric_matches_build(spark):
    I = interactions(spark, F1)
    left = I.where("user_id in (0, 3)")
    n = K.neighbors_for(left, I, k=2, left_blocks=1, right_blocks=3)
    assert_lists(as_lists(n), {0: F1_BUILD[0], 3: F1_BUILD[3]})


def test_topk_total_order():
    owner = np.array([1, 1, 1, 1, 2])
    other = np.array([9, 3, 5, 4, 1])
    sim = np.array([0.5, 0.5, 0.9, 0.5, 0.1])
    sel = topk_per_owner(owner, other, sim, 2)
    got = sorted(zip(owner[sel].tolist(), other[sel].tolist()))
    assert got == [(1, 3), (1, 5), (2, 1)]


def test_random_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = {u: sorted(set(rng.integers(0, 30, rng.integers(1, 8)).tolist())) for u in range(60)}
    k = 4
    X = np.zeros((60, 30))
    for u, items in rows.items():
        X[u, items] = 1.0
    dots = X @ X.T
    nrm = np.sqrt(np.diag(dots))
    want = {}
    for u in range(60):
        cand = [(-(dots[u, v] / (nrm[u] * nrm[v])), v) for v in range(60) if v != u and dots[u, v] > 0]
        cand.sort()
        if cand:
            want[u] = {v: -s for s, v in cand[:k]}
    for blocks, hot in ((1, None), (4, None), (3, 5), (2, 0)):
        got = as_lists(K.build_neighbors(interactions(spark, rows), k=k, num_blocks=blocks, hot_threshold=hot))
        assert_lists(got, want)


@pytest.mark.parametrize("cells,expansion", [(1 << 22, 1 << 23), (7, 3), (50, 1)])
def test_kernel_chunking_matches_brute_force(monkeypatch, cells, expansion):
    from trolley.functions import blockdot as BD
    monkeypatch.setattr(BD, "MAX_CELLS", cells)
    monkeypatch.setattr(BD, "MAX_EXPANSION", expansion)
    rng = np.random.default_rng(11)
    rows = [(u, i) for u in range(30) for i in sorted(set(rng.integers(0, 12, rng.integers(1, 9)).tolist()))]
    u = np.array([r[0] for r in rows], dtype=np.int64)
    i = np.array([r[1] for r in rows], dtype=np.int64)
    x = np.ones(len(rows))
    a, b = u < 15, u >= 15
    left, right = BD._Side(u[a], i[a], x[a]), BD._Side(u[b], i[b], x[b])
    (lo_o, lo_n, lo_s), (ro_o, ro_n, ro_s) = BD.block_scores(left, right, 3, right_topk=True)
    X = np.zeros((30, 12))
    X[u, i] = 1.0
    nrm = np.sqrt((X * X).sum(1))

    def want(owners, others):
        out = {}
        for o in owners:
            c = sorted((-(X[o] @ X[v]) / (nrm[o] * nrm[v]), v) for v in others if X[o] @ X[v] > 0)
            out.update({(o, v): -s for s, v in c[:3]})
        return out
    got_l = {(int(o), int(n)): s for o, n, s in zip(lo_o, lo_n, lo_s)}
    got_r = {(int(o), int(n)): s for o, n, s in zip(ro_o, ro_n, ro_s)}
    assert got_l.keys() == want(range(15), range(15, 30)).keys()
    assert got_r.keys() == want(range(15, 30), range(15)).keys()
    for (o, n), s in {**want(range(15), range(15, 30)), **want(range(15, 30), range(15))}.items():
        assert (got_l.get((o, n)) or got_r.get((o, n))) == pytest.approx(s, abs=1e-12)


def weighted(spark, rng, users=40, hot=0):
    rows = {(u, int(i)): float(rng.integers(1, 4)) for u in range(users) for i in rng.choice(60, 8, replace=False)}
    rows |= {(1000 + h, i): 1.0 for h in range(hot) for i in range(0, 60, 1 + h)}       # users that hold most items
    return rows, spark.createDataFrame([(u, i, x) for (u, i), x in rows.items()], "user_id long, item_id long, value double")


def brute_lists(rows, measure, left, right, k):
    import math
    vec = {}
    for (u, i), x in rows.items():
        vec.setdefault(u, {})[i] = x
    mass = {u: sum(x * x for x in v.values()) for u, v in vec.items()}
    out = set()
    for u in left:
        found = []
        for v in right:
            dot = sum(x * vec[v].get(i, 0) for i, x in vec[u].items()) if u != v else 0
            if dot > 0:
                sim = dot / (math.sqrt(mass[u]) * math.sqrt(mass[v])) if measure == "cosine" else dot / (mass[u] + mass[v] - dot)
                found.append((-sim, v))
        out |= {(u, v, round(-s, 12)) for s, v in sorted(found)[:k]}
    return out


def test_measures_and_hot_rows_equal_brute_force(spark):
    import numpy as np

    from trolley.functions.measures import COSINE, TANIMOTO
    from trolley.operators import similarity as K
    rows, I = weighted(spark, np.random.default_rng(5), hot=2)
    users = sorted({u for u, _ in rows})
    left_users, right_users = users[:15] + [1000], users[10:]
    left = I.where(I.user_id.isin(left_users))
    right = I.where(I.user_id.isin(right_users))
    listed = lambda df: {(r.user_id, r.neighbor_id, round(r.similarity, 12)) for r in df.collect()}
    for m in (COSINE, TANIMOTO):
        for hot in (10_000, 20):      # all users in blocks, or the hot ones by joins
            assert listed(K.build_neighbors(I, 6, num_blocks=3, hot_threshold=hot, measure=m)) == brute_lists(rows, m.name, users, users, 6)
            got = K.neighbors_for(left, right, 6, left_blocks=2, right_blocks=2, hot_threshold=hot, measure=m)
            assert listed(got) == brute_lists(rows, m.name, left_users, right_users, 6)
    assert COSINE.less(10.0, 3.0) == 1.0


def test_forget_with_another_measure_equals_a_rebuild(spark):
    from tests.conftest import SF_SMALL
    from trolley.functions.measures import TANIMOTO
    from trolley.operators import unlearn as U
    from trolley.plans.state import build_state
    from trolley.sources.purchases import load_purchases
    p = load_purchases(spark, SF_SMALL)
    res = U.forget(build_state(p, k=5, measure=TANIMOTO), U.most_bought_item_deletions(p))
    want = build_state(res.state.purchases, k=5, measure=TANIMOTO)
    cols = ["user_id", "neighbor_id", "similarity", "rank"]
    got, full = res.state.neighbors.select(*cols), want.neighbors.select(*cols)
    assert got.exceptAll(full).count() == 0 == full.exceptAll(got).count()


def test_entries_go_only_to_blocks_that_hold_their_item(spark):
    """60 users in 30 pairs, each pair with its own items: 32 blocks must not copy the input 32 times."""
    rows = {u: [10 * (u // 2) + i for i in range(5)] for u in range(60)}
    I = interactions(spark, rows)
    routed, groups = K.routed_rows(I, I, 32)
    sent = routed.selectExpr("sum(size(r_users)) as r", "sum(size(l_users)) as l", "max(gid) as top").first()
    assert groups == 32 and sent["top"] < 32
    assert sent["r"] <= 2 * 300 and sent["l"] == 300
    assert_lists(as_lists(K.build_neighbors(I, 3, num_blocks=32)), {u: {u ^ 1: 1.0} for u in range(60)})


def test_routing_follows_the_item_counts(spark):
    light = spark.sql("select id as item_id, 30L as l, 30L as r from range(1000)")
    assert K.choose_routing(light, 8) == (8, 1)
    heavy = spark.sql("select id as item_id, 3000000L as l, 3000000L as r from range(10)")
    blocks, parts = K.choose_routing(heavy, 8)
    assert blocks == 8 and parts == 15      # blocks would copy it; the right side is split instead


def test_popular_item_in_parts_and_chunks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_ENTRIES", 3)
    monkeypatch.setattr(K, "GROUP_ENTRIES", 40)
    rows, I = weighted(spark, np.random.default_rng(3), users=50)
    rows |= {(u, 99): 2.0 for u in range(50)}
    I = spark.createDataFrame([(u, i, x) for (u, i), x in rows.items()], "user_id long, item_id long, value double")
    from trolley.functions.measures import COSINE
    got = {(r.user_id, r.neighbor_id, round(r.similarity, 12)) for r in K.build_neighbors(I, 6, num_blocks=2).collect()}
    assert got == brute_lists(rows, COSINE.name, range(50), range(50), 6)


def test_null_ids_count_as_one_id_of_their_own(spark):
    I = spark.createDataFrame([(1, None, 1.0), (2, None, 1.0), (None, 5, 1.0), (3, 5, 1.0)],
                              "user_id long, item_id long, value double")
    assert_lists(as_lists(K.build_neighbors(I, 3)), {1: {2: 1.0}, 2: {1: 1.0}, 3: {K.NULL_KEY: 1.0}, K.NULL_KEY: {3: 1.0}})


def test_entries_travel_packed(spark):
    """The rows of a group cross the network as a few bytes an entry and come back as they were."""
    import pyarrow as pa
    import pyarrow.compute

    from trolley.functions import blockdot as B
    rng = np.random.default_rng(2)
    users = [np.sort(rng.choice(600_000, 30, replace=False)) for _ in range(600)]
    users[5] = np.array([K.NULL_KEY, 3, (1 << 63) - 1])
    column = lambda s, rows: {f"{s}_users": rows, f"{s}_values": [[1.0] * len(r) for r in rows],
                              f"{s}_masses": [[float(x % 97) for x in r] for r in rows]}
    table = pa.table({"gid": pa.array(rng.integers(0, 3, 600), pa.int32()), **column("l", [r[:1].tolist() for r in users]),
                      **column("r", [r.tolist() for r in users])})
    packed = pa.Table.from_batches(list(B.pack_task(entries=7_000)(table.to_batches(max_chunksize=100))))
    assert packed.num_rows == 6      # two flushes of three groups
    assert sum(len(x) for x in packed.column("data").to_pylist()) < 6 * (18_000 + 600)
    for gid in range(3):
        rows = table.filter(pa.compute.equal(table["gid"], gid))
        pieces = [tuple(B._unpacked(r)) for r in packed.to_pylist() if r["gid"] == gid]
        for i, s in enumerate("lr"):
            sizes, *entries = (np.concatenate(x) for x in zip(*(p[i] for p in pieces)))
            assert sizes.tolist() == [len(x) for x in rows[f"{s}_users"].to_pylist()]
            for got, c in zip(entries, ("users", "values", "masses")):
                assert got.tolist() == [v for x in rows[f"{s}_{c}"].to_pylist() for v in x]


def test_lists_of_one_part_are_not_dealt_again(spark):
    rows, I = weighted(spark, np.random.default_rng(8))
    lists = K.build_neighbors(I, 4, num_blocks=5)
    assert "Window" not in lists._jdf.queryExecution().executedPlan().toString()
    from trolley.functions.measures import COSINE
    assert {(r.user_id, r.neighbor_id, round(r.similarity, 12)) for r in lists.collect()} == brute_lists(rows, COSINE.name, range(40), range(40), 4)
    ranks = {}
    for r in lists.orderBy("user_id", F.desc("similarity"), "neighbor_id").collect():
        ranks.setdefault(r.user_id, []).append(r["rank"])
    assert all(x == list(range(1, len(x) + 1)) for x in ranks.values())


@pytest.mark.parametrize("chunk,group,lot", [(4_096, 2_000_000, 16_384), (3, 40, 4)])
def test_blocks_in_waves_equal_brute_force(spark, monkeypatch, chunk, group, lot):
    """Routed entries of many times the input go a wave at a time; its shelves and shuffles are gone after."""
    import os

    from trolley import session
    monkeypatch.setattr(K, "CHUNK_ENTRIES", chunk)
    monkeypatch.setattr(K, "GROUP_ENTRIES", group)
    monkeypatch.setattr(K, "LOT_ENTRIES", lot)
    whole, waves = K._routing, 3
    monkeypatch.setattr(K, "_routing", lambda *a: (*whole(*a)[:2], waves))
    rows, _ = weighted(spark, np.random.default_rng(4), users=50)
    rows |= {(u, 99): 2.0 for u in range(50)}
    I = session.materialize(spark.createDataFrame([(u, i, x) for (u, i), x in rows.items()], "user_id long, item_id long, value double"))
    tables = os.path.dirname(session._written[I].removeprefix("file:"))
    before = set(os.listdir(tables))
    lists = K.build_neighbors(I, 6, num_blocks=5)
    assert len(set(os.listdir(tables)) - before) == 1 and "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    assert session.materialize(lists) is lists
    from trolley.functions.measures import COSINE
    assert {(r.user_id, r.neighbor_id, round(r.similarity, 12)) for r in lists.collect()} == brute_lists(rows, COSINE.name, range(50), range(50), 6)
    left = I.where("user_id < 20")
    got = {(r.user_id, r.neighbor_id, round(r.similarity, 12)) for r in K.neighbors_for(left, I, 6, left_blocks=4, right_blocks=2).collect()}
    assert got == brute_lists(rows, COSINE.name, range(20), range(50), 6)


def test_waves_follow_the_routed_entries(spark):
    """30 buyers an item in many blocks route 28 times the entries; a wave takes at most four times as many."""
    counts = spark.sql("select id as item_id, 30L as l, 30L as r from range(4000000)")
    blocks, parts, waves = K._routing(counts, 8, None)
    assert parts == 1 and 120_000_000 * 4 * waves >= 30 * 120_000_000 and 1 < waves <= blocks
    assert K._routing(spark.sql("select id as item_id, 30L as l, 30L as r from range(1000)"), 8, None)[2] == 1


def test_shelves_are_written_in_ranges_of_items(spark, monkeypatch):
    """Each range of the items is dealt and written on its own, so its shuffles alone are on disk at once."""
    from trolley.functions.measures import COSINE
    whole, ranges = K._routing, []
    monkeypatch.setattr(K, "_routing", lambda *a: (*whole(*a)[:2], 2))
    sides = K._routed._sides

    def dealt(self, left, right):
        ranges.append([{r.item_id for r in side.select("item_id").distinct().collect()} for side in (left, right)])
        return sides(self, left, right)
    monkeypatch.setattr(K._routed, "_sides", dealt)
    rows, _ = weighted(spark, np.random.default_rng(6), users=40)
    I = spark.createDataFrame([(u, i, x) for (u, i), x in rows.items()], "user_id long, item_id long, value double")
    got = {(r.user_id, r.neighbor_id, round(r.similarity, 12)) for r in K.build_neighbors(I, 5, num_blocks=4).collect()}
    assert got == brute_lists(rows, COSINE.name, range(40), range(40), 5)
    items = {i for _, i in rows}
    assert len(ranges) == K.SHELF_PASSES and all(left == right for left, right in ranges)
    assert set().union(*(x for x, _ in ranges)) == items and sum(len(x) for x, _ in ranges) == len(items)
    assert max(len(x) for x, _ in ranges) < len(items)
