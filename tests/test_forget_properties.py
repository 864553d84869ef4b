"""Forgetting on small fixtures against brute force: random deletion sequences and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_similarity import as_lists
from trolley.operators import embeddings as EM
from trolley.operators import similarity as K
from trolley.operators import unlearn as U
from trolley.plans.state import build_state
from trolley.sources.purchases import purchases_from_frames


def random_rows(seed, users=40, items=25):
    rng = np.random.default_rng(seed)
    return sorted({(int(u), int(i)) for u in range(users)
                   for i in rng.choice(items, rng.integers(1, 7), replace=False)})


def frame(spark, pairs):
    return spark.createDataFrame([(u, i, 1.0) for u, i in pairs], "user_id long, item_id long, value double")


def rounded(lists):
    return {u: {v: round(s, 12) for v, s in l.items()} for u, l in lists.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_deletion_sequences(spark, seed):
    rng = np.random.default_rng(100 + seed)
    rows = random_rows(seed)
    k = 3
    I = frame(spark, rows)
    N = K.build_neighbors(I, k, num_blocks=2).cache()
    live = set(rows)
    for step in range(2):
        pick = [rows[j] for j in rng.choice(len(rows), 6, replace=False)] + [(999, 1)]
        dels = spark.createDataFrame(pick, "user_id long, item_id long")
        acc, _ = U.split_requests(I, dels)
        I_new = I.join(acc, ["user_id", "item_id"], "left_anti")
        m = U.maintain_neighbors(N, I, I_new, acc.select("user_id").distinct(), k, 2)
        live -= set(pick)
        want = as_lists(K.build_neighbors(frame(spark, sorted(live)), k, num_blocks=1))
        assert rounded(as_lists(m.neighbors)) == rounded(want)
        I, N = frame(spark, sorted(live)), m.neighbors.cache()


def test_edge_cases_against_rebuild(spark):
    orders = spark.createDataFrame(
        [(1, 10, 0, 0), (2, 10, 1, 0), (3, 11, 2, 0), (4, 12, 3, 0), (5, 13, 4, 0), (6, 13, 5, 0)],
        "order_id long, user_id long, order_dow int, order_hour_of_day int")
    order_products = spark.createDataFrame(
        [(1, 100), (1, 100), (1, 101), (2, 102), (3, 100), (3, 102), (4, 103), (5, 101), (5, 102), (6, 100)],
        "order_id long, product_id long")
    products = spark.createDataFrame([(100 + i, f"p{i}", i + 1) for i in range(4)],
                                     "product_id long, product_name string, aisle_id int")
    p = purchases_from_frames(orders, order_products, products)
    st = build_state(p, k=2, num_blocks=1)
    # duplicate line (10, 100); emptied basket 2 and emptied user 12; same request twice; absent pair
    dels = spark.createDataFrame([(10, 100), (10, 100), (10, 102), (12, 103), (11, 999)],
                                 "user_id long, item_id long")
    res = U.forget(st, dels)
    assert sorted(tuple(r) for r in res.rejected.select("user_id", "item_id").collect()) == [(11, 999)]
    assert sorted(r["user_id"] for r in res.changed.collect()) == [10, 12]
    left = sorted(tuple(r) for r in res.state.purchases.order_products.collect())
    assert left == [(1, 101), (3, 100), (3, 102), (5, 101), (5, 102), (6, 100)]
    I_new = EM.interactions(res.state.purchases)
    assert rounded(as_lists(res.state.neighbors)) == rounded(as_lists(K.build_neighbors(I_new, 2, num_blocks=1)))
    want_e = {(r["user_id"], r["item_id"]): round(r["weight"], 12) for r in EM.embeddings(res.state.purchases).collect()}
    got_e = {(r["user_id"], r["item_id"]): round(r["weight"], 12) for r in res.state.embeddings.collect()}
    assert got_e == want_e
    assert 12 not in {u for u, _ in got_e}
    assert not res.state.neighbors.where((F.col("user_id") == 12) | (F.col("neighbor_id") == 12)).count()


def test_empty_inputs(spark):
    from tests.conftest import SF_SMALL
    from trolley.operators import graph as G
    from trolley.operators import relational as R
    from trolley.sources.purchases import load_purchases
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=5)
    st = st.with_(neighbors=st.neighbors.cache())
    none = spark.createDataFrame([], "user_id long, item_id long")
    res = U.forget(st, none)
    cols = ["user_id", "neighbor_id", "similarity", "rank"]
    assert res.state.neighbors.select(*cols).exceptAll(st.neighbors.select(*cols)).count() == 0
    assert res.state.neighbors.count() == st.neighbors.count()
    no_users = spark.createDataFrame([], "user_id long")
    assert R.top_aisles(p, spark.createDataFrame([], "cohort_id long, user_id long")).count() == 0
    egos = G.ego_networks(p, st.neighbors, no_users, "alcohol")
    assert egos["vertices"].count() == 0 and egos["top_aisles"].count() == 0
    assert R.sensitive_users(p, "alcohol", users=no_users).count() == 0
