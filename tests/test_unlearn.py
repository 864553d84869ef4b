"""Forgetting: list-maintenance goldens (4 x 5, k = 2) and equivalence with a rebuild."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_similarity import F1, F1_BUILD, as_lists, assert_lists, interactions
from trolley.operators import embeddings as EM
from trolley.operators import similarity as K
from trolley.operators import unlearn as U
from trolley.plans.state import build_state
from trolley.sources.purchases import load_purchases

AFTER_0_1 = {0: {2: 0.66666667}, 1: {3: 0.70710678, 2: 0.40824829},
             2: {0: 0.66666667, 1: 0.40824829}, 3: {1: 0.70710678}}
AFTER_1_3 = {0: {2: 0.66666667}, 1: {2: 0.57735027}, 2: {0: 0.66666667, 1: 0.57735027}}
AFTER_3_3 = {0: F1_BUILD[0], 1: {2: 0.40824829, 0: 0.35355339}, 2: F1_BUILD[2]}


def step(spark, I_old, N_old, pairs, k=2):
    dels = spark.createDataFrame(pairs, "user_id long, item_id long")
    accepted, _ = U.split_requests(I_old, dels)
    I_new = I_old.join(accepted, ["user_id", "item_id"], "left_anti")
    changed = accepted.select("user_id").distinct()
    m = U.maintain_neighbors(N_old, I_old, I_new, changed, k, 2)
    return I_new, m


def test_forget_sequence_golden(spark):
    I0 = interactions(spark, F1)
    N0 = K.build_neighbors(I0, 2, num_blocks=2)
    I1, m1 = step(spark, I0, N0, [(0, 1)])
    assert_lists(as_lists(m1.neighbors), AFTER_0_1)
    I2, m2 = step(spark, I1, m1.neighbors.cache(), [(1, 3)])
    assert_lists(as_lists(m2.neighbors), AFTER_1_3)


def test_emptied_user_leaves_lists(spark):
    I0 = interactions(spark, F1)
    N0 = K.build_neighbors(I0, 2, num_blocks=1)
    _, m = step(spark, I0, N0, [(3, 3)])
    assert_lists(as_lists(m.neighbors), AFTER_3_3)
    labels = {r["user_id"]: r["label"] for r in m.labels.collect()}
    assert labels[1] == "recompute"


def test_absent_and_repeated_requests(spark):
    I0 = interactions(spark, F1)
    dels = spark.createDataFrame([(0, 1), (0, 1), (0, 3), (9, 9)], "user_id long, item_id long")
    acc, rej = U.split_requests(I0, dels)
    assert sorted(tuple(r) for r in acc.collect()) == [(0, 1)]
    assert sorted((r["user_id"], r["item_id"]) for r in rej.collect()) == [(0, 3), (9, 9)]


@pytest.mark.parametrize("which", ["recall", "latest"])
def test_forget_equals_rebuild(spark, which):
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=10)
    st = st.with_(neighbors=st.neighbors.cache(), interactions=st.interactions.cache())
    dels = U.most_bought_item_deletions(p) if which == "recall" else U.latest_line(p)
    res = U.forget(st, dels)
    I_new = EM.interactions(res.state.purchases)
    want = K.build_neighbors(I_new, 10, num_blocks=3)
    got = res.state.neighbors
    cols = ["user_id", "neighbor_id", "similarity", "rank"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0
    e_want = EM.embeddings(res.state.purchases).select("user_id", "item_id", F.round("weight", 9).alias("w"))
    e_got = res.state.embeddings.select("user_id", "item_id", F.round("weight", 9).alias("w"))
    assert e_got.exceptAll(e_want).count() == 0 and e_want.exceptAll(e_got).count() == 0
    labels = {r["label"] for r in res.maintenance.labels.collect()}
    assert labels <= {"unchanged", "updated", "recompute"}


def test_recomputed_lists_and_norms(spark):
    """A deletion set of many users runs the same steps: labels without a rebuild, norms kept current."""
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=10)
    res = U.forget(st, U.most_bought_item_deletions(p))
    labels = {r["user_id"]: r["label"] for r in res.maintenance.labels.collect()}
    assert set(labels.values()) <= {"unchanged", "updated", "recompute"}
    redone = {r["user_id"] for r in res.maintenance.recomputed.select("user_id").distinct().collect()}
    changed = {r["user_id"] for r in res.changed.collect()}
    assert redone <= {u for u, x in labels.items() if x == "recompute"} | changed
    want = K.norms(res.state.interactions)
    assert res.state.norms.exceptAll(want).count() == 0 and want.exceptAll(res.state.norms).count() == 0


def test_negative_values_are_an_error(spark):
    I = spark.createDataFrame([(1, 1, 1.0), (2, 1, -1.0)], "user_id long, item_id long, value double")
    with pytest.raises(Exception, match="must not be negative"):
        K.build_neighbors(I, 2).collect()


def test_checkpoint_root_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from trolley.session import checkpoint_root

    conf = {}
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)),
                            sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(unset)
    unset.sparkContext.getCheckpointDir = lambda: "hdfs://shared/dir/"
    assert checkpoint_root(unset) == "hdfs://shared/dir"


def test_materialised_tables_are_pruned(spark):
    from trolley.session import materialize

    kept = materialize(spark.range(10).selectExpr("id", "id * 2 as twice", "'x' as other"))
    plan = kept.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [twice" in plan and "other" not in plan.split("ReadSchema")[1]


def test_refresh_recommendations_equals_full(spark):
    from trolley.operators import recommend as P
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=10)
    st = st.with_(neighbors=st.neighbors.cache())
    old = P.recommend(st.neighbors, st.embeddings, 0.1, 20).cache()
    res = U.forget(st, U.latest_line(p))
    got = U.refresh_recommendations(old, res, 0.1, 20)
    want = P.recommend(res.state.neighbors, res.state.embeddings, 0.1, 20)
    key = ["user_id", "item_id", F.round("score", 9).alias("s"), "rank"]
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
    assert want.select(*key).exceptAll(got.select(*key)).count() == 0


def test_forget_ordered_model_equals_rebuild(spark):
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=10, ordered=True)
    res = U.forget(st, U.most_bought_item_deletions(p))
    want = EM.embeddings(res.state.purchases, ordered=True)
    cols = ["user_id", "item_id", F.round("weight", 9).alias("w")]
    assert res.state.embeddings.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(res.state.embeddings.select(*cols)).count() == 0


def test_refresh_recommendations_many_users(spark):
    from trolley.operators import recommend as P
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=10)
    st = st.with_(neighbors=st.neighbors.cache())
    old = P.recommend(st.neighbors, st.embeddings, 0.1, 20).cache()
    res = U.forget(st, U.most_bought_item_deletions(p))
    got = U.refresh_recommendations(old, res, 0.1, 20)
    want = P.recommend(res.state.neighbors, res.state.embeddings, 0.1, 20)
    key = ["user_id", "item_id", F.round("score", 9).alias("s"), "rank"]
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
    assert want.select(*key).exceptAll(got.select(*key)).count() == 0


def test_one_deletion_writes_in_proportion(spark):
    """Bytes written by forgetting one pair: a share of the tables, and of lists only those that changed."""
    from tests.conftest import SF_MID
    from trolley.operators import unlearn as U
    from trolley.plans.model_store import ModelStore
    from trolley.plans.state import build_state
    from trolley.sources.purchases import load_purchases
    from trolley.streaming.changes import run_folder
    p = load_purchases(spark, SF_MID)
    st = build_state(p, k=10)
    res = U.forget(st, U.latest_line(p))
    written = res.state.store.written[1]
    whole = ModelStore.at(st, run_folder(spark, "test-whole"))
    for name in ("order_products", "interactions", "embeddings"):
        assert 0 < written[name] < 0.1 * whole.tables[name].manifest(0).written, name
    lists = st.neighbors.select("user_id").distinct().count()
    rewritten = res.maintenance.rewritten.count()
    assert written["neighbors"] < 5 * (rewritten / lists) * whole.tables["neighbors"].manifest(0).written + 20_000
    assert rewritten < 0.2 * lists
    # a second forget goes on from the first, and both equal a rebuild
    again = U.forget(res.state, U.latest_line(res.state.purchases))
    want = build_state(again.state.purchases, k=10)
    for name, cols in (("interactions", ["user_id", "item_id"]), ("neighbors", ["user_id", "neighbor_id", "similarity", "rank"])):
        got, full = getattr(again.state, name).select(*cols), getattr(want, name).select(*cols)
        assert got.exceptAll(full).count() == 0 == full.exceptAll(got).count(), name


def test_changed_lists_are_found_by_digest(spark):
    from tests.conftest import SF_SMALL
    from trolley.operators import unlearn as U
    from trolley.plans.state import build_state
    from trolley.sources.purchases import load_purchases
    p = load_purchases(spark, SF_SMALL)
    st = build_state(p, k=5)
    res = U.forget(st, U.most_bought_item_deletions(p))
    cols = ["user_id", "neighbor_id", "similarity"]
    o, n = st.neighbors.select(*cols), res.state.neighbors.select(*cols)
    want = {r[0] for r in o.exceptAll(n).unionByName(n.exceptAll(o)).select("user_id").distinct().collect()}
    assert {r[0] for r in U.changed_lists(st.neighbors, res.maintenance).collect()} == want
