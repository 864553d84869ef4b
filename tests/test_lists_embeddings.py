"""List-update goldens (k = 3), embedding goldens and the keyed difference."""

import pytest
from pyspark.sql import functions as F

from trolley.operators import diff as DF
from trolley.operators import embeddings as EM
from trolley.operators import unlearn as U
from trolley.schema import HyperParams

OLD = [(1, 1.0), (2, 0.8), (3, 0.5)]


def lists(spark, owner, entries):
    rows = [(owner, v, s, r + 1) for r, (v, s) in enumerate(sorted(entries, key=lambda e: (-e[1], e[0])))]
    return spark.createDataFrame(rows, "user_id long, neighbor_id long, similarity double, rank long")


def update(spark, old, neighbor, sim, k=3):
    owner = 0
    old_df = lists(spark, owner, old)
    changed = spark.createDataFrame([(neighbor,)], "user_id long")
    cand = spark.createDataFrame([(owner, neighbor, sim)] if sim > 0 else [],
                                 "user_id long, neighbor_id long, similarity double")
    merged = U.merge_lists(old_df, changed, cand, k)
    affected = spark.createDataFrame([(owner,)], "user_id long")
    label = U.label_lists(old_df, merged, affected, k).first()["label"]
    got = [(r["neighbor_id"], r["similarity"]) for r in merged.orderBy("rank").collect()]
    return label, got


@pytest.mark.parametrize("neighbor,sim,label,want", [
    (2, 0.7, "updated", [(1, 1.0), (2, 0.7), (3, 0.5)]),
    (2, 1.5, "updated", [(2, 1.5), (1, 1.0), (3, 0.5)]),
    (3, 0.6, "updated", [(1, 1.0), (2, 0.8), (3, 0.6)]),
    (3, 0.4, "recompute", None),
    (2, 0.8, "unchanged", [(1, 1.0), (2, 0.8), (3, 0.5)]),
    (3, 0.0, "recompute", None),
])
def test_full_list_updates(spark, neighbor, sim, label, want):
    got_label, got = update(spark, OLD, neighbor, sim)
    assert got_label == label
    if want is not None:
        assert got == want


def test_short_list_shrinks(spark):
    label, got = update(spark, [(1, 1.0), (3, 0.5)], 3, 0.4)
    assert label == "updated" and got == [(1, 1.0), (3, 0.4)]
    label, got = update(spark, [(1, 1.0), (3, 0.5)], 3, 0.0)
    assert label == "updated" and got == [(1, 1.0)]


def basket_rows(spark, baskets):
    rows = [(1, b, pos + 1, i) for pos, (b, items) in enumerate(baskets) for i in items]
    return spark.createDataFrame(rows, "user_id long, basket_id long, position long, item_id long")


def weights(df):
    return {r["item_id"]: r["weight"] for r in df.collect()}


PARAMS = HyperParams(3, 0.9, 0.7)


def test_ordered_embedding_golden(spark):
    bi = basket_rows(spark, [(10, [1, 2]), (11, [2]), (12, [3]), (13, [1])])
    groups = EM.basket_groups(bi.select("user_id", "basket_id", "position").distinct(), 3)
    w = weights(EM.user_vectors(EM.group_vectors(bi, groups, PARAMS), PARAMS))
    assert w == pytest.approx({1: 0.5945, 2: 0.1995, 3: 0.116666667}, abs=1e-9)


@pytest.mark.parametrize("baskets,want", [
    ([[1]], {1: 1.0}),
    ([[1], [1, 2]], {1: 0.9, 2: 0.45}),
    ([[1], [1, 2], [1]], {1: 0.81, 2: 0.27}),
    ([[1], [1, 2], [1], [1, 2], [1]], {1: 0.6561, 2: 0.26244}),
])
def test_unordered_embedding_golden(spark, baskets, want):
    bi = basket_rows(spark, [(100 + i, b) for i, b in enumerate(baskets)])
    closed = weights(EM.embeddings_unordered(bi, PARAMS))
    general = weights(EM.embeddings_general(bi.drop("position"), PARAMS, order_by=None))
    assert closed == pytest.approx(want, abs=1e-9)
    assert general == pytest.approx(want, abs=1e-9)


def test_keyed_difference(spark):
    old = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "key long, v double")
    new = spark.createDataFrame([(1, 0.5), (2, 0.4), (4, 0.1)], "key long, v double")
    got = {r["key"]: (round(r["delta"], 6), r["change"]) for r in DF.keyed_diff(old, new, ["key"], "v").collect()}
    assert got == {2: (0.1, "Update"), 3: (-0.2, "Delete"), 4: (0.1, "Insert")}


def test_change_counts(spark):
    d = spark.createDataFrame([(1, "Delete"), (1, "Insert"), (1, "Insert"), (2, "Update")],
                              "user_id long, change string")
    got = {r["user_id"]: (r["num_delete"], r["num_update"], r["num_insert"])
           for r in DF.change_counts(d).collect()}
    assert got == {1: (1, 0, 2), 2: (0, 1, 0)}


def test_linear_combine_drops_zeros(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25)], "user_id long, item_id long, weight double")
    b = spark.createDataFrame([(1, 1, 0.5)], "user_id long, item_id long, weight double")
    got = {r["item_id"]: r["weight"] for r in EM.linear_combine([(1.0, a), (-1.0, b)]).collect()}
    assert got == {2: 0.25}


def test_range_numbering_matches_window(spark):
    from pyspark.sql import Window
    from trolley.functions.numbering import row_numbers
    rows = [(u, b, (b * 7919) % 101) for u in (1, 2, 3) for b in range(200 if u == 1 else 5)]
    df = spark.createDataFrame(rows, "user_id long, basket_id long, ts long")
    got = {(r["user_id"], r["basket_id"]): r["position"]
           for r in row_numbers(df, "user_id", ["ts", "basket_id"]).collect()}
    w = Window.partitionBy("user_id").orderBy("ts", "basket_id")
    want = {(r["user_id"], r["basket_id"]): r["p"] for r in df.select("*", F.row_number().over(w).alias("p")).collect()}
    assert got == want


def test_discretise_roundtrip(spark):
    e = spark.createDataFrame([(1, 1, 0.123456789012345), (1, 2, 1.0)], "user_id long, item_id long, weight double")
    d = EM.discretise(e)
    assert [r["weight"] for r in d.orderBy("item_id").collect()] == [123456789012345, 1000000000000000]
    back = [r["weight"] for r in EM.restore(d).orderBy("item_id").collect()]
    assert back == pytest.approx([0.123456789012345, 1.0], abs=1e-15)


def test_presets_number_the_baskets_once(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from trolley.operators import embeddings as EM
    from trolley.schema import PRESETS
    from trolley.sources.purchases import load_purchases
    calls, numbered = [], EM.row_numbers
    monkeypatch.setattr(EM, "row_numbers", lambda *a, **kw: calls.append(1) or numbered(*a, **kw))
    p = load_purchases(spark, SF_SMALL)
    swept = EM.preset_sweep(p)
    assert len(calls) == 1
    name, params = sorted(PRESETS.items())[-1]
    cols = ["user_id", "item_id", "weight"]
    rounded = lambda df: {(r.user_id, r.item_id, round(r.weight, 9)) for r in df.select(*cols).collect()}
    assert rounded(swept.where(swept.preset == name)) == rounded(EM.embeddings(p, params, ordered=True))


def test_shuffles_start_with_partitions_in_proportion_to_the_rows(spark):
    from trolley import session as SE
    before = spark.conf.get(SE.INITIAL_PARTITIONS, None)
    try:
        spark.conf.unset(SE.INITIAL_PARTITIONS)
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert SE.size_shuffles(spark, 10) == least and not spark.conf.get(SE.INITIAL_PARTITIONS, None)
        assert SE.size_shuffles(spark, 1000 * SE.ROWS_PER_PARTITION) == 1000
        assert spark.conf.get(SE.INITIAL_PARTITIONS) == "1000"
        assert SE.size_shuffles(spark, 10) == 1000      # an open plan of a larger input keeps its number
    finally:
        spark.conf.unset(SE.INITIAL_PARTITIONS)
        if before is not None:
            spark.conf.set(SE.INITIAL_PARTITIONS, before)


def test_tasks_after_a_shuffle_are_bounded_in_bytes(spark):
    """Adaptive execution joins partitions up to its advisory size; 64 MB of bare ids are a gigabyte of hash table."""
    from trolley import session as SE
    assert [SE._bytes_of(x) for x in ("64MB", "65536b", "1g", "7", "8m")] == [64 << 20, 65536, 1 << 30, 7, 8 << 20]
    before = spark.conf.get(SE.ADVISORY)
    try:
        spark.conf.set(SE.ADVISORY, "64MB")
        SE.size_shuffles(spark, 10)
        assert SE._bytes_of(spark.conf.get(SE.ADVISORY)) == SE.TASK_BYTES
        spark.conf.set(SE.ADVISORY, "1MB")
        SE.size_shuffles(spark, 10)
        assert spark.conf.get(SE.ADVISORY) == "1MB"
    finally:
        spark.conf.set(SE.ADVISORY, before)
