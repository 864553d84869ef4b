"""Insertions and removals through one input, turns of one user's requests, and the kept reverse lists."""

import random

import pytest
from pyspark.sql import functions as F

from trolley.operators import similarity as K
from trolley.operators import unlearn as U
from trolley.plans.model_store import ModelStore
from trolley.plans.state import build_state
from trolley.sources.purchases import purchases_from_frames
from trolley.streaming import maintain as MT
from trolley.streaming.changes import run_folder, write_change_files

CHANGES = "op int, order_id long, user_id long, product_id long"


def shop(spark, baskets):
    """Purchases of ``{order_id: (user_id, [product_id])}``; products 1..12 in aisles 1..4."""
    orders = spark.createDataFrame([(o, u, o % 7, o % 24) for o, (u, _) in baskets.items()],
                                   "order_id long, user_id long, order_dow int, order_hour_of_day int")
    ol = spark.createDataFrame([(o, i) for o, (_, items) in baskets.items() for i in items], "order_id long, product_id long")
    products = spark.createDataFrame([(i, f"p{i}", 1 + i % 4) for i in range(1, 13)], "product_id long, product_name string, aisle_id int")
    return purchases_from_frames(orders, ol, products)


def random_baskets(seed, users=25, n=60):
    rng = random.Random(seed)
    return {100 + o: (rng.randrange(users), sorted(rng.sample(range(1, 13), rng.randint(1, 4)))) for o in range(n)}


def same(a, b, cols):
    key = [F.round(c, 9).alias(c) if c in ("similarity", "weight", "nsq") else c for c in cols]
    return sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))


def same_model(got, want):
    return [name for name, frame, cols in (
        ("lines", lambda s: s.purchases.order_products, ["order_id", "product_id"]),
        ("interactions", lambda s: s.interactions, ["user_id", "item_id"]),
        ("embeddings", lambda s: s.embeddings, ["user_id", "item_id", "weight"]),
        ("neighbors", lambda s: s.neighbors, ["user_id", "neighbor_id", "similarity", "rank"]),
        ("norms", lambda s: s.norms, ["user_id", "nsq"])) if not same(frame(got), frame(want), cols)]


@pytest.mark.parametrize("lasting", [False, True])
def test_new_and_removed_lines_equal_a_rebuild(spark, lasting):
    baskets = random_baskets(1)
    baskets[100] = (3, [1, 1, 2])
    st = build_state(shop(spark, baskets), k=4)
    if lasting:
        st = ModelStore.at(st, run_folder(spark, "test-lines"), bucket_bytes=2000).state(st, 0)
    u, items = baskets[101]
    changes = [(-1, 100, 3, 1),                                          # one of two equal lines
               (1, 101, u, 12), (-1, 101, u, items[0]),                  # into and out of a basket
               *[(-1, 102, baskets[102][0], i) for i in baskets[102][1]],    # a basket emptied
               (1, 900, 77, 5), (1, 900, 77, 6), (1, 901, 3, 7),         # a new user, a new basket
               (1, 903, 4, 3), (-1, 903, 4, 3),                          # sums to nothing
               (-1, 101, u, 99), (1, 100, 4, 2), (1, None, 1, 1), (1, 5, None, 1)]
    res = U.change_lines(st, spark.createDataFrame(changes, CHANGES))
    assert sorted(r["reason"] for r in res.rejected.collect()) == ["basket of another user", "not that many lines", "null id", "null id"]
    baskets[100] = (3, [1, 2])
    baskets[101] = (u, items[1:] + [12])
    baskets[102] = (baskets[102][0], [])
    baskets |= {900: (77, [5, 6]), 901: (3, [7])}
    assert same_model(res.state, build_state(shop(spark, baskets), k=4)) == []
    # a second change goes on from the first: user 77 goes, its basket is taken by nobody else
    res = U.change_lines(res.state, spark.createDataFrame([(-1, 900, 77, 5), (-1, 900, 77, 6), (1, 900, 78, 6)], CHANGES))
    baskets[900] = (77, [])
    assert same_model(res.state, build_state(shop(spark, baskets), k=4)) == []
    assert [r["reason"] for r in res.rejected.collect()] == ["basket of another user"]
    everyone = st.interactions.select("user_id").distinct()
    assert same(res.state.in_neighbors(everyone), K.in_neighbors_of(res.state.neighbors, everyone),
                ["user_id", "in_neighbor_id", "similarity"])


def test_changes_from_nothing_and_restart(spark):
    baskets = random_baskets(2, users=12, n=25)
    whole = shop(spark, baskets)
    none = whole.with_(orders=whole.orders.where("false"), order_products=whole.order_products.where("false"))
    empty = build_state(none, k=4)
    root = run_folder(spark, "test-from-nothing")
    record = lambda rows: spark.createDataFrame(rows, "op int, basket_id long, user_id long, item_id long").coalesce(1)
    first = [(1, o, u, i) for o, (u, items) in baskets.items() for i in items]
    second = [(-1, o, u, items[0]) for o, (u, items) in baskets.items() if o % 5 == 0]
    glob = write_change_files([record(first), record(second)], f"{root}/in")
    assert MT.maintain_changes(spark, empty, glob, root, orders=whole.orders) == 2
    assert MT.maintain_changes(spark, empty, glob, root, orders=whole.orders) == 2      # nothing new
    left = {o: (u, items[1:] if o % 5 == 0 else items) for o, (u, items) in baskets.items()}
    store = ModelStore.at(empty, f"{root}/model")
    assert same_model(store.state(empty, 2), build_state(shop(spark, left), k=4)) == []
    assert same(store.state(empty, 2).purchases.orders, whole.orders, ["order_id", "user_id", "order_dow"])
    assert store.versions() == [1, 2]


def test_turns_equal_single_forgets(spark):
    st = build_state(shop(spark, random_baskets(3)), k=4)
    pairs = [tuple(r) for r in st.interactions.where("user_id = 5").select("user_id", "item_id").orderBy("item_id").limit(2).collect()]
    assert len(pairs) == 2
    ask = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long")

    def record(before, res):
        rows = U.impact_summary(res, MT.impact_diffs(before, res.state, res.changed), with_timings=False).collect()
        assert len(rows) == 1
        return rows[0]

    got = []
    for before, res in U.forget_in_turn(st, ask(pairs + [(5, 99)])):
        got.append(record(before, res))
    want, state = [], st
    for pair in pairs:
        res = U.forget(state, ask([pair]))
        want.append(record(state, res))
        state = res.state
    assert got == want and got[0]["num_embedding_changes"] > 0
    at_once = U.forget(st, ask(pairs)).state
    assert same_model(state, at_once) == []
    assert [res.accepted.count() for _, res in U.forget_in_turn(st, ask([(5, 99)]))] == [0]


def test_reverse_lists_read_their_buckets_alone(spark):
    st = build_state(shop(spark, random_baskets(4, users=150, n=300)), k=10)
    store = ModelStore.at(st, run_folder(spark, "test-reverse"), bucket_bytes=5000, share=10.0, max_deltas=99)
    res = U.forget(store.state(st, 0), U.latest_line(st.purchases))
    t = store.tables["reverse"]
    m = t.manifest(1)
    asked = spark.createDataFrame([(7,)], "user_id long")
    found = t._buckets_of(m.directory, asked.withColumnRenamed("user_id", "neighbor_id"))
    assert len(found) == 1 < len(m.directory)
    assert same(res.state.in_neighbors(asked), K.in_neighbors_of(res.state.neighbors, asked), ["user_id", "in_neighbor_id", "similarity"])
    # the commit itself, before any bucket is split, writes entries that moved, not whole lists
    first = t.manifest(0).seq + 1
    new = [p for p in m.parts if p.kind == "rows" and p.seq == first]
    moved = spark.read.parquet(*[p.path for p in new]).count() if new else 0
    assert store.written[1]["reverse"] > 0 and moved < 0.25 * res.state.neighbors.count()
