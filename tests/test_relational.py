"""Relational operators on a hand-made purchase fixture (exact expected values)."""

from pyspark.sql import functions as F

from trolley.operators import relational as R
from trolley.sources.purchases import purchases_from_frames

CATALOGUE = {"sweets": (1,), "greens": (2, 3)}


def fixture(spark):
    orders = spark.createDataFrame(
        [(1, 7, 0, 9), (2, 7, 1, 10), (3, 8, 2, 11), (4, 9, 3, 12)],
        "order_id long, user_id long, order_dow int, order_hour_of_day int")
    lines = spark.createDataFrame(
        [(1, 100), (1, 100), (1, 101), (2, 100), (2, 102), (3, 101), (3, 102), (4, 103)],
        "order_id long, product_id long")
    products = spark.createDataFrame(
        [(100, "cake", 1), (101, "kale", 2), (102, "leek", 3), (103, "plum", 4)],
        "product_id long, product_name string, aisle_id int")
    return purchases_from_frames(orders, lines, products)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_category_counts_bag_and_bounds(spark):
    p = fixture(spark)
    counts = rows(R.category_buyers(p, "sweets", 0, 100, None, catalogue=CATALOGUE), "user_id", "num_items")
    assert counts == [(7, 3)]                       # duplicate line counted, as in COUNT(*)
    assert R.category_buyers(p, "sweets", 0, 3, None, catalogue=CATALOGUE).count() == 0   # exclusive bound
    greens = rows(R.category_buyers(p, "greens", 0, 100, 1, catalogue=CATALOGUE), "user_id", "num_items")
    assert greens == [(7, 2)]                       # limit keeps the smallest user id


def test_sensitive_users_and_flags(spark):
    p = fixture(spark)
    users = spark.createDataFrame([(7,), (8,), (9,)], "user_id long")
    assert rows(R.sensitive_users(p, "greens", users, catalogue=CATALOGUE), "user_id") == [(7,), (8,)]
    flags = rows(R.flag_sensitive(p.products, "greens", catalogue=CATALOGUE), "product_id", "sensitive")
    assert flags == [(100, False), (101, True), (102, True), (103, False)]


def test_top_aisles_shares_and_duplicate_members(spark):
    p = fixture(spark)
    cohorts = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 9)], "cohort_id long, user_id long")
    got = {(r["cohort_id"], r["aisle_id"]): (round(r["normalized_count"], 12), r["rank"])
           for r in R.top_aisles(p, cohorts, n=2).collect()}
    # cohort 1 lines: aisle 1 x3, aisle 2 x2, aisle 3 x2 -> 3/7, then 2/7 (tie, smaller aisle first)
    assert got == {(1, 1): (round(3 / 7, 12), 1), (1, 2): (round(2 / 7, 12), 2), (2, 4): (1.0, 1)}


def test_history_stats_and_baskets_of(spark):
    p = fixture(spark)
    assert R.purchase_history(p).count() == 8
    stats = rows(R.purchase_stats(p), "user_id", "num_baskets", "num_items")
    assert stats == [(7, 2, 3), (8, 1, 2), (9, 1, 1)]
    dels = spark.createDataFrame([(7, 100), (7, 100), (8, 100)], "user_id long, item_id long")
    assert rows(R.baskets_of(p, dels), "user_id", "item_id", "order_id") == [(7, 100, 1), (7, 100, 2)]


def test_top_aisles_named(spark):
    p = fixture(spark)
    shares = R.top_aisles(p, spark.createDataFrame([(1, 9)], "cohort_id long, user_id long"))
    aisles = spark.createDataFrame([(4, "stone fruit")], "aisle_id int, aisle string")
    r = R.top_aisles_named(p, shares, aisles).first()
    assert (r["aisle_name"], r["percentage"], r["rank"]) == ("Stone fruit", 100.0, 1)
