"""The five-file purchase layout gives the same model as the mapped test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trolley.operators import embeddings as EM
from trolley.operators import similarity as K
from trolley.sources.purchases import load_instacart, load_purchases, table
from trolley.streaming.changes import run_folder


def write_layout(spark, folder):
    o = table(spark, SF_SMALL, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
             F.row_number().over(w).alias("order_number"),
             (F.dayofweek("o_orderdate") - 1).alias("order_dow"), F.hour("o_orderdate").alias("order_hour_of_day"),
             F.lit(None).cast("double").alias("days_since_prior_order")).write.parquet(f"{folder}/orders.parquet")
    table(spark, SF_SMALL, "lineitem").select(F.col("l_orderkey").alias("order_id"),
                                              F.col("l_partkey").alias("product_id"),
                                              F.col("l_linenumber").alias("add_to_cart_order"),
                                              F.lit(0).alias("reordered")).write.parquet(f"{folder}/order_products.parquet")
    part = table(spark, SF_SMALL, "part")
    part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                F.substring("p_brand", 7, 8).cast("int").alias("aisle_id"),
                F.lit(1).alias("department_id")).write.parquet(f"{folder}/products.parquet")
    part.select(F.substring("p_brand", 7, 8).cast("int").alias("aisle_id"), F.col("p_brand").alias("aisle")) \
        .distinct().write.parquet(f"{folder}/aisles.parquet")
    spark.createDataFrame([(1, "all")], "department_id int, department string").write.parquet(
        f"{folder}/departments.parquet")


def same(a, b, cols):
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_instacart_layout_matches(spark):
    folder = run_folder(spark, "layout")
    write_layout(spark, folder)
    ic = load_instacart(spark, folder)
    tp = load_purchases(spark, SF_SMALL)
    assert ic.order_by == ("order_number",)
    w = ["user_id", "item_id", F.round("weight", 9).alias("w")]
    assert same(EM.embeddings(ic), EM.embeddings(tp), w)
    assert same(EM.embeddings(ic, ordered=True), EM.embeddings(tp, ordered=True), w)
    n = ["user_id", "neighbor_id", "similarity", "rank"]
    assert same(K.build_neighbors(EM.interactions(ic), 10), K.build_neighbors(EM.interactions(tp), 10), n)
    assert ic.aisles.count() == tp.aisles.count()


def test_scenario_names_follow_the_layout(spark):
    from trolley.operators import relational as R
    from trolley.schema import REFERENCE_SCENARIOS, TEST_SCENARIOS
    folder = run_folder(spark, "layout-names")
    write_layout(spark, folder)
    ic, tp = load_instacart(spark, folder), load_purchases(spark, SF_SMALL)
    cols = ["user_id", "order_id", "product_id"]
    assert same(R.category_lines(ic, "alcohol"), R.category_lines(tp, REFERENCE_SCENARIOS["alcohol"]), cols)
    assert same(R.category_lines(tp, "alcohol"), R.category_lines(ic, TEST_SCENARIOS["alcohol"]), cols)
    assert ic.with_(scenarios={"alcohol": (1,)}).scenarios["alcohol"] == (1,)
