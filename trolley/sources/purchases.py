"""The purchase tables, SQL over parquet paths and the model's edge projections.

The purchase schema (orders, order_products, products) is derived from the TPC-H-like test tables:

  orders          o_orderkey, o_custkey, dayofweek(o_orderdate) - 1, hour(o_orderdate), o_orderdate
  order_products  l_orderkey, l_partkey                      (a bag: duplicate lines are kept)
  products        p_partkey, p_name, int(substr(p_brand, 7)), p_type

Every frame is a lazy projection of the parquet scan, so column pruning and filter pushdown reach
the reader (``ReadSchema`` lists only the used columns).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.schema import ORDER_PRODUCTS, ORDERS, PRODUCTS, REFERENCE_SCENARIOS, TEST_SCENARIOS, check_columns
from trolley.session import size_shuffles


@dataclass(frozen=True)
class Purchases:
    orders: DataFrame          # order_id, user_id, order_dow, order_hour_of_day, order_ts
    order_products: DataFrame  # order_id, product_id
    products: DataFrame        # product_id, product_name, aisle_id, department
    aisles: DataFrame | None = None        # aisle_id, aisle
    departments: DataFrame | None = None   # department
    order_by: tuple[str, ...] = ("order_ts",)   # orders columns giving the basket order
    scenarios: dict = field(default_factory=lambda: TEST_SCENARIOS)   # aisles that a scenario's name means here

    def with_(self, **kw) -> "Purchases":
        return replace(self, **kw)

    def register(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` (temp views; no data is moved)."""
        self.orders.createOrReplaceTempView(f"{prefix}orders")
        self.order_products.createOrReplaceTempView(f"{prefix}order_products")
        self.products.createOrReplaceTempView(f"{prefix}products")
        for name, frame in (("aisles", self.aisles), ("departments", self.departments)):
            if frame is not None:
                frame.createOrReplaceTempView(f"{prefix}{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_purchases(spark: SparkSession, sf_dir: str) -> Purchases:
    """The purchase database as three lazily projected parquet scans."""
    o = table(spark, sf_dir, "orders")
    orders = o.select(
        F.col("o_orderkey").cast("long").alias("order_id"),
        F.col("o_custkey").cast("long").alias("user_id"),
        (F.dayofweek("o_orderdate") - 1).cast("int").alias("order_dow"),
        F.hour("o_orderdate").cast("int").alias("order_hour_of_day"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("order_ts"),
    )
    li = table(spark, sf_dir, "lineitem")
    size_shuffles(spark, li.count())   # from the file footers
    order_products = li.select(
        F.col("l_orderkey").cast("long").alias("order_id"),
        F.col("l_partkey").cast("long").alias("product_id"),
    )
    p = table(spark, sf_dir, "part")
    products = p.select(
        F.col("p_partkey").cast("long").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.substring("p_brand", 7, 8).cast("int").alias("aisle_id"),
        F.col("p_type").alias("department"),
    )
    aisles = p.select(F.substring("p_brand", 7, 8).cast("int").alias("aisle_id"),
                      F.col("p_brand").alias("aisle")).distinct()
    departments = p.select(F.col("p_type").alias("department")).distinct()
    return Purchases(
        check_columns(orders, ORDERS, "orders"),
        check_columns(order_products, ORDER_PRODUCTS, "order_products"),
        check_columns(products, PRODUCTS, "products"),
        aisles, departments, ("order_ts",),
    )


def load_instacart(spark: SparkSession, folder: str) -> Purchases:
    """S1 for the original five-file purchase layout: ``orders``, ``order_products``, ``products``,
    ``aisles`` and ``departments`` parquet files with their own column names.

    The basket order is the user's ``order_number``; there is no order time.
    """
    def read(name):
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    o = read("orders")
    orders = o.select(
        F.col("order_id").cast("long"), F.col("user_id").cast("long"),
        F.col("order_dow").cast("int"), F.col("order_hour_of_day").cast("int"),
        F.lit(None).cast("timestamp_ntz").alias("order_ts"),
        F.col("order_number").cast("long"))
    order_products = read("order_products")
    size_shuffles(spark, order_products.count())
    order_products = order_products.select(F.col("order_id").cast("long"),
                                                   F.col("product_id").cast("long"))
    departments = read("departments").select(F.col("department_id").cast("int"), "department")
    products = (read("products").select(F.col("product_id").cast("long"), "product_name",
                                        F.col("aisle_id").cast("int"), F.col("department_id").cast("int"))
                .join(departments, "department_id", "left").drop("department_id"))
    aisles = read("aisles").select(F.col("aisle_id").cast("int"), "aisle")
    return Purchases(
        check_columns(orders, ORDERS, "orders"),
        check_columns(order_products, ORDER_PRODUCTS, "order_products"),
        check_columns(products, PRODUCTS, "products"),
        aisles, departments.select("department"), ("order_number",), REFERENCE_SCENARIOS,
    )


def purchases_from_frames(orders: DataFrame, order_products: DataFrame, products: DataFrame) -> Purchases:
    """Purchases from frames that already follow the contracts (e.g. the original instacart files)."""
    if "order_ts" not in orders.columns:
        orders = orders.withColumn("order_ts", F.lit(None).cast("timestamp_ntz"))
    if "department" not in products.columns:
        products = products.withColumn("department", F.lit(None).cast("string"))
    return Purchases(
        check_columns(orders, ORDERS, "orders"),
        check_columns(order_products, ORDER_PRODUCTS, "order_products"),
        check_columns(products, PRODUCTS, "products"),
    )


def lines(p: Purchases) -> DataFrame:
    """Order lines with their user: ``(order_id, user_id, product_id)``, a bag (shuffle on order_id)."""
    return p.order_products.join(p.orders.select("order_id", "user_id"), "order_id")


def purchase_edges(p: Purchases) -> tuple[DataFrame, DataFrame]:
    """The two edge projections fed to the model: (order_id, user_id) and (order_id, product_id)."""
    return p.orders.select("order_id", "user_id"), p.order_products.select("order_id", "product_id")


def sql_over_path(spark: SparkSession, sf_dir: str, query: str, **args) -> DataFrame:
    """Run SQL text whose FROM clauses name parquet files.

    ``{dir}`` in the text is replaced by the data folder; values go through named parameters
    (``:name``), never through string formatting.
    """
    return spark.sql(query.replace("{dir}", sf_dir.rstrip("/")), args=args or None)
