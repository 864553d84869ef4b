"""Schema contracts, the scenario catalogue and the model presets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------- table contracts

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("order_dow", T.IntegerType()),
    T.StructField("order_hour_of_day", T.IntegerType()),
    T.StructField("order_ts", T.TimestampNTZType()),   # wall-clock order time, no zone
])
ORDER_PRODUCTS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("aisle_id", T.IntegerType()),
    T.StructField("department", T.StringType()),
])
INTERACTIONS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("value", T.DoubleType()),
])
EMBEDDINGS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("weight", T.DoubleType()),
])
NEIGHBORS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("neighbor_id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("rank", T.LongType()),
])
DELETIONS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
])


def check_columns(df: DataFrame, contract: T.StructType, name: str) -> DataFrame:
    """Fail fast (driver side, no job) when a frame misses a contract column or has a wrong type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in contract.fields:
        if field.name not in have:
            raise ValueError(f"{name}: missing column {field.name!r}; have {sorted(have)}")
        if have[field.name] != field.dataType:
            raise TypeError(f"{name}.{field.name}: expected {field.dataType.simpleString()}, "
                            f"got {have[field.name].simpleString()}")
    return df


# ---------------------------------------------------------------- scenario catalogue

# Sensitive aisle ids per scenario in the reference's product id space.
REFERENCE_SCENARIOS: dict[str, tuple[int, ...]] = {
    "alcohol": (27, 28, 62, 124, 134),
    "obesity": (37, 38, 45, 61, 77, 79, 106),
    "carbon": (96, 106),
    "meat": (5, 15, 33, 34, 35, 49, 95, 96, 106, 122),
}

# The same four scenarios drawn inside the aisle range 1..25 of the test tables.
TEST_SCENARIOS: dict[str, tuple[int, ...]] = {
    "alcohol": (2, 3, 6, 12, 13),
    "obesity": (4, 5, 7, 14, 17, 19, 20),
    "carbon": (20, 24),
    "meat": (1, 8, 9, 10, 11, 15, 20, 22, 24, 25),
}

# Buyer-count ranges (exclusive bounds) and result sizes of the scenario queries.
# (lower, upper, limit); carbon uses 3..15 on the test tables because 10..15 is empty there.
BUYER_RANGES: dict[str, tuple[int, int, int]] = {
    "alcohol": (10, 25, 10),
    "meat": (20, 35, 20),
    "carbon": (3, 15, 20),
    "obesity": (10, 25, 20),
}


def aisle_list_sql(scenario: str, catalogue: dict[str, tuple[int, ...]] | None = None) -> str:
    catalogue = catalogue or TEST_SCENARIOS
    return ", ".join(str(a) for a in catalogue[scenario])


# ---------------------------------------------------------------- model presets

@dataclass(frozen=True)
class HyperParams:
    group_size: int
    r_basket: float
    r_group: float


# Model presets (group size, basket decay, group decay).
PRESETS: dict[str, HyperParams] = {
    "valuedshopper": HyperParams(7, 1.0, 0.6),
    "instacart": HyperParams(3, 0.9, 0.7),
    "tafang": HyperParams(7, 0.9, 0.7),
}
DEFAULT_PARAMS = PRESETS["instacart"]

# Recommendation and neighbour-table settings of the reference service.
DEFAULT_K = 50
DEFAULT_ALPHA = 0.1
DEFAULT_TOP_N = 20
DISCRETISATION_FACTOR = 1e15
