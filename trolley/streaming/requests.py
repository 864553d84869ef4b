"""Request ingestion. JSON-lines requests -> typed rows, malformed rows kept aside.

Request forms (one JSON object per line, tagged by its single key):
  {"PurchaseDeletion": {"user_id": 7, "item_id": 12}}
  {"Purchases": {"user_id": 7}}
  {"Recommendations": {"user_id": 7}}
  {"ModelState": {"user_id": 7, "scenario": "Alcohol"}}
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_USER = T.StructType([T.StructField("user_id", T.LongType())])
REQUEST_SCHEMA = T.StructType([
    T.StructField("PurchaseDeletion", T.StructType([T.StructField("user_id", T.LongType()),
                                                    T.StructField("item_id", T.LongType())])),
    T.StructField("Purchases", _USER),
    T.StructField("Recommendations", _USER),
    T.StructField("ModelState", T.StructType([T.StructField("user_id", T.LongType()),
                                              T.StructField("scenario", T.StringType())])),
])
# The scenario names a request may carry.
SCENARIOS = ("Alcohol", "Obesity", "Carbon")


def parse_requests(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """``(raw, kind, user_id, item_id, scenario, error)``; works on batch and streaming frames alike.

    A row is malformed when it is not JSON of the schema, carries no or several tags, or lacks a
    required field; it is kept with ``kind = null`` and an error text, never dropped silently.
    """
    r = F.from_json(F.col(text_col), REQUEST_SCHEMA, {"mode": "PERMISSIVE"})
    parsed = lines.select(F.col(text_col).alias("raw"), r.alias("r"))
    tags = [F.col(f"r.{t}").isNotNull().cast("int") for t in REQUEST_SCHEMA.fieldNames()]
    n_tags = tags[0] + tags[1] + tags[2] + tags[3]
    kind = (F.when(F.col("r.PurchaseDeletion").isNotNull(), F.lit("PurchaseDeletion"))
             .when(F.col("r.Purchases").isNotNull(), F.lit("Purchases"))
             .when(F.col("r.Recommendations").isNotNull(), F.lit("Recommendations"))
             .when(F.col("r.ModelState").isNotNull(), F.lit("ModelState")))
    user = F.coalesce(F.col("r.PurchaseDeletion.user_id"), F.col("r.Purchases.user_id"),
                      F.col("r.Recommendations.user_id"), F.col("r.ModelState.user_id"))
    item = F.col("r.PurchaseDeletion.item_id")
    scenario = F.col("r.ModelState.scenario")
    error = (F.when(F.col("r").isNull() | (n_tags == 0), F.lit("not a request"))
              .when(n_tags > 1, F.lit("several request tags"))
              .when(user.isNull(), F.lit("missing user_id"))
              .when((kind == "PurchaseDeletion") & item.isNull(), F.lit("missing item_id"))
              .when((kind == "ModelState") & ~F.coalesce(scenario.isin(*SCENARIOS), F.lit(False)),
                    F.lit("unknown scenario")))
    return parsed.select("raw", F.when(error.isNull(), kind).alias("kind"), user.alias("user_id"),
                         item.alias("item_id"), scenario.alias("scenario"), error.alias("error"))


def deletion_requests(parsed: DataFrame) -> DataFrame:
    """Valid purchase deletions as ``(user_id, item_id)``."""
    return parsed.where(F.col("kind") == "PurchaseDeletion").select("user_id", "item_id")


def to_request_json(deletions: DataFrame) -> DataFrame:
    """Encode ``(user_id, item_id)`` rows as deletion-request text lines (column ``value``)."""
    return deletions.select(F.to_json(F.struct(
        F.struct(F.col("user_id"), F.col("item_id")).alias("PurchaseDeletion"))).alias("value"))


def answer_requests(state, parsed: DataFrame, alpha: float = 0.1, n: int = 20) -> dict[str, DataFrame]:
    """Answer a batch of parsed read requests with one plan per request kind.

    ``Purchases`` -> purchase history rows, ``Recommendations`` -> top-n items,
    ``ModelState`` -> embedding rows plus the ego network's vertices, edges, sensitive flags and
    top aisles per (user, scenario). Each answer is keyed by ``user_id`` (and ``scenario``);
    deletions are applied by ``unlearn.forget``, malformed rows are returned under ``rejected``.
    Works in ``foreachBatch`` as well as on a batch of requests.
    """
    from trolley.operators import embeddings as EM
    from trolley.operators import graph as G
    from trolley.operators import recommend as P
    from trolley.operators import relational as R

    def users(kind: str) -> DataFrame:
        return parsed.where(F.col("kind") == kind).select("user_id").distinct()

    p = state.purchases
    out = {
        "purchases": R.purchase_history(p, users("Purchases")),
        "recommendations": P.recommend(state.neighbors, state.embeddings, alpha, n, users("Recommendations")),
        "embeddings": EM.embeddings_of(state.embeddings, users("ModelState")),
        "rejected": parsed.where(F.col("kind").isNull()).select("raw", "error"),
    }
    model = parsed.where(F.col("kind") == "ModelState").select("user_id", F.lower("scenario").alias("scenario"))
    for scenario in SCENARIOS:   # one ego-network plan per scenario name (a fixed, small set)
        asked = model.where(F.col("scenario") == scenario.lower()).select("user_id")
        for part, df in G.ego_networks(p, state.neighbors, asked, scenario.lower()).items():
            key = f"ego_{part}"
            tagged = df.withColumn("scenario", F.lit(scenario.lower()))
            out[key] = tagged if key not in out else out[key].unionByName(tagged)
    return out
