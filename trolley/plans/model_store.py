"""The tables of a model as delta tables: a forgotten or new purchase writes what it changes, no more.

``over(state)`` lays deltas over a state's own tables, which stay as they are; ``create`` writes them as
buckets of a lasting store, for streams. Lists and vectors are replaced whole per user; order lines and
interactions go by their keys. ``reverse`` holds each list entry under its neighbour, so that the lists
holding a user (K7) are read from that user's bucket; it takes only entries that came, went or moved. ``seal`` commits a version of all tables at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trolley.session import checkpoint_root, materialize
from trolley.sources.delta import DeltaTable
from trolley.sources.store import filesystem

# table: (keys of a tombstone, hashed columns)
TABLES = {
    "orders": (("order_id",), ("order_id",)),
    "order_products": (("order_id", "product_id"), ("order_id", "product_id")),
    "interactions": (("user_id", "item_id"), ("user_id", "item_id")),
    "embeddings": (("user_id",), ("user_id",)),
    "neighbors": (("user_id",), ("user_id",)),
    "reverse": (("neighbor_id", "user_id"), ("neighbor_id", "user_id")),   # a user in a great many lists goes on by list
}
REVERSE = ("neighbor_id", "user_id", "similarity")


class ModelStore:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType],
                 sources: dict[str, DataFrame] | None = None, **settings):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {name: DeltaTable(spark, f"{self.root}/{name}", keys, hashed, schemas[name],
                                        source=sources[name] if sources else None, **settings)
                       for name, (keys, hashed) in TABLES.items()}
        self.written: dict[int, dict[str, int]] = {}     # bytes of each table, by version committed here

    @staticmethod
    def _tables_of(state) -> dict[str, DataFrame]:
        return {"orders": state.purchases.orders, "order_products": state.purchases.order_products,
                "interactions": state.interactions, "embeddings": state.embeddings, "neighbors": state.neighbors,
                "reverse": state.neighbors.select(*REVERSE)}

    @classmethod
    def over(cls, state) -> "ModelStore":
        """Deltas over the state's tables as version 0."""
        tables = cls._tables_of(state)
        spark = state.interactions.sparkSession
        return cls(spark, f"{checkpoint_root(spark)}/models/{uuid.uuid4().hex}", {n: t.schema for n, t in tables.items()}, tables)

    @classmethod
    def at(cls, state, root: str, **settings) -> "ModelStore":
        """The lasting store in ``root``; ``state`` is written as its version 0 unless it has a version."""
        tables = cls._tables_of(state)
        store = cls(state.interactions.sparkSession, root, {n: t.schema for n, t in tables.items()}, **settings)
        if not store.versions():
            for name, t in tables.items():
                store.tables[name].create(t)
            store.seal(0)
        return store

    def read(self, name: str, version: int, only: DataFrame | None = None) -> DataFrame:
        return self.tables[name].read(version, only)

    def commit(self, name: str, version: int, gone: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Commit one table's change and read it back."""
        self.written.setdefault(version, {})[name] = self.tables[name].commit(version, gone, rows)
        return self.read(name, version)

    def commit_lists(self, version: int, rewritten: DataFrame, rows: DataFrame) -> DataFrame:
        """Replace the ``rewritten`` lists by ``rows``, here and in the reverse lists, and read them back."""
        old = self.read("neighbors", version - 1, only=rewritten)
        moved = materialize(
            old.select("neighbor_id", "user_id", F.col("similarity").alias("was"))
            .join(rows.select(*REVERSE), ["neighbor_id", "user_id"], "full")
            .where(~F.col("was").eqNullSafe(F.col("similarity"))))
        self.commit("reverse", version, gone=moved.where(F.col("was").isNotNull()),
                    rows=moved.where(F.col("similarity").isNotNull()).select(*REVERSE))
        return self.commit("neighbors", version, gone=rewritten, rows=rows)

    def in_neighbors(self, version: int, users: DataFrame) -> DataFrame:
        """K7 from the reverse lists: the buckets of the given users alone are read."""
        asked = users.select(F.col("user_id").alias("neighbor_id"))
        return self.read("reverse", version, only=asked).select(
            F.col("neighbor_id").alias("user_id"), F.col("user_id").alias("in_neighbor_id"), "similarity")

    def versions(self) -> list[int]:
        """Sealed versions: those of which every table is committed."""
        fs, path = filesystem(self.spark, f"{self.root}/sealed")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def seal(self, version: int) -> None:
        fs, path = filesystem(self.spark, f"{self.root}/sealed/{int(version)}")
        fs.create(path, True).close()

    def state(self, template, version: int):
        """``template`` with the tables of a version; norms are those of its interactions."""
        from trolley.operators import similarity as K
        t = {name: self.read(name, version) for name in TABLES if name != "reverse"}
        return template.with_(purchases=template.purchases.with_(orders=t["orders"], order_products=t["order_products"]),
                              interactions=t["interactions"], embeddings=t["embeddings"], neighbors=t["neighbors"],
                              norms=K.norms(t["interactions"], template.measure), store=self, version=version)

    def drop_before(self, version: int) -> None:
        for t in self.tables.values():
            t.drop_before(version)
        for v in self.versions():
            if v < version:
                fs, path = filesystem(self.spark, f"{self.root}/sealed/{v}")
                fs.delete(path, False)
