"""The model state as a bundle of DataFrames: interactions, norms, embeddings and neighbours."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from trolley.functions.measures import COSINE, Measure
from trolley.operators import embeddings as EM
from trolley.operators import similarity as K
from trolley.schema import DEFAULT_K, DEFAULT_PARAMS, HyperParams
from trolley.session import materialize
from trolley.sources.purchases import Purchases


@dataclass(frozen=True)
class ModelState:
    purchases: Purchases
    interactions: DataFrame   # user_id, item_id, value
    embeddings: DataFrame     # user_id, item_id, weight
    neighbors: DataFrame      # user_id, neighbor_id, similarity, rank
    norms: DataFrame          # user_id, nsq, norm
    params: HyperParams = DEFAULT_PARAMS
    k: int = DEFAULT_K
    ordered: bool = False
    num_blocks: int = 1
    store: object = None      # the ModelStore that the tables are read from, if any, and its version
    version: int = 0
    measure: Measure = COSINE

    def with_(self, **kw) -> "ModelState":
        return replace(self, **kw)

    def in_neighbors(self, users: DataFrame) -> DataFrame:
        """K7: from the kept reverse lists where the state has a store, else by a scan of the lists."""
        if self.store is None:
            return K.in_neighbors_of(self.neighbors, users)
        return self.store.in_neighbors(self.version, users)


def build_state(p: Purchases, params: HyperParams = DEFAULT_PARAMS, k: int = DEFAULT_K,
                ordered: bool = False, num_blocks: int | None = None, measure: Measure = COSINE) -> ModelState:
    """The whole model. Interactions, embeddings and lists are written once: later steps read each of
    them several times."""
    I = materialize(EM.interactions(p))
    nnz, longest = K.row_stats(I)
    B = num_blocks if num_blocks is not None else K.choose_blocks(I.sparkSession, nnz)
    return ModelState(
        purchases=p,
        interactions=I,
        embeddings=materialize(EM.embeddings(p, params, ordered)),
        neighbors=materialize(K.build_neighbors(I, k, num_blocks=B, longest_row=longest, measure=measure)),
        norms=K.norms(I, measure),
        params=params, k=k, ordered=ordered, num_blocks=B, measure=measure,
    )
