"""trolley: next-basket recommendation, neighbour tables and unlearning as Spark jobs.

Sub-packages:
  sources/    table loading, parquet-by-path SQL, versioned state store, index save/load
  functions/  Column-expression factories (cosine, decay weights, rounding, keyed deltas)
  operators/  set-oriented operators: relational, embeddings, similarity, graph,
              recommendation, differences, unlearning
  plans/      whole-model state, the query catalogue used by ``__spark_entry__``
  streaming/  deletion-request and change-log streams, foreachBatch maintenance, keyed state
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
