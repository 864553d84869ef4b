"""The pipeline against its stages' brute-force rules on the smoke tables, and the registered queries' shapes."""

import importlib.util

import corpus_pipeline as P
from trolley.llm.queries import QUERIES, SQL

SMOKE = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMOKE)
        assert docs.columns == columns, name
        path = f"{P.checkpoint_root(spark)}/test-{name.replace(' ', '-')}-{P.uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= seen, name
        seen = docs.count()
    last = {tuple(r) for r in P.STAGES[-1][1](spark, docs, SMOKE).collect()}
    assert last == {tuple(r) for r in P.run(spark, SMOKE).collect()} and len(last) == seen


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and 4 <= len(P.STAGES) <= 5
    import __spark_entry__ as E
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert importlib.util.find_spec("corpus_pipeline")


def test_queries_match_their_sql(spark):
    import duckdb

    from scripts.check_oracle import digest
    duck = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMOKE}/{name}.parquet')")
    for name, sql in SQL.items():
        df = QUERIES[name](spark, SMOKE)
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, found.fetchall())[0], name
