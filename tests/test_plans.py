"""Plan checks: pushdown and pruning reach the scan, top-k uses WindowGroupLimit, no Cartesian
product, and the only Python in batch paths is the block-pair kernel."""

from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") \
        if hasattr(df._sc._jvm, "PythonSQLUtils") else plan(df)


def test_scan_prunes_columns(spark):
    from trolley.operators import relational as R
    from trolley.sources.purchases import load_purchases
    p = load_purchases(spark, SF_SMALL)
    text = formatted(R.category_buyers(p, "alcohol", 10, 25, 10))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string>" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cohorts_are_pruned_before_the_aggregate(spark):
    from trolley.operators import relational as R
    from trolley.sources.purchases import load_purchases
    p = load_purchases(spark, SF_SMALL)
    one = spark.createDataFrame([(1, 7)], "cohort_id long, user_id long")
    lines = R.top_aisles(p, one)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counting = next(i for i, x in enumerate(lines) if "Aggregate [user_id" in x and "aisle_id" in x)
    semi = next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    assert semi > counting      # deeper in the tree: runs first


def test_topk_uses_window_group_limit(spark):
    import __spark_entry__ as E
    df = E.queries()["sim_index"](spark, SF_SMALL)
    text = formatted(df)
    assert "WindowGroupLimit" in text
    assert "CartesianProduct" not in text


def test_recommendations_have_no_python_udf(spark):
    from trolley.operators import recommend as P
    from trolley.plans.state import build_state
    from trolley.sources.purchases import load_purchases
    st = build_state(load_purchases(spark, SF_SMALL), k=10)
    text = formatted(P.recommend(st.neighbors.checkpoint(), st.embeddings))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "WindowGroupLimit" in text


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["user_id", "item_id", "score", "rank"]
    assert df.count() > 0
