import __spark_entry__ as entry


def test_queries_and_sql_have_the_same_names(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "bm25_topk" in names


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "passage_id", "score", "rank"] and out.count() == 400


def test_top_k_plan_has_no_cartesian_product_of_texts(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan
