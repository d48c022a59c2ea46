from quarryline.operators import impact, scores


def test_scopes(spark):
    rows = [("m", "dbt_model", None), ("s", "dbt_source", {"role": "query_block"}), ("d", "airflow_dag", {"role": "x"}), ("t", "airflow_task", {}), ("j", "spark_job", {"role": None}), ("v", "view", {"a": "b"})]
    assets = spark.createDataFrame(rows, "name string, asset_type string, tags map<string,string>")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(scores.test_scope(assets)) == ["m"]
    assert names(scores.test_scope(assets.where("name <> 'm'"))) == ["v"]
    assert names(scores.test_scope(assets.limit(0))) == []
    assert names(scores.doc_scope(assets)) == ["d", "j", "m", "t", "v"]


def test_dead_findings_leave_out(spark):
    tags = {"plain": {"team": "x"}, "none": None, "shown": {"kind": "Main_Dashboard"}, "sent": {"EXPORTED": None}, "listed": {}, "up": {}}
    assets = spark.createDataFrame(list(tags.items()), "name string, tags map<string,string>")
    edges = spark.createDataFrame([("up", x) for x in [*tags, "outside"] if x != "up"], "source string, target string")
    columns = spark.createDataFrame([("up", 2)], "name string, n_columns int")
    found = lambda *x, **y: sorted(r.asset_name for r in impact.dead_findings(assets, edges, columns, *x, **y).collect())
    assert found(whitelist=["listed"]) == ["none", "plain"]
    assert found(markers=()) == ["listed", "none", "plain", "sent", "shown"]
    assert [r.score for r in impact.dead_score(assets, impact.dead_findings(assets, edges, columns)).collect()] == [50]
    assert [r.score for r in impact.dead_score(assets.limit(0), columns.limit(0)).collect()] == [100]
