"""Readers of SQL, Python and YAML text."""

from quarryline.functions import pyfacts, yamlfacts
from quarryline.functions.sqlfacts import sql_facts


def one(text, **more):
    (found,) = sql_facts(text, **more)
    return found


def test_create_targets_columns_and_sources():
    s = one("""CREATE OR REPLACE TABLE db."T x" (id INTEGER NOT NULL, v varchar(10), p decimal(10,2) DEFAULT 0, PRIMARY KEY (id))""")
    assert (s["target"], s["target_kind"], s["columns"]) == ("db.T x", "table", ["id", "v", "p"])
    assert s["types"] == {"id": "INT", "v": "VARCHAR(10)", "p": "DECIMAL(10, 2)"} and s["sources"] == []
    s = one("create materialized view v as select * from a join `b`.c using (id)")
    assert (s["target"], s["target_kind"], s["sources"], s["joins"]) == ("v", "view", ["a", "b.c"], 1)
    assert one("create table t as select * from t join u on 1=1")["sources"] == ["u"]
    assert one("create index i on t (a)")["target"] is None


def test_inserts_selects_and_others():
    assert [(s["kind"], s["target"], s["sources"]) for s in sql_facts("insert into x.y (a) select a from s1, s2; with c as (select 1) insert into q select * from c; ; select 1")] == [
        ("insert", "x.y", ["s1", "s2"]), ("insert", "q", ["c"]), ("select", None, []),
    ]
    assert [s["idx"] for s in sql_facts("select 1;; select 2")] == [0, 2]
    assert one("select a from t union select b from u")["kind"] == "union"
    assert one("merge into t using s on t.a = s.a when matched then delete")["sources"] == ["t", "s"]


def test_feature_counts():
    s = one("with a as (select * from x), b as (select 1) select case when q then 1 end from a join b on a.i=b.i left join (select 2) d on 1=1 cross join e where z in (select k from w) and exists (select 1 from v)")
    assert (s["joins"], s["subqueries"], s["ctes"], s["cases"], s["cross_join"], s["star"]) == (3, 2, 2, 1, True, True)
    assert s["sources"] == ["x", "a", "b", "e", "w", "v"]
    assert not one("select a * b, 2 * (3) from t")["star"] and one("select count(*) from t")["star"]
    assert one("select a from t where x is distinct from y")["sources"] == ["t"] and one("select extract(year from d) from t")["sources"] == ["t"]
    assert one("select a, b from t -- from u\n where c = 'from v; select' /* from w */")["sources"] == ["t"]


def test_text_that_is_no_sql():
    assert sql_facts("{% if x %} select 1 {% endif %}") == [] and sql_facts("") == [] and sql_facts(None) == []
    assert one("select * from {{ ref('x') }}")["sources"] == []
    assert one("{{ config(x=1) }} select * from t")["kind"] == ""  # a statement that begins with a value
    for text in ("((((", "select", "from", "create", "insert", ")))", "with a as", "update", "'open", "create table", "select ) from ( x"):
        sql_facts(text)


def test_where_columns_of_each_select():
    s = one("select * from a where a.ts > 1 and f(b.K) in (select z from c where d = 2)")
    assert [(x["tables"], x["where_columns"]) for x in s["selects"]] == [(["a", "c"], ["d", "k", "ts", "z"]), (["c"], ["d"])]


AIRFLOW = """
from airflow import DAG
with DAG(dag_id="d", doc_md=" notes ") as dag:
    a = BashOperator(task_id="a")
    b = PythonOperator(task_id="b")
    c = SqlOperator(task_id="c", sql="select 1")
    unassigned = 1
    BashOperator(task_id="lost")
    a >> [b] >> c
    c << a
    b.set_downstream([c])
other = DAG("e", doc="")
t = TaskGroup(task_id="g")
"""


def test_airflow():
    (found,) = pyfacts.airflow("x", AIRFLOW)
    assert found["dags"] == [{"dag": "d", "has_docs": True}, {"dag": "e", "has_docs": False}]
    assert [(t["dag"], t["task"], t["operator"], t["sql"]) for t in found["tasks"]] == [("d", "a", "BashOperator", ""), ("d", "b", "PythonOperator", ""), ("d", "c", "SqlOperator", "select 1"), ("e", "g", "TaskGroup", "")]
    assert [(e["source"], e["target"]) for e in found["edges"]][4:] == [("d.a", "d.b"), ("d.a", "d.c"), ("d.b", "d.c")]
    assert pyfacts.airflow("x", "def (") == [] and pyfacts.airflow("x", "1") == []


def test_spark_jobs():
    code = '"""Notes."""\nx = spark.read.format("csv").load("p").join(spark.table("t"))\nspark.sql("select * from u join v")\nx.write.mode("append").saveAsTable("w")\nx.write.parquet("t")\nspark.read.orc("no")\nspark.readStream.load("s")'
    (found,) = pyfacts.spark_job("x", code)
    assert found["has_docs"] and sorted(found["reads"]) == ["p", "s", "t", "u", "v"] and found["writes"] == ["w", "t"]
    assert pyfacts.spark_job("x", "print(1)") == [] and pyfacts.spark_job("x", "(") == []


def test_yaml():
    text = """
models:
  - {name: m, description: ' ', tests: [unique], meta: {owner: ' me ', partition_key: d},
     columns: [{name: a, tests: [not_null, {accepted_values: {}}], data_type: int}, {name: b, description: x}, {no: name}, 3]}
  - {no: name}
sources: [{name: s, tables: [{name: t, description: '', columns: [{name: a, tests: [x]}]}, {}]}]
"""
    m, t = yamlfacts.schema_entries("x", text)
    assert (m["name"], m["description"], m["has_docs"], m["has_tests"], m["owner"], m["partition_key"]) == ("m", None, True, True, "me", "d")
    assert (m["columns"], m["types"], m["tests"]) == (["a", "b"], {"a": "int"}, ["unique", "not_null", "accepted_values"])
    assert (t["kind"], t["name"], t["has_docs"], t["has_tests"], t["description"]) == ("source", "s.t", False, True, "")
    assert yamlfacts.schema_entries("x", "a: [") == [] and yamlfacts.schema_entries("x", "3") == []
    assert yamlfacts.project("x", "model-paths: m") == [{"name": None, "model_paths": ["m"]}]


def test_contracts():
    new = "schema: [{physicalName: t, properties: [{name: a, logicalType: ' int ', physicalType: x}, {name: b, physicalType: y}, {name: c}, {}]}, {name: empty}]"
    assert yamlfacts.contracts("x", new) == [{"dataset": "t", "columns": {"a": "int", "b": "y", "c": None}, "at": 0}]
    old = "dataContractSpecification: 1\ndataset: {name: t, schema: [{name: a, dataType: int}, {logicalName: b}]}"
    assert yamlfacts.contracts("x", old) == [{"dataset": "t", "columns": {"a": "int", "b": None}, "at": 0}]
    assert yamlfacts.contracts("x", "dataset: {name: t}") == [] and yamlfacts.contracts("x", ":") == []
