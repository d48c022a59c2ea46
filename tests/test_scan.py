"""Scans of small repositories, with outcomes worked out by hand."""

import json
import os
import subprocess
import time
from types import SimpleNamespace

import pytest
import yaml
from pyspark.sql import functions as F

from quarryline import cli
from quarryline.functions.text import excluded_names, listed
from quarryline.operators import graph, impact, ownership, report, scores
from quarryline.plans import scan
from quarryline.sources import repository

TREE = {
    "shop/dbt_project.yml": "name: shop\nmodel-paths: [models]\n",
    "shop/models/_sources.yml": "sources: [{name: raw, tables: [{name: items, description: all items, meta: {owner: feed}}]}]\n",
    "shop/models/schema.yml": "models:\n  - {name: stg_items, description: staged, columns: [{name: id, tests: [not_null], data_type: int}]}\n  - {name: fct_sales, columns: [{name: id, tests: [not_null]}]}\n",
    "shop/models/staging/stg_items.sql": "select id from {{ source('raw', 'items') }} where id > 0 limit 5",
    "shop/models/marts/fct_sales.sql": "with items as (select * from {{ ref('stg_items') }}) select * from items join {{ source('raw', 'days') }} d on 1 = 1",
    "adhoc/one.sql": "/* what it does */ create table sums (id int) ; insert into sums select id from fct_sales",
    "adhoc/two.sql": "select * from sums",
    "flows/daily.py": "from airflow import DAG\ndag = DAG('daily')\na = AOperator(task_id='a')\nb = BOperator(task_id='b')\na >> b\n",
    "jobs/load.py": "from pyspark.sql import SparkSession\ndf = spark.table('in')\ndf.write.saveAsTable('out')\n",
    "jobs/broken.py": "import spark.read (\n",
    "contract.yaml": "dataContractSpecification: 1\ndataset: {name: SUMS, schema: [{name: id, type: bigint}]}\n",
    "target/skipped.sql": "select 1 from nowhere",
    ".hidden/x.sql": "select 1 from nowhere",
    "notes.txt": "nothing",
    "CODEOWNERS": "adhoc/* @adhoc\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo") / "company"
    for path, content in TREE.items():
        full = top / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(content)
    os.symlink(top / "adhoc", top / "linked")
    git = lambda *x, **e: subprocess.run(["git", "-C", str(top), "-c", "user.name=Ann", "-c", "user.email=a@b", *x], check=True, capture_output=True, env=os.environ | e)
    git("init", "-q")
    git("add", "shop", "adhoc", "CODEOWNERS")
    git("commit", "-qm", "one", GIT_AUTHOR_DATE="2024-01-01T00:00:00Z", GIT_COMMITTER_DATE="2024-01-01T00:00:00Z")
    git("add", ".")
    git("commit", "-qm", "two")
    return str(top)


@pytest.fixture(scope="module")
def found(spark, root):
    return scan.extracted(repository.files(spark, root, "Target"), None, "company")


def test_walk(spark, root):
    paths = list(repository.walk(root, ["target"]))
    assert paths == sorted(paths, key=lambda p: (p.count("/") > 0, p)) or set(paths) == {p for p in TREE if not p.startswith((".", "target"))}
    assert set(paths) == {p for p in TREE if not p.startswith((".", "target"))}
    assert {r.path for r in repository.files(spark, root + "/none").collect()} == set()
    assert excluded_names(" A, b;;c ") == ["a", "b", "c"] and excluded_names(None) == []
    assert listed(None, ("x",)) == ("x",) and listed("", ("x",)) == () and listed("b, a") == ("a", "b")


def test_assets(found):
    rows = {r.name: r for r in found.assets.collect()}
    assert set(rows) == {"raw.items", "raw.days", "stg_items", "fct_sales", "sums", "adhoc/two.sql#select0", "daily", "daily.a", "daily.b", "in", "out"}
    assert [r.name for r in found.assets.orderBy("ord").collect()][:4] == ["raw.items", "fct_sales", "raw.days", "stg_items"]
    assert (rows["raw.items"].owner, rows["raw.items"].has_docs, rows["raw.items"].file_path) == ("feed", True, "shop/models/_sources.yml")
    assert rows["raw.days"].tags == {"project": "shop", "defined_from": "source_call"}
    assert (rows["stg_items"].columns, rows["stg_items"].column_types, rows["stg_items"].tags["test_richness"], rows["stg_items"].has_tests) == (["id"], {"id": "int"}, "low", True)
    assert (rows["sums"].asset_type, rows["sums"].has_docs, rows["sums"].columns) == ("table", True, ["id"])
    assert rows["out"].tags == {"spark_role": "write"} and rows["in"].tags == {"spark_role": "read"}
    assert rows["daily.b"].tags == {"dag_id": "daily", "operator": "BOperator"}


def test_edges(found):
    assert {(r.source, r.target) for r in found.edges.collect()} == {
        ("raw.items", "stg_items"), ("stg_items", "fct_sales"), ("raw.days", "fct_sales"), ("items", "fct_sales"), ("fct_sales", "sums"), ("sums", "adhoc/two.sql#select0"),
        ("daily", "daily.a"), ("daily", "daily.b"), ("daily.a", "daily.b"), ("in", "out"),
    }
    assert [(r.file_path, r.dataset, r.columns) for r in found.contracts.collect()] == [("contract.yaml", "SUMS", {"id": "bigint"})]
    assert found.warnings.count() == 0


@pytest.fixture(scope="module")
def made(spark, root, found):
    rules = ownership.rules(spark.createDataFrame([(repository.owner_rules_text(root)[0],)], "content string"))
    return scan.analyzed(found, rules, repository.commits(spark, root), F.current_timestamp())


def test_analysis(made):
    rows = {(r.category, r.asset_name): r for r in made.findings.collect()}
    by = lambda category: {name for c, name in rows if c == category}
    assert by("dead_asset") == {"adhoc/two.sql#select0", "daily.b", "out"} and by("missing_test") == set()
    assert rows["dead_asset", "adhoc/two.sql#select0"].message.endswith("=10") and rows["dead_asset", "adhoc/two.sql#select0"].severity == "info"
    assert by("weak_test_coverage") == {"fct_sales"} and by("no_owner") == set()
    assert by("missing_documentation") == {"fct_sales", "raw.days", "daily", "daily.a", "daily.b", "in", "out"}
    assert by("stale_asset") == {"raw.items", "raw.days", "stg_items", "fct_sales", "sums"}
    assert rows["stale_asset", "sums"].message.endswith("(2024-01-01)") and rows["stale_asset", "sums"].file_path == "adhoc/one.sql"
    assert not any(c.startswith("contract") for c, _ in rows)
    assert by("cost_hotspot") == {"fct_sales"} and "SELECT_STAR, SELECT_WITHOUT_WHERE, NO_LIMIT (downstream nodes: 2, weighted impact: 3.72)" in rows["cost_hotspot", "fct_sales"].message
    scored = {r.dimension: r.score for r in made.scores.collect()}
    assert (scored["dead_assets"], scored["test_coverage"], scored["documentation"], scored["ownership"], scored["contracts"]) == (73, 100, 30, 100, 100)


def test_command_line(root, found, made, capsys, monkeypatch):
    monkeypatch.setattr(cli, "run", lambda *x: (found, made))
    assert cli.main(["scan", root, "--format", "json", "--exclude", "target"]) == 0
    data = json.loads(capsys.readouterr().out)
    assert (data["discovered_file_count"], data["parsed_sql_file_count"], data["parsed_airflow_file_count"], data["parsed_spark_file_count"], data["parsed_dbt_project_count"]) == (11, 2, 1, 2, 1)
    assert len(data["assets"]) == 11 and len(data["edges"]) == 10 and data["graph"] == {"node_count": 12, "edge_count": 10, "is_directed_acyclic": True}
    assert data["analytics"]["critical_path"] == ["raw.items", "stg_items", "fct_sales", "sums", "adhoc/two.sql#select0"] and list(data["scores"]) == cli.DIMENSIONS
    assert len(os.listdir(os.path.join(root, ".quarryline", "snapshots"))) == 2
    monkeypatch.setenv("GITHUB_ACTIONS", "true")
    assert cli.main(["ci", "--path", root, "--exclude", "target", "--threshold", "100"]) == 1
    out = capsys.readouterr().out
    assert "::warning title=" in out and "Findings" in out
    with pytest.raises(SystemExit):
        cli.main(["scan", root, "--format", "xml"])


def test_diff(spark, root, capsys, monkeypatch):
    """Which side has what; a scan is stood for by the names of SQL files, a finding for each."""

    def listed(spark, path, *more):
        names = [p for p in repository.walk(path, ["target"]) if p.endswith(".sql")]
        assets = spark.createDataFrame([(x,) for x in names], "name string")
        findings = assets.selectExpr("'info' severity", "'c' category", "name asset_name", "'m' message", "'f' file_path")
        return SimpleNamespace(assets=assets), SimpleNamespace(findings=findings)

    monkeypatch.setattr(cli, "run", listed)
    with open(os.path.join(root, "adhoc", "three.sql"), "w") as f:
        f.write("create view fresh as select a from sums")
    os.rename(os.path.join(root, "adhoc", "two.sql"), os.path.join(root, "two.txt"))
    try:
        assert cli.main(["diff", "HEAD", "--path", os.path.join(root, "adhoc")]) == 0
    finally:
        os.remove(os.path.join(root, "adhoc", "three.sql"))
        os.rename(os.path.join(root, "two.txt"), os.path.join(root, "adhoc", "two.sql"))
    out = capsys.readouterr().out
    assert "assets added: 1\n  three.sql" in out and "assets removed: 1\n  two.sql" in out and "findings added: 1\n  info  c  three.sql  m" in out
    assert cli.main(["diff", "no-such-ref", "--path", root]) == 2
    assert len(subprocess.run(["git", "-C", root, "worktree", "list"], capture_output=True, text=True).stdout.splitlines()) == 1


def test_whole_commands(root, made, capsys):
    """scan and diff with nothing stood in for."""
    assert cli.main(["scan", root, "--format", "json", "--exclude", "target", "--dead-asset-whitelist", "daily.b"]) == 0
    data = json.loads(capsys.readouterr().out)
    want = {tuple(r) for r in made.findings.select(*scan.FINDING).collect() if (r.category, r.asset_name) != ("dead_asset", "daily.b")}
    assert {tuple(x[c] for c in scan.FINDING) for x in data["findings"]} == want
    assert data["scores"]["dead_assets"] == 82 and "parse_warnings" not in data
    with open(os.path.join(root, "adhoc", "three.sql"), "w") as f:
        f.write("create view fresh as select a from sums limit 1")
    try:
        assert cli.main(["diff", "HEAD", "--path", root, "--exclude", "target"]) == 0
    finally:
        os.remove(os.path.join(root, "adhoc", "three.sql"))
    out = capsys.readouterr().out
    assert "assets added: 1\n  fresh\n" in out and "assets removed: 0" in out and "dead_asset  fresh" in out


def test_action(tmp_path):
    """The step that scans, with the interpreter stood for by echo."""
    with open(os.path.join(os.path.dirname(__file__), "..", "action.yml")) as f:
        action = yaml.safe_load(f)
    assert {k: v["default"] for k, v in action["inputs"].items()} == {"path": ".", "threshold": "0", "dialect": "", "exclude": ""}
    (tmp_path / "python").write_text('#!/bin/sh\nfor x; do echo "<$x>"; done\n')
    (tmp_path / "python").chmod(0o755)
    said = lambda **env: subprocess.run(["bash", "-ec", action["runs"]["steps"][-1]["run"]], env=env | {"PATH": f"{tmp_path}:{os.environ['PATH']}"}, capture_output=True, text=True, check=True).stdout.split("\n")[2:-1]
    assert said(AT="a b", LEAST="70", DIALECT="", EXCLUDE="") == ["<ci>", "<--path>", "<a b>", "<--threshold>", "<70>"]
    assert said(AT=".", LEAST="0", DIALECT="x", EXCLUDE="a, b")[5:] == ["<--dialect>", "<x>", "<--exclude>", "<a, b>"]


def test_reports(tmp_path, monkeypatch):
    path = str(tmp_path / "h.jsonl")
    (tmp_path / "h.jsonl").write_text("broken\n3\n")
    for i in range(35):
        kept = report.append_history(path, {"overall": i})
    assert [x["overall"] for x in kept] == list(range(5, 35)) and len((tmp_path / "h.jsonl").read_text().splitlines()) == 30
    folder = tmp_path / "snaps"
    folder.mkdir()
    for name in ("2020-01-01.json", "2020-01-01T000000.json"):
        (folder / name).write_text("{}")
        os.utime(folder / name, (time.time() - 99 * 86_400,) * 2)
    assert report.write_snapshot(str(folder), {"a": 1}).endswith(".json")
    assert "2020-01-01.json" in os.listdir(folder) and "2020-01-01T000000.json" not in os.listdir(folder)
    assert report.write_snapshot("/proc/none", {}) is None
    for text, days in (("7", 7), ("x", 30), ("-3", 0)):
        monkeypatch.setenv(report.RETENTION, text)
        assert report.retention() == days
    payload = {"scan_root": "<r>", "scores": {"complexity": 10, "ownership": 70}, "findings": [{"severity": "info", "category": "c", "asset_name": "<a>", "message": "m"}], "edges": [{"source": "a", "target": "b"}], "assets": [], "graph": {}, "discovered_file_count": 1}
    page = report.page(payload, [{"id": "a", "type": "t", "file": "", "importance": 1}], [{"overall": 5}], 80)
    assert "&lt;a&gt;" in page and '<div class="card good"><b>10</b>complexity' in page and '<div class="card warn"><b>70</b>' in page
    assert "a -> b" in report.terminal(payload, 80)


def test_patterns(spark):
    cases = {
        ("*.sql", "a/b/c.sql"): True, ("/c.sql", "a/c.sql"): True, ("a/*.sql", "a/b/c.sql"): False, ("a/**/c.sql", "a/c.sql"): True, ("a/**/c.sql", "a/x/y/c.sql"): True,
        ("a/**", "a"): True, ("a/**", "b/a"): False, ("**/c.sql", "c.sql"): True, ("a/", "a/b"): False, ("a/b", "a/b/c"): False, ("a?.sql", "x/ab.sql"): True, ("[!a].sql", "b.sql"): True,
        ("[!a].sql", "a.sql"): False, ("a.sql", "abxsql"): False, ("**", "x"): True, ("a\\b", "a/b"): True, ("a+(b)", "a+(b)"): True,
    }
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "pattern string, path string, want boolean")
    got = rows.select("pattern", "path", "want", F.coalesce(F.regexp_like("path", ownership.as_regex(F.col("pattern"))), F.lit(False)).alias("got")).collect()
    assert [(r.pattern, r.path) for r in got if r.got != r.want] == []


def test_empty_and_cyclic(spark):
    nothing = spark.createDataFrame([], "source string, target string")
    names = spark.createDataFrame([("a",)], "name string")
    assert graph.critical_path(nothing) == [] and graph.cycles(nothing).count() == 0
    assert graph.summary(names, nothing).collect()[0] == (1, 0, True)
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("b", "d")], "source string, target string")
    assert sorted(r.cycle for r in graph.cycles(loop).collect()) == [["a", "b"], ["c"]] and graph.critical_path(loop) == []
    assert not impact.is_dag(loop).collect()[0].is_dag
    whole = graph.analytics(names, loop, 1)
    assert (whole["dead_assets"], whole["cycle_count"], whole["high_fanout"]) == (["d"], 2, [{"asset": "b", "out_degree": 2}])
    assert scan.discovered(spark.createDataFrame([("m.yml", "x: 1"), ("n.txt", None)], "path string, content string")).count() == 0
    assert scores.coverage(spark.createDataFrame([], "has_tests boolean"), "has_tests").collect()[0].score == 100


def test_errors_are_warnings(spark):
    def read(path, content):
        raise ValueError("no")

    from quarryline.functions import extract

    row = extract.facts(spark.createDataFrame([("p", "x")], "path string, content string"), read, "struct<a:int>").collect()[0]
    assert (row.facts, row.warning) == ([], "p: skipped (ValueError: no)")
