"""A scan: files become assets, edges and contracts, these become findings and scores.

Each file is read by Python once, for its type; everything after is joins and
aggregations. Order, where the outcome depends on it, is a column: template projects first, then
files by path, then the place in a file."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import extract, text
from quarryline.operators import contracts as contract_ops
from quarryline.operators import cost, graph, impact, ownership, scores
from quarryline.operators.graph import checkpointed

ASSET = "name string, asset_type string, file_path string, columns array<string>, column_types map<string,string>, has_tests boolean, has_docs boolean, owner string, description string, tags map<string,string>"
ASSET_COLUMNS = [x.split()[0] for x in ASSET.split(", ")]
FINDING = ["severity", "category", "asset_name", "message", "file_path"]
TYPES = dict(x.split(" ", 1) for x in ASSET.split(", "))
PARSED = ("sql", "dbt_model", "dbt_schema", "airflow_dag", "spark_job")


class Extracted(NamedTuple):
    """files(path, content, file_type), projects(root, project), assets, edges(source, target, ord), contracts, statements (facts
    of SQL files' raw text), warnings(warning)."""

    files: DataFrame
    projects: DataFrame
    assets: DataFrame
    edges: DataFrame
    contracts: DataFrame
    statements: DataFrame
    warnings: DataFrame


def place(first: int, root: Column | str, group: int, path: Column, at: Column | int) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    at = F.lit(at) if isinstance(at, int) else at
    return F.struct(F.lit(first).alias("a"), root.alias("b"), F.lit(group).alias("c"), path.alias("d"), at.cast("int").alias("e")).alias("ord")


def as_assets(rows: DataFrame, order: Column) -> DataFrame:
    """rows with some of an asset's columns, the others as empty as their kind allows."""
    empty = {"columns": F.expr("cast(array() as array<string>)"), "column_types": F.expr("cast(map() as map<string,string>)"), "tags": F.expr("cast(map() as map<string,string>)"), "has_tests": F.lit(False), "has_docs": F.lit(False)}
    pick = lambda c: F.col(c) if c in rows.columns else empty.get(c, F.lit(None))
    return rows.select(*(pick(c).cast(TYPES[c]).alias(c) for c in ASSET_COLUMNS), order)


def discovered(tree: DataFrame) -> DataFrame:
    """tree(path, content) with file_type; what has none is left out."""
    return tree.withColumn("file_type", text.file_type(F.col("path"), F.coalesce("content", F.lit("")))).where("file_type is not null")


def found_projects(tree: DataFrame, top: str) -> DataFrame:
    """root, project, model_path (from the scanned root), mp_at: a row for each model path of each project."""
    files = tree.where((F.col("path") == "dbt_project.yml") | F.col("path").endswith("/dbt_project.yml"))
    root = F.element_at(text.folders(F.col("path")), -1)
    name = F.coalesce(F.col("s.name"), F.when(F.col("root") == "", F.lit(top)).otherwise(F.element_at(F.split("root", "/"), -1)))
    each = extract.project_facts(files).select(root.alias("root"), F.explode("facts").alias("s")).select("root", name.alias("project"), "s.model_paths")
    clean = F.regexp_replace("mp", r"^(?:\./)+|/+$", "")
    full = F.when(clean.isin("", "."), F.col("root")).otherwise(F.concat_ws("/", F.nullif("root", F.lit("")), clean))
    return each.select("root", "project", F.posexplode_outer("model_paths").alias("mp_at", "mp")).select("root", "project", full.alias("model_path"), "mp_at")


def in_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """files under a model path of a project, with root, project and mp_at: an equality join on each of a path's folders."""
    each = files.withColumn("model_path", F.explode(text.folders(F.col("path"))))
    return each.join(projects.where("model_path is not null"), "model_path").drop("model_path")


def merged_meta(entries: DataFrame) -> DataFrame:
    """entries(root, ord, s: facts of a model) to one row a root and name: flags of any, the last description, owner and key said,
    columns in order of first mention, the last type of a column, test richness of the last entry."""
    rows = entries.select("root", F.col("s.name").alias("name"), "ord", "s")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c.split(".")[1])
    whole = rows.groupBy("root", "name").agg(
        F.bool_or("s.has_docs").alias("has_docs"), F.bool_or("s.has_tests").alias("has_tests"), last("s.description"), last("s.owner"), last("s.partition_key"),
        F.max_by("s.tests", "ord").alias("tests"), F.array_sort(F.collect_list(F.struct("ord", "s.columns", F.map_entries("s.types").alias("types")))).alias("all"),
    )
    typed = F.flatten(F.transform("all", lambda x: x["types"]))
    names = F.array_distinct(F.transform(typed, lambda e: e["key"]))
    types = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(typed, lambda e: e["key"] == k), -1)["value"]))
    return whole.select("root", "name", "has_docs", "has_tests", "description", "owner", "partition_key", impact.richness(F.col("tests")).alias("richness"), F.array_distinct(F.flatten(F.transform("all", lambda x: x["columns"]))).alias("columns"), types.alias("column_types"))


def tags(**pairs: Column) -> Column:
    """A map of those that aren't null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def source_assets(entries: DataFrame, path: Column, order: Column) -> DataFrame:
    rows = entries.select("s.*", path.alias("file_path"), order).withColumn("asset_type", F.lit("dbt_source")).withColumn("tags", tags(partition_key=F.col("partition_key")))
    return as_assets(rows.withColumnRenamed("types", "column_types"), F.col("ord"))


def models(files: DataFrame, meta: DataFrame | None, declared: DataFrame | None, first: int) -> tuple[DataFrame, DataFrame]:
    """Assets and edges of model files(path, content, root, project, mp_at): the models, and sources that only they name."""
    rows = files.withColumns({"name": text.stem(F.col("path")), "at": place(first, F.col("root"), 1, F.col("path"), F.col("mp_at"))})
    tables = extract.model_tables(files.select("path", "content").distinct())
    known = rows if meta is None else rows.join(meta, ["root", "name"], "left")
    richness = F.coalesce("richness", F.lit("ok")) if meta is not None else F.lit("ok")
    key = F.col("partition_key") if meta is not None else F.lit(None)
    made = known.withColumns({"asset_type": F.lit("dbt_model"), "file_path": F.col("path"), "tags": tags(project=F.col("project"), test_richness=richness, partition_key=key)})
    made = made.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_docs", "has_tests") if c in made.columns} | {c: F.coalesce(c, F.expr(f"cast({e} as {TYPES[c]})")) for c, e in (("columns", "array()"), ("column_types", "map()")) if c in made.columns})
    assets = as_assets(made.withColumn("ord", F.col("at")), F.col("ord"))
    named = rows.select("root", "project", "path", "at", F.explode(text.sources(F.col("content"))).alias("name"))
    if declared is not None:
        named = named.join(declared.select("root", "name"), ["root", "name"], "left_anti")
    scope = ["root", "name"] if meta is not None else ["path", "name"]
    called = named.groupBy(*scope).agg(F.min_by(F.struct("project", F.col("path").alias("file_path"), "at"), "at").alias("x")).select("name", "x.*")
    called = called.withColumns({"asset_type": F.lit("dbt_source"), "tags": tags(project=F.col("project"), defined_from=F.lit("source_call")), "ord": F.col("at")})
    reads = rows.join(tables, "path", "left").select("name", "at", F.concat(text.refs(F.col("content")), text.sources(F.col("content")), F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda t: t != F.col("name"))).alias("up"))
    edges = reads.select(F.explode("up").alias("source"), F.col("name").alias("target"), F.col("at").alias("ord"))
    return assets.unionByName(as_assets(called, F.col("ord"))), edges


def extracted(tree: DataFrame, dialect: str | None = None, top: str = "root") -> Extracted:
    """tree(path, content): paths from the scanned root, whose name is ``top``."""
    tree = checkpointed(tree)
    files = checkpointed(discovered(tree))
    projects = checkpointed(found_projects(tree, top))
    of = lambda *kinds: files.where(F.col("file_type").isin(*kinds))
    union = lambda parts: reduce(DataFrame.unionByName, parts)

    # template projects
    is_sql = F.lower("path").endswith(".sql")
    is_yaml = F.col("path").endswith(".yml") | F.col("path").endswith(".yaml")
    described = extract.schema_facts(tree.where(is_yaml & F.col("content").isNotNull()))
    described = checkpointed(described)
    within = in_projects(described.select("path", "facts"), projects).select("root", "path", "mp_at", F.explode("facts").alias("s"))
    entries = within.withColumn("ord", place(0, F.col("root"), 0, F.col("path"), F.col("mp_at") * 1_000_000 + F.col("s.at")))
    meta = merged_meta(entries.where("s.kind = 'model'"))
    declared = graph.last_per_key(entries.where("s.kind = 'source'").withColumn("name", F.col("s.name")), ["root", "name"])
    model_files = in_projects(tree.where(is_sql & F.col("content").isNotNull()), projects)
    project_assets, project_edges = models(model_files, meta, declared, 0)

    # files outside of projects
    roots = projects.select(F.col("root").alias("folder")).distinct()
    outside = of("dbt_model", "dbt_schema").withColumn("folder", F.explode(text.folders(F.col("path")))).join(roots, "folder", "left_semi").select("path").distinct()
    alone = lambda kind: of(kind).join(outside, "path", "left_anti")
    single = alone("dbt_model").select("path", "content", F.lit("").alias("root"), F.lit("unknown").alias("project"), F.lit(0).alias("mp_at"))
    single_assets, single_edges = models(single, None, None, 1)
    schema_rows = described.join(alone("dbt_schema").select("path"), "path", "left_semi").select("path", F.explode("facts").alias("s")).where("s.kind = 'source'")
    schema_rows = graph.last_per_key(schema_rows.withColumns({"name": F.col("s.name"), "ord": F.col("s.at")}), ["path", "name"])
    loose = source_assets(schema_rows.drop("ord"), F.element_at(F.split("path", "/"), -1), place(1, "", 0, F.col("path"), F.col("s.at")))

    sql = of("sql")
    statements = checkpointed(extract.sql_statements(tree.where(is_sql & F.col("content").isNotNull()), dialect))
    plain = statements.join(sql.select("path"), "path", "left_semi")
    in_file = lambda at="at": place(1, "", 1, F.col("file_path"), F.col(at))
    sql_rows = as_assets(extract.sql_assets(sql, plain).withColumn("ord", in_file()), F.col("ord"))
    sql_edges = extract.sql_edges(plain).select("source", "target", in_file())

    flows = checkpointed(extract.airflow_facts(of("airflow_dag")))
    flow = flows.select(F.col("path").alias("file_path"), F.explode("facts").alias("s"))
    dags = flow.select("file_path", F.posexplode("s.dags").alias("at", "d")).select("file_path", "at", F.col("d.dag").alias("name"), "d.has_docs", F.lit("airflow_dag").alias("asset_type"))
    tasks = flow.select("file_path", F.posexplode("s.tasks").alias("at", "t")).select(
        "file_path", (F.col("at") + 1_000_000).alias("at"), F.concat_ws(".", "t.dag", "t.task").alias("name"), F.lit("airflow_task").alias("asset_type"), tags(dag_id=F.col("t.dag"), operator=F.col("t.operator"), sql=F.nullif("t.sql", F.lit(""))).alias("tags")
    )
    flow_edges = flow.select("file_path", F.posexplode("s.edges").alias("at", "e")).select("e.source", "e.target", in_file())

    jobs = checkpointed(extract.spark_facts(of("spark_job")))
    job = jobs.select(F.col("path").alias("file_path"), F.explode("facts").alias("s"))
    touched = job.select("file_path", "s.has_docs", "s.writes", F.posexplode(F.array_sort(F.array_union("s.reads", "s.writes"))).alias("at", "name"))
    touched = touched.withColumns({"asset_type": F.lit("table"), "tags": tags(spark_role=F.when(F.array_contains("writes", F.col("name")), "write").otherwise("read"))})
    job_edges = extract.spark_edges(jobs).select("source", "target", in_file())

    assets = union([source_assets(declared.drop("name"), F.col("path"), F.col("ord")), project_assets, single_assets, loose, sql_rows, *(as_assets(x.withColumn("ord", in_file()), F.col("ord")) for x in (dags, tasks, touched))])
    edges = graph.first_per_key(union([project_edges, single_edges, sql_edges, flow_edges, job_edges]), ["source", "target"])
    agreed = extract.contract_facts(of("data_contract"))
    agreed = checkpointed(agreed)
    contracts = agreed.select(F.col("path").alias("file_path"), F.explode("facts").alias("s")).select("file_path", "s.dataset", "s.columns", F.struct("file_path", "s.at").alias("ord"))
    warnings = union([x.select("warning") for x in (described, statements, flows, jobs, agreed)]).where("warning is not null")
    return Extracted(files, projects, checkpointed(assets), checkpointed(edges), checkpointed(contracts), statements, warnings)


class Analysis(NamedTuple):
    """findings (with analyzer, the place of their analyzer), scores(dimension, score), and each analyzer's own rows."""

    findings: DataFrame
    scores: DataFrame
    details: dict[str, DataFrame]


def analyzed(found: Extracted, rules: DataFrame, commits: DataFrame, as_of: Column, prefix: str = "", whitelist=(), markers=impact.TERMINAL, critical: int = 10) -> Analysis:
    """rules: as of ownership.rules(); commits(path, author, at)."""
    assets, edges = found.assets, found.edges
    names = assets.select("name").distinct()
    in_scope = checkpointed(scores.doc_scope(assets))
    degrees = checkpointed(graph.degrees(names, edges))
    path_of = assets.groupBy(F.col("name").alias("asset_name")).agg(F.max_by("file_path", "ord").alias("file_path"))
    with_path = lambda df: df.join(path_of, "asset_name", "left").select(*FINDING)

    columns = graph.last_per_key(assets, ["name"]).select("name", F.size("columns").alias("n_columns"))
    dead = checkpointed(impact.dead_findings(graph.last_per_key(assets, ["name"]), edges, columns, markers, whitelist))
    tested = checkpointed(scores.test_scope(assets))
    features = extract.features(found.statements)
    sql = in_scope.join(features.withColumnRenamed("path", "file_path"), "file_path", "left")
    counts = sql.where(F.lower("file_path").endswith(".sql")).groupBy("name").agg(F.max("total").alias("sql"))
    complex_ = checkpointed(impact.complexity(in_scope, edges, counts))
    complexity_scores = impact.complexity_summary(complex_)
    owners = checkpointed(ownership.resolved(in_scope, rules, commits, prefix))
    stale = impact.stale(owners.where("at is not null").select(F.col("name").alias("asset_name"), "at"), as_of)
    drifted = checkpointed(contract_ops.drift(contract_ops.matched(found.contracts, in_scope)))
    hot = cost.hotspots(in_scope, extract.cost_patterns(found.statements), extract.missing_partition_filters(found.statements, cost.partition_keys(assets)), graph.descendant_counts(edges))
    hot = checkpointed(hot)
    parts = [
        with_path(dead), with_path(scores.missing_tests(tested, degrees)), with_path(scores.weak_tests(tested)), with_path(scores.missing_docs(in_scope).withColumn("message", F.lit(scores.NO_DOCS))),
        with_path(impact.complexity_findings(complex_)), with_path(ownership.unowned(owners)), with_path(stale), contract_ops.findings(drifted), cost.findings(hot),
    ]
    analyzer = [0, 1, 1, 2, 3, 4, 4, 5, 6]
    findings = reduce(DataFrame.unionByName, (p.withColumn("analyzer", F.lit(n)) for p, n in zip(parts, analyzer, strict=True)))
    details = {
        "dead_assets": dead, "test_coverage": scores.coverage(tested, "has_tests"), "documentation": scores.coverage(in_scope, "has_docs"), "complexity": complexity_scores, "complexity_rows": complex_,
        "ownership": ownership.summary(owners, stale), "contracts": contract_ops.summary(drifted), "cost_hotspots": cost.summary(hot), "cost_rows": hot,
    }
    given = {**{k: details[k] for k in ("test_coverage", "documentation", "complexity", "ownership", "contracts", "cost_hotspots")}, "dead_assets": impact.dead_score(assets, dead)}
    scored = reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("dimension"), F.col("score").cast("int").alias("score")) for k, df in given.items()))
    return Analysis(checkpointed(findings), checkpointed(scored), details)
