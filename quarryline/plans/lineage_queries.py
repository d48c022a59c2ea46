"""Queries over extraction, ownership, contracts, cost and reports: source text is made from keys of the
test tables, and SQL says from the keys alone what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import extract, text
from quarryline.operators import contracts, cost, graph, impact, ownership, report, scores
from quarryline.plans import catalog, scan
from quarryline.plans.catalog import DIM_EDGES, ROW_ASSETS, _t, dim_edges, dim_nodes, dim_sql, row_assets

#: Source text by key % 8, with the key for {k}.
TEMPLATES = [
    "CREATE TABLE t{k} (id INT, v VARCHAR(10)); INSERT INTO t{k} SELECT a FROM s{k} JOIN u ON s{k}.a = u.a",
    "-- notes\nCREATE VIEW v{k} AS WITH c AS (SELECT * FROM r{k}) SELECT c.a FROM c CROSS JOIN d WHERE c.a > 1",
    "SELECT * FROM t{k}, x LIMIT 5",
    "DELETE FROM t{k}",
    "SELECT CASE WHEN a = 1 THEN 2 END AS z FROM (SELECT a FROM e{k}) q WHERE a IN (SELECT b FROM f)",
    "SELECT * FROM {{ ref('m{k}') }} JOIN {{ source('raw', 'o') }} ON 1 = 1",
    "/* */ SELECT a FROM part_t WHERE ts > 1; SELECT a FROM db.PART_T",
    "{% if x %} SELECT 1 {% endif %}",
]
AIRFLOW = "from airflow import DAG\nwith DAG('d{k}', doc='{k}') as dag:\n    a = XOperator(task_id='a')\n    b = YOperator(task_id='b', sql='select 1')\n    a >> b\n"
JOB = "from pyspark.sql import SparkSession\ndf = spark.table('r{k}').join(spark.read.parquet('p'))\nspark.sql('select * from q{k}')\ndf.write.saveAsTable('w{k}')\ndf.write.mode('x').insertInto('r{k}')\n"
SCHEMA = "models:\n  - {name: m, description: 'of {k}', tests: [not_null], meta: {owner: o{k}}, columns: [{name: a, data_type: int{k}}, {name: c{k}}]}\n  - {name: n{k}, columns: [{name: a, tests: [unique]}]}\n"
ODCS = [
    "schema: [{name: C{k}, properties: [{name: id, logicalType: int}, {name: v, physicalType: TEXT}]}]",
    "dataset: {name: c{k}, schema: [{name: id, type: int}, {name: w, type: date}]}",
    "schema: [{name: zz{k}, properties: [{name: id}]}]",
    "schema: [{name: db.c{k}, properties: [{name: id, logicalType: string}, {name: v, physicalType: varchar(3)}]}]",
]


def filled(template: str, key) -> F.Column:
    return F.replace(F.lit(template), F.lit("{k}"), key.cast("string"))


def chosen(templates: list[str], key) -> F.Column:
    return F.element_at(F.array(*(filled(x, key) for x in templates)), (key % len(templates)).cast("int") + 1)


def sql_files(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(s, d, "orders").select(F.concat(F.lit("q"), k.cast("string"), F.lit(".sql")).alias("path"), chosen(TEMPLATES, k).alias("content"), k.alias("k"))


def statements(s, d) -> DataFrame:
    return extract.sql_statements(sql_files(s, d))


def keys(s) -> DataFrame:
    rows = [("x.part_t", "TS", 1), ("y.part_t", "other", 2), ("u", "dt", 3), ("d", "a", 4)]
    return s.createDataFrame(rows, "name string, partition_key string, ord int")


def model_edges(s, d) -> DataFrame:
    files = sql_files(s, d).where("k % 8 in (2, 5)").select("path", "content", F.lit("").alias("root"), F.lit("p").alias("project"), F.lit(0).alias("mp_at"))
    return graph.distinct_edges(scan.models(files, None, None, 0)[1])


def keyed_files(s, d, template: str | list[str], mark: str, end: str) -> DataFrame:
    k = F.col("s_suppkey")
    content = chosen(template, k) if isinstance(template, list) else filled(template, k)
    return _t(s, d, "supplier").select(F.concat(F.lit(mark), k.cast("string"), F.lit(end)).alias("path"), content.alias("content"))


def airflow_edges(s, d) -> DataFrame:
    flow = extract.airflow_facts(keyed_files(s, d, AIRFLOW, "f", ".py")).select(F.explode("facts").alias("s"))
    return flow.select(F.explode("s.edges").alias("e")).select("e.*")


def airflow_tasks(s, d) -> DataFrame:
    flow = extract.airflow_facts(keyed_files(s, d, AIRFLOW, "f", ".py")).select(F.explode("facts").alias("s"))
    return flow.select(F.element_at("s.dags", 1)["has_docs"].alias("documented"), F.explode("s.tasks").alias("t")).select("documented", "t.*")


def job_edges(s, d) -> DataFrame:
    return extract.spark_edges(extract.spark_facts(keyed_files(s, d, JOB, "j", ".py"))).select("source", "target")


def model_meta(s, d) -> DataFrame:
    files = keyed_files(s, d, SCHEMA, "y", ".yml").withColumn("n", F.substring("path", 2, 30))
    rows = extract.schema_facts(files).select("path", F.explode("facts").alias("s"))
    number = F.regexp_extract("path", r"(\d+)", 1).cast("int")
    merged = scan.merged_meta(rows.select(F.lit("").alias("root"), F.struct(number.alias("n"), "s.at").alias("ord"), "s"))
    return merged.select("name", "has_docs", "has_tests", "description", "owner", "richness", F.size("columns").alias("n_columns"), F.element_at("columns", 1).alias("first_column"), F.try_element_at("column_types", F.lit("a")).alias("type_a"))


def agreed(s, d) -> DataFrame:
    found = extract.contract_facts(keyed_files(s, d, ODCS, "k", ".yml"))
    return found.select(F.col("path").alias("file_path"), F.explode("facts").alias("s")).select("file_path", "s.dataset", "s.columns")


def contract_assets(s, d) -> DataFrame:
    k = F.col("c_custkey")
    types = F.create_map(F.lit("id"), F.lit("BIGINT"), F.lit("v"), F.lit("String"))
    return _t(s, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("name"), F.array(F.lit("id"), F.lit("v")).alias("columns"), types.alias("column_types"), k.alias("ord"))


def drift(s, d) -> DataFrame:
    return contracts.drift(contracts.matched(agreed(s, d), contract_assets(s, d)))


CODEOWNERS = "# all\n* @all @more\n\n/models/staging/ @never\nmodels/staging/* @staging # of late\nmodels/**/c?.sql @few\nc1*.sql @ones\nlonely\n**/p[2-3]*.sql @parts\n"


def owner_rules(s) -> DataFrame:
    return ownership.rules(s.createDataFrame([(CODEOWNERS,)], "content string"))


def owner_rows(s, d) -> DataFrame:
    """Parts without a rule's owner fall back to what they declare, then to an author."""
    k = F.col("ord")
    assets = row_assets(s, d).where("name like 'p%'").withColumn("owner", F.when(k % 3 == 0, F.concat(F.lit(" d"), k.cast("string"))).when(k % 3 == 1, "  "))
    commits = assets.where("ord % 4 <> 0").select(F.col("file_path").alias("path"), F.lit("author").alias("author"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return ownership.resolved(assets, owner_rules(s).where("line > 1 and pattern not like 'models/%'"), commits)


def hot(s, d) -> DataFrame:
    k = F.col("ord")
    assets = row_assets(s, d).withColumn("tags", F.when(k % 11 == 0, F.create_map(F.lit("role"), F.lit("query_block"))))
    files = assets.where("ord % 5 <> 1").select(F.col("file_path").alias("path"), k)
    patterns = files.select("path", F.when(k % 3 == 0, F.array(F.lit("SELECT_STAR"), F.lit("NO_LIMIT"))).when(k % 3 == 1, F.array(F.lit("NO_LIMIT"))).otherwise(F.expr("cast(array() as array<string>)")).alias("patterns"))
    down = assets.where("ord % 2 = 0").select("name", (k % 70).alias("descendants"))
    return cost.hotspots(assets, patterns, files.where("ord % 7 = 0").select("path"), down)


def event_edges(s, d) -> DataFrame:
    e = _t(s, d, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("event_type").alias("source"), after.alias("target")).where("target is not null").distinct()


EVENT_EDGES = "ee AS (SELECT DISTINCT source, target FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL)"


def critical_path(s, d) -> DataFrame:
    return s.createDataFrame(list(enumerate(graph.critical_path(dim_edges(s, d)))), "place long, name string")


def finding_rows(s, d) -> DataFrame:
    rows = row_assets(s, d)
    parts = [scores.missing_tests(rows, graph.out_degrees(catalog.row_edges(s, d))), scores.missing_docs(rows).withColumn("message", F.lit(scores.NO_DOCS))]
    return report.all_findings(parts)


def mart_assets(s, d) -> DataFrame:
    k = F.col("ord")
    named = F.concat(F.when(k % 4 == 0, "stg_").when(k % 6 == 0, "FCT_").otherwise(""), "name")
    return row_assets(s, d).select(named.alias("name"), "file_path", "has_tests", F.when(k % 2 == 0, F.create_map(F.lit("test_richness"), F.lit("low"))).alias("tags"))


def lines(s, d) -> DataFrame:
    """One line for each order date, and lines that aren't entries."""
    o = _t(s, d, "orders").where("o_orderkey % 50 = 0")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    entry = F.concat(F.lit('{"scan_date": "'), day, F.lit("#"), F.col("o_orderkey").cast("string"), F.lit('", "overall": '), (F.col("o_orderkey") % 100).cast("string"), F.lit(', "scores": {}}'))
    return o.select(F.when(F.col("o_orderkey") % 3 == 0, "{broken").otherwise(entry).alias("value"))


def snapshots(s, d) -> DataFrame:
    return _t(s, d, "events").select(F.col("ts").alias("at"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("payload"))


def newest(s, d):
    return F.lit(_t(s, d, "events").agg(F.max("ts")).head()[0])


def tagged(s, d) -> DataFrame:
    o = _t(s, d, "orders")
    key = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" k"), F.col("o_orderkey").cast("string"), F.lit("\t")))
    return o.select(F.col("o_orderpriority").alias("name"), F.create_map(F.lit("partition_key"), key).alias("tags"), F.col("o_orderkey").alias("ord"))


def counted(s, d) -> DataFrame:
    files = catalog.files(s, d).withColumn("file_type", text.file_type(F.col("path"), F.col("content"))).where("file_type is not null")
    return report.parsed_counts(files, s.createDataFrame([("a",), ("b",)], "root string"), files.where("path like '%5.sql' or path like '%0.sql'").select("path"))


QUERIES = {
    "sql_lineage": lambda s, d: extract.sql_edges(statements(s, d)).select("source", "target"),
    "sql_assets": lambda s, d: extract.sql_assets(sql_files(s, d), statements(s, d)).select("name", "asset_type", "has_docs", F.array_join("columns", ",").alias("columns"), F.try_element_at("column_types", F.lit("v")).alias("type_v"), F.try_element_at("tags", F.lit("role")).alias("role")),
    "sql_features": lambda s, d: extract.features(statements(s, d)),
    "sql_leading_docs": lambda s, d: sql_files(s, d).select("path", extract.leading_documentation(F.col("content")).alias("documented")),
    "cost_patterns": lambda s, d: extract.cost_patterns(statements(s, d)).select("path", F.array_join("patterns", ",").alias("patterns")),
    "partition_filter": lambda s, d: extract.missing_partition_filters(statements(s, d), keys(s)),
    "partition_map": lambda s, d: cost.partition_keys(tagged(s, d)).select("name", "partition_key"),
    "dbt_model_edges": model_edges,
    "model_meta_merge": model_meta,
    "airflow_edges": airflow_edges,
    "airflow_tasks": airflow_tasks,
    "spark_job_edges": job_edges,
    "contract_columns": lambda s, d: agreed(s, d).select("file_path", "dataset", F.explode("columns").alias("column", "type")),
    "contract_drift": lambda s, d: contracts.findings(drift(s, d)),
    "contract_score": lambda s, d: contracts.summary(drift(s, d)),
    "codeowners_rules": lambda s, d: owner_rules(s),
    "codeowners_match": lambda s, d: ownership.owned(row_assets(s, d).select(F.col("file_path").alias("path")), owner_rules(s)),
    "owner_resolution": lambda s, d: owner_rows(s, d).select("name", "owner"),
    "ownership_score": lambda s, d: ownership.summary(owner_rows(s, d), owner_rows(s, d).where("at is not null and ord % 10 = 1")),
    "no_owner_findings": lambda s, d: ownership.unowned(owner_rows(s, d)),
    "cost_hotspots": lambda s, d: cost.findings(hot(s, d)),
    "cost_rank_top50": lambda s, d: cost.ranked(hot(s, d)).select("name", "file_path", F.array_join("patterns", ",").alias("patterns"), "pattern_count", "downstream", "weight"),
    "cost_score": lambda s, d: cost.summary(hot(s, d)),
    "simple_cycles": lambda s, d: graph.cycles(event_edges(s, d)).select(F.array_join("cycle", ">").alias("cycle")),
    "is_dag_cyclic": lambda s, d: impact.is_dag(event_edges(s, d)),
    "descendant_counts_cyclic": lambda s, d: graph.descendant_counts(event_edges(s, d)),
    "critical_path": critical_path,
    "graph_summary": lambda s, d: graph.summary(dim_nodes(s, d), dim_edges(s, d)),
    "graph_export": lambda s, d: report.export_graph(dim_nodes(s, d).where("name not like 'r%'").select("name", F.lit("table").alias("asset_type"), F.concat("name", F.lit(".sql")).alias("file_path"), F.lit(1).alias("ord")), dim_edges(s, d)),
    "node_attributes": lambda s, d: graph.build(row_assets(s, d).unionByName(row_assets(s, d).withColumns({"ord": F.col("ord") + 1, "asset_type": F.lit("later")}).where("ord % 4 = 0")), catalog.row_edges(s, d)).select("name", "asset_type", "kind"),
    "high_complexity_findings": lambda s, d: impact.complexity_findings(impact.complexity(dim_nodes(s, d), dim_edges(s, d), dim_sql(s, d))),
    "weak_test_findings": lambda s, d: scores.weak_tests(mart_assets(s, d)),
    "dead_score": lambda s, d: impact.dead_score(dim_nodes(s, d), impact.dead_findings(dim_nodes(s, d), dim_edges(s, d), catalog.dim_columns(s, d))),
    "top_findings": lambda s, d: report.top_findings(finding_rows(s, d)).select("severity", "category", "asset_name"),
    "findings_union": lambda s, d: finding_rows(s, d).groupBy("analyzer", "category").agg(F.count("*").alias("n")),
    "scan_diff_findings": lambda s, d: impact.added(finding_rows(s, d), finding_rows(s, d).where("category = 'missing_test' or asset_name like '%1'"), ["severity", "category", "asset_name", "message"]),
    "history_last30": lambda s, d: report.last_of_history(lines(s, d)).select("scan_date", "overall"),
    "snapshot_daily": lambda s, d: report.daily(snapshots(s, d)),
    "snapshot_retention": lambda s, d: report.pruned(snapshots(s, d), newest(s, d), 10),
    "edge_first_per_key": lambda s, d: graph.first_per_key(_t(s, d, "lineitem").select("l_suppkey", "l_partkey", F.struct("l_orderkey", "l_linenumber").alias("ord"), "l_orderkey"), ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", "l_orderkey"),
    "parsed_counts": counted,
    "model_stem": lambda s, d: row_assets(s, d).select("file_path", text.stem(F.col("file_path")).alias("stem"), extract.last_segment(F.concat(F.lit("db."), "name")).alias("segment")),
}

K = "o_orderkey AS k, 'q' || o_orderkey || '.sql' AS p, o_orderkey % 8 AS t FROM orders"
BY = lambda column, values: f"CASE t {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END AS {column}"
DOC_TEXT = scores.NO_DOCS
HOT = f"""{ROW_ASSETS}, pt AS (SELECT name, file_path, ord, CASE ord % 3 WHEN 0 THEN ['SELECT_STAR', 'NO_LIMIT'] WHEN 1 THEN ['NO_LIMIT'] ELSE [] END || CASE WHEN ord % 7 = 0 THEN ['MISSING_PARTITION_FILTER'] ELSE [] END AS ps,
CASE WHEN ord % 2 = 0 THEN ord % 70 ELSE 0 END AS dn FROM ra WHERE ord % 5 <> 1 AND ord % 11 <> 0), hs AS (SELECT name, file_path, ord, array_to_string(ps, ',') AS patterns, CAST(len(ps) AS INTEGER) AS pattern_count, dn AS downstream, round_even(len(ps) * (1 + 0.12::DOUBLE * least(50, dn)), 4) AS weight FROM pt WHERE len(ps) > 0)"""
OWNER = f"""{ROW_ASSETS}, ow AS (SELECT name, ord, CASE WHEN name LIKE 'p2%' OR name LIKE 'p3%' THEN '@parts' WHEN ord % 3 = 0 THEN 'd' || ord WHEN ord % 4 <> 0 THEN 'author' END AS owner FROM ra WHERE name LIKE 'p%')"""
FOUND = f"""{catalog.DEGREES}, fd AS (SELECT 0 AS analyzer, CASE WHEN out_degree > 10 THEN CASE WHEN contains(file_path, 'staging') THEN 'warning' ELSE 'critical' END WHEN contains(file_path, 'staging') THEN 'info' ELSE 'warning' END AS severity,
'missing_test' AS category, ra.name AS asset_name, 'No tests; ' || out_degree || ' downstream dependent(s); staging=' || CASE WHEN contains(file_path, 'staging') THEN 'True' ELSE 'False' END || ' (lower risk when True)' AS message FROM ra JOIN dg USING (name) WHERE NOT has_tests AND out_degree > 0
UNION ALL SELECT 1, CASE WHEN asset_type = 'dbt_model' THEN 'warning' ELSE 'info' END, 'missing_documentation', name, '{DOC_TEXT}' FROM ra WHERE NOT has_docs)"""
ORACLES = {
    "sql_lineage": f"""WITH f AS (SELECT {K}) SELECT unnest(CASE t WHEN 0 THEN ['s' || k, 'u'] WHEN 1 THEN ['r' || k, 'c', 'd'] WHEN 2 THEN ['t' || k, 'x'] WHEN 4 THEN ['e' || k, 'f'] WHEN 6 THEN ['part_t'] ELSE [] END) AS source, CASE t WHEN 0 THEN 't' || k WHEN 1 THEN 'v' || k ELSE p || '#select0' END AS target FROM f
        UNION ALL SELECT 'db.PART_T', p || '#select1' FROM f WHERE t = 6""",
    "sql_assets": f"""WITH f AS (SELECT {K}) SELECT CASE t WHEN 0 THEN 't' || k WHEN 1 THEN 'v' || k ELSE p || '#select0' END AS name, CASE t WHEN 0 THEN 'table' ELSE 'view' END AS asset_type, t = 1 AS has_docs, CASE t WHEN 0 THEN 'id,v' ELSE '' END AS columns, CASE t WHEN 0 THEN 'VARCHAR(10)' END AS type_v,
        CASE WHEN t > 1 THEN 'query_block' END AS role FROM f WHERE t NOT IN (3, 7) UNION ALL SELECT p || '#select1', 'view', false, '', NULL, 'query_block' FROM f WHERE t = 6""",
    "sql_features": f"WITH f AS (SELECT {K}), c AS (SELECT p AS path, {BY('joins', [1, 1, 1, 0, 0, 1, 0, 0])}, {BY('subqueries', [0, 0, 0, 0, 2, 0, 0, 0])}, {BY('ctes', [0, 1, 0, 0, 0, 0, 0, 0])}, {BY('cases', [0, 0, 0, 0, 1, 0, 0, 0])} FROM f) SELECT *, joins + subqueries + ctes + cases AS total FROM c",
    "sql_leading_docs": f"WITH f AS (SELECT {K}) SELECT p AS path, t = 1 AS documented FROM f",
    "cost_patterns": "WITH f AS (SELECT {}) SELECT p AS path, {} FROM f".format(K, BY("patterns", ["''", "'SELECT_STAR,CROSS_JOIN'", "'SELECT_STAR,SELECT_WITHOUT_WHERE'", "'MISSING_WHERE_CLAUSE'", "'NO_LIMIT'", "'SELECT_STAR,SELECT_WITHOUT_WHERE,NO_LIMIT'", "'NO_LIMIT,SELECT_WITHOUT_WHERE'", "''"])),
    "partition_filter": f"WITH f AS (SELECT {K}) SELECT p AS path FROM f WHERE t IN (0, 6)",
    "partition_map": "SELECT o_orderpriority AS name, 'k' || max(o_orderkey) AS partition_key FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_orderpriority",
    "dbt_model_edges": f"WITH f AS (SELECT {K}) SELECT unnest(CASE t WHEN 2 THEN ['t' || k, 'x'] ELSE ['m' || k, 'raw.o'] END) AS source, 'q' || k AS target FROM f WHERE t IN (2, 5)",
    "model_meta_merge": """WITH k AS (SELECT s_suppkey AS k FROM supplier) SELECT 'm' AS name, true AS has_docs, true AS has_tests, 'of ' || max(k) AS description, 'o' || max(k) AS owner, 'low' AS richness, CAST(1 + count(*) AS INTEGER) AS n_columns, 'a' AS first_column, 'int' || max(k) AS type_a FROM k
        UNION ALL SELECT 'n' || k, false, true, NULL, NULL, 'ok', 1, 'a', NULL FROM k""",
    "airflow_edges": "SELECT unnest(['d' || s_suppkey, 'd' || s_suppkey, 'd' || s_suppkey || '.a']) AS source, unnest(['d' || s_suppkey || '.a', 'd' || s_suppkey || '.b', 'd' || s_suppkey || '.b']) AS target FROM supplier",
    "airflow_tasks": "SELECT true AS documented, 'd' || s_suppkey AS dag, unnest(['a', 'b']) AS task, unnest(['XOperator', 'YOperator']) AS operator, unnest(['', 'select 1']) AS sql FROM supplier",
    "spark_job_edges": "SELECT s AS source, t AS target FROM (SELECT unnest(['r' || s_suppkey, 'p', 'q' || s_suppkey]) AS s, s_suppkey AS k FROM supplier), (SELECT unnest(['w', 'r']) || s_suppkey AS t, s_suppkey AS j FROM supplier) WHERE k = j",
    "contract_columns": """SELECT 'k' || s_suppkey || '.yml' AS file_path, CASE s_suppkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'c' WHEN 2 THEN 'zz' ELSE 'db.c' END || s_suppkey AS dataset, unnest(CASE s_suppkey % 4 WHEN 1 THEN ['id', 'w'] WHEN 2 THEN ['id'] ELSE ['id', 'v'] END) AS column,
        unnest(CASE s_suppkey % 4 WHEN 0 THEN ['int', 'TEXT'] WHEN 1 THEN ['int', 'date'] WHEN 2 THEN [NULL] ELSE ['string', 'varchar(3)'] END) AS type FROM supplier""",
    "contract_drift": """WITH k AS (SELECT s_suppkey AS k, 'k' || s_suppkey || '.yml' AS f, 'c' || s_suppkey AS a FROM supplier) SELECT 'warning' AS severity, 'contract_missing_column' AS category, a AS asset_name, 'Contract requires column ''w'' not present on asset ''' || a || '''' AS message, f AS file_path FROM k WHERE k % 4 = 1
        UNION ALL SELECT 'info', 'contract_extra_column', a, 'Asset ''' || a || ''' has column ''v'' not listed in contract', f FROM k WHERE k % 4 = 1
        UNION ALL SELECT 'warning', 'contract_asset_not_found', 'zz' || k, 'No matching asset for contract dataset ''zz' || k || ''' (file ' || f || ')', f FROM k WHERE k % 4 = 2
        UNION ALL SELECT 'warning', 'contract_type_mismatch', 'db.' || a, 'Column ''id'': contract type ''string'' vs actual ''BIGINT'' (asset ''' || a || ''')', f FROM k WHERE k % 4 = 3""",
    "contract_score": "SELECT count(*) AS total, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS compliant, round_even(compliant / total, 6) AS ratio, CAST(round_even(compliant / total * 100, 0) AS INTEGER) AS score FROM supplier",
    "codeowners_rules": "SELECT * FROM (VALUES (1, '*', '@all, @more'), (3, '/models/staging/', '@never'), (4, 'models/staging/*', '@staging'), (5, 'models/**/c?.sql', '@few'), (6, 'c1*.sql', '@ones'), (8, '**/p[2-3]*.sql', '@parts')) AS x(line, pattern, owners)",
    "codeowners_match": f"WITH {ROW_ASSETS} SELECT file_path AS path, CASE WHEN name LIKE 'p2%' OR name LIKE 'p3%' THEN '@parts' WHEN name LIKE 'c1%' THEN '@ones' WHEN name LIKE 'c_' THEN '@few' WHEN ord % 5 = 0 THEN '@staging' ELSE '@all, @more' END AS owners FROM ra",
    "owner_resolution": f"WITH {OWNER} SELECT name, owner FROM ow",
    "ownership_score": f"WITH {OWNER} SELECT count(*) AS total, count(owner) AS with_owner, total - with_owner AS no_owner, count(*) FILTER (WHERE ord % 4 <> 0 AND ord % 10 = 1) AS stale, round_even(with_owner / total, 6) AS ratio, CAST(round_even(with_owner / total * 100, 0) AS INTEGER) AS score FROM ow",
    "no_owner_findings": f"WITH {OWNER} SELECT 'warning' AS severity, 'no_owner' AS category, name AS asset_name, '{ownership.NO_OWNER}' AS message FROM ow WHERE owner IS NULL",
    "cost_hotspots": f"WITH {HOT} SELECT 'warning' AS severity, 'cost_hotspot' AS category, name AS asset_name, 'Static cost signals: ' || replace(patterns, ',', ', ') || ' (downstream nodes: ' || downstream || ', weighted impact: ' || printf('%.2f', weight) || ')' AS message, file_path FROM hs",
    "cost_rank_top50": f"WITH {HOT} SELECT name, file_path, patterns, pattern_count, downstream, weight FROM hs ORDER BY weight DESC, ord LIMIT 50",
    "cost_score": f"WITH {HOT} SELECT CAST(greatest(0, least(100, round_even(100 - least(100, avg(weight) * 8), 0))) AS INTEGER) AS score, CAST(sum(pattern_count) AS BIGINT) AS instances, max(weight) AS heaviest FROM hs",
    "simple_cycles": f"WITH RECURSIVE {EVENT_EDGES}, w AS (SELECT source AS s, target AS l, [source] AS p FROM ee WHERE source <= target UNION ALL SELECT s, target, list_append(p, l) FROM w JOIN ee ON l = source WHERE l <> s AND NOT list_contains(p, l) AND target >= s) SELECT array_to_string(p, '>') AS cycle FROM w WHERE s = l",
    "is_dag_cyclic": "SELECT false AS is_dag",
    "descendant_counts_cyclic": f"WITH RECURSIVE {EVENT_EDGES}, c(a, b) AS (SELECT source, target FROM ee UNION SELECT a, target FROM c JOIN ee ON b = source) SELECT a AS name, count(*) AS descendants FROM c WHERE a <> b GROUP BY a",
    "critical_path": f"WITH RECURSIVE {DIM_EDGES}, w AS (SELECT source AS s, target AS l, [source, target] AS p FROM de UNION ALL SELECT s, target, list_append(p, target) FROM w JOIN de ON l = source), b AS (SELECT list_reverse(p) AS p FROM w ORDER BY len(w.p) DESC, list_reverse(w.p) LIMIT 1) SELECT CAST(len(p) - i AS BIGINT) AS place, p[i] AS name FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM b)",
    "graph_summary": f"WITH {DIM_EDGES} SELECT (SELECT count(*) FROM (SELECT source FROM de UNION SELECT target FROM de)) AS node_count, count(*) AS edge_count, true AS is_directed_acyclic FROM de",
    "graph_export": f"WITH RECURSIVE {DIM_EDGES}, c(a, b) AS (SELECT source, target FROM de UNION SELECT a, target FROM c JOIN de ON b = source), n AS (SELECT source AS id FROM de UNION SELECT target FROM de) SELECT id, CASE WHEN id LIKE 'r%' THEN 'external' ELSE 'table' END AS type, CASE WHEN id LIKE 'r%' THEN '' ELSE id || '.sql' END AS file, (SELECT count(*) FROM c WHERE a = id) AS importance FROM n",
    "node_attributes": f"WITH {catalog.ROW_EDGES}, {ROW_ASSETS} SELECT name, CASE WHEN (ord + 1) % 4 = 0 THEN 'later' ELSE asset_type END AS asset_type, 'asset' AS kind FROM ra UNION ALL SELECT name, NULL, 'reference_only' FROM (SELECT source AS name FROM re UNION SELECT target FROM re) WHERE name NOT IN (SELECT name FROM ra)",
    "high_complexity_findings": f"{catalog.COMPLEXITY}, p AS (SELECT quantile_cont(c, 0.8) AS p FROM y) SELECT 'warning' AS severity, 'high_complexity' AS category, name AS asset_name, printf('Complexity %.1f at/above 80th percentile (threshold %.1f)', c, p) AS message FROM y, p WHERE c >= p - 1e-9 AND c >= 1",
    "weak_test_findings": f"WITH {ROW_ASSETS} SELECT 'info' AS severity, 'weak_test_coverage' AS category, 'FCT_' || name AS asset_name, '{scores.WEAK_TESTS}' AS message FROM ra WHERE ord % 6 = 0 AND ord % 4 <> 0 AND ord % 5 <> 0",
    "dead_score": f"WITH {DIM_EDGES}, n AS (SELECT source AS name FROM de UNION SELECT target FROM de) SELECT CAST(100 - round_even((SELECT count(*) FROM n WHERE name NOT IN (SELECT source FROM de)) / count(*) * 100, 0) AS INTEGER) AS score FROM n",
    "top_findings": f"WITH {FOUND} SELECT severity, category, asset_name FROM fd ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, analyzer, asset_name, message LIMIT 12",
    "findings_union": f"WITH {FOUND} SELECT analyzer, category, count(*) AS n FROM fd GROUP BY ALL",
    "scan_diff_findings": f"WITH {FOUND} SELECT DISTINCT severity, category, asset_name, message FROM fd WHERE category <> 'missing_test' AND asset_name NOT LIKE '%1'",
    "history_last30": "SELECT strftime(o_orderdate, '%Y-%m-%d') || '#' || o_orderkey AS scan_date, CAST(o_orderkey % 100 AS INTEGER) AS overall FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey % 3 <> 0 ORDER BY scan_date DESC LIMIT 30",
    "snapshot_daily": "SELECT CAST(ts AS DATE) AS day, 'e' || max_by(event_id, ts) AS payload FROM events GROUP BY 1",
    "snapshot_retention": "SELECT ts AS at, 'e' || event_id AS payload FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY OR ts = (SELECT max(e.ts) FROM events e WHERE CAST(e.ts AS DATE) = CAST(events.ts AS DATE))",
    "edge_first_per_key": "SELECT l_suppkey, l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_suppkey, l_partkey",
    "parsed_counts": """SELECT count(*) AS discovered_file_count, count(*) FILTER (WHERE o_orderkey % 4 = 1 OR (o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0)) AS parsed_sql_file_count, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS parsed_airflow_file_count, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS parsed_spark_file_count, CAST(2 AS BIGINT) AS parsed_dbt_project_count FROM orders""",
    "model_stem": f"WITH {ROW_ASSETS} SELECT file_path, name AS stem, name AS segment FROM ra",
}
