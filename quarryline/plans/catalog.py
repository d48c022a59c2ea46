"""Queries over the test tables seen as a lineage graph, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text
from quarryline.operators import graph, impact, scores


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def row_edges(spark: SparkSession, d: str) -> DataFrame:
    """nation to customer to order, and nation to supplier to part; keys that 7 divides feed nothing."""
    c, o, s, l = (_t(spark, d, x) for x in ("customer", "orders", "supplier", "lineitem"))
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"))
    return (
        link(c, "n", "c_nationkey", "c", "c_custkey")
        .union(link(o.where("o_custkey % 7 <> 0"), "c", "o_custkey", "o", "o_orderkey"))
        .union(link(s, "n", "s_nationkey", "s", "s_suppkey"))
        .union(link(l.where("l_suppkey % 7 <> 0"), "s", "l_suppkey", "p", "l_partkey"))
    )


ROW_EDGES = """re AS (SELECT 'n' || c_nationkey AS source, 'c' || c_custkey AS target FROM customer
UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_custkey % 7 <> 0
UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_suppkey % 7 <> 0)"""


def row_assets(spark: SparkSession, d: str) -> DataFrame:
    """Customers, orders and parts as assets; nations and suppliers are named by edges only."""
    c, o, p = (_t(spark, d, x) for x in ("customer", "orders", "part"))
    rows = None
    for df, key, mark, kind in ((c, "c_custkey", "c", "dbt_model"), (o, "o_orderkey", "o", "table"), (p, "p_partkey", "p", "view")):
        k = F.col(key)
        part = df.select(
            F.concat(F.lit(mark), k.cast("string")).alias("name"), F.lit(kind).alias("asset_type"), F.concat(F.when(k % 5 == 0, "models/staging/").otherwise("models/marts/"), F.lit(mark), k.cast("string"), F.lit(".sql")).alias("file_path"),
            (k % 3 == 0).alias("has_tests"), (k % 4 != 0).alias("has_docs"), k.alias("ord"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


ROW_ASSETS = "ra AS (" + " UNION ALL ".join(
    f"SELECT '{m}' || {k} AS name, '{t}' AS asset_type, CASE WHEN {k} % 5 = 0 THEN 'models/staging/' ELSE 'models/marts/' END || '{m}' || {k} || '.sql' AS file_path, {k} % 3 = 0 AS has_tests, {k} % 4 <> 0 AS has_docs, {k} AS ord FROM {f}"
    for f, k, m, t in (("customer", "c_custkey", "c", "dbt_model"), ("orders", "o_orderkey", "o", "table"), ("part", "p_partkey", "p", "view"))
) + ")"


def block_assets(s, d):
    """Numbers that 3 divides are query blocks, other even ones have other tags, and some have none."""
    k = F.col("ord")
    role = F.when(k % 3 == 0, F.create_map(F.lit("role"), F.lit("query_block"))).when(k % 2 == 0, F.create_map(F.lit("role"), F.lit("table"))).when(k % 5 == 0, F.create_map(F.lit("owner"), F.lit("query_block")))
    return row_assets(s, d).withColumn("tags", role)


DEGREES = f"{ROW_EDGES}, {ROW_ASSETS}, dg AS (SELECT name, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT source AS name, 0 AS i, 1 AS o FROM re UNION ALL SELECT target, 1, 0 FROM re UNION ALL SELECT name, 0, 0 FROM ra) GROUP BY name)"


def dim_edges(spark: SparkSession, d: str) -> DataFrame:
    """region to nation to market segment to order priority, with region to segment to skip a level."""
    n, c, o = (_t(spark, d, x) for x in ("nation", "customer", "orders"))
    cn = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nations are 25 whatever the scale
    mark = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string"))
    return (
        n.select(mark("r", "n_regionkey").alias("source"), mark("n", "n_nationkey").alias("target"))
        .union(cn.select(mark("n", "n_nationkey"), mark("m", "c_mktsegment")))
        .union(cn.where("n_regionkey = 0").select(mark("r", "n_regionkey"), mark("m", "c_mktsegment")))
        .union(o.join(c, o["o_custkey"] == c["c_custkey"]).select(mark("m", "c_mktsegment"), mark("q", "o_orderpriority")))
        .distinct()
    )


DIM_EDGES = """de AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation
UNION SELECT 'n' || n_nationkey, 'm' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'r' || n_regionkey, 'm' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0
UNION SELECT 'm' || c_mktsegment, 'q' || o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    content = F.when(k % 4 == 0, F.concat(F.lit("{{ config(materialized='view') }} select * from {{ ref('stg_"), s, F.lit("') }}"))).when(
        k % 4 == 1, F.concat(F.lit("{# note #} select a from {{ source('raw', 't"), s, F.lit("') }} join {{ ref('m') }}"))
    ).when(k % 4 == 2, F.lit("from airflow import DAG")).otherwise(F.lit("spark = SparkSession"))
    path = F.when(k % 4 == 0, F.concat(F.lit("models/m"), s, F.lit(".sql"))).when(k % 4 == 1, F.concat(F.lit("adhoc/q"), s, F.lit(".sql"))).otherwise(F.concat(F.lit("jobs/j"), s, F.lit(".py")))
    return _t(spark, d, "orders").select(path.alias("path"), content.alias("content"))


FILES = """f AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'models/m' || o_orderkey || '.sql' WHEN 1 THEN 'adhoc/q' || o_orderkey || '.sql' ELSE 'jobs/j' || o_orderkey || '.py' END AS path,
CASE o_orderkey % 4 WHEN 0 THEN '{{ config(materialized=''view'') }} select * from {{ ref(''stg_' || o_orderkey || ''') }}'
WHEN 1 THEN '{# note #} select a from {{ source(''raw'', ''t' || o_orderkey || ''') }} join {{ ref(''m'') }}' WHEN 2 THEN 'from airflow import DAG' ELSE 'spark = SparkSession' END AS content FROM orders)"""


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Datasets that name a customer exactly, in other case, by last segment, or not at all."""
    k = F.col("n_nationkey")
    mark = F.when(k % 4 == 0, "c").when(k % 4 == 1, "C").when(k % 4 == 2, "db.C").otherwise("zz")
    return _t(spark, d, "nation").select(F.concat(mark, k.cast("string")).alias("dataset"))


CONTRACTS = "ct AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'C' WHEN 2 THEN 'db.C' ELSE 'zz' END || n_nationkey AS dataset FROM nation)"
OWNERS = [(1, "^models/", "all"), (2, "^models/staging/", "staging"), (3, "/c[0-9]+[.]sql$", "customers")]


def owners(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(OWNERS, "line int, pattern string, owners string")
    return scores.last_match(row_assets(spark, d).select(F.col("file_path").alias("path")), rules)


def dim_nodes(s, d):
    return graph.endpoints(dim_edges(s, d))


def dim_columns(s, d):
    return dim_nodes(s, d).where("name like 'm%'").select("name", F.lit(2).alias("n_columns"))


def dim_sql(s, d):
    return dim_nodes(s, d).select("name", F.length("name").alias("sql"))


def commits(s, d):
    return _t(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("asset_name"), F.col("o_orderdate").cast("timestamp").alias("at"))


def stale_assets(s, d):
    return impact.stale(commits(s, d).join(F.broadcast(commits(s, d).agg(F.max("at").alias("as_of"))), F.lit(True)), F.col("as_of"))


def test_names(s, d):
    k = F.col("c_custkey") % 4
    names = F.when(k == 0, F.expr("cast(array() as array<string>)")).when(k == 1, F.array(F.lit("not_null"))).when(k == 2, F.array(F.lit("not_null"), F.lit("Unique"))).otherwise(F.array(F.lit("own_check")))
    return _t(s, d, "customer").select("c_custkey", names.alias("names"))


DIMENSIONS = ["dead_assets", "test_coverage", "documentation", "ownership", "contracts", "cost_hotspots", "complexity", "other"]


def dimension_scores(s, d):
    at = F.element_at(F.array(*map(F.lit, DIMENSIONS)), F.col("n_nationkey").cast("int") + 1)
    return _t(s, d, "nation").where("n_nationkey < 8").select(at.alias("dimension"), (F.col("n_nationkey") * 13 % 101).cast("int").alias("score"))


def sql_type(k):
    return F.when(k % 4 == 0, "VARCHAR(10)").when(k % 4 == 1, "double  precision").when(k % 4 == 2, "BigInt").otherwise("geometry")


def _degrees(s, d):
    return graph.degrees(row_assets(s, d), row_edges(s, d))


QUERIES = {
    "edge_dedupe": lambda s, d: graph.distinct_edges(row_edges(s, d)),
    "graph_degrees": _degrees,
    "dead_assets": lambda s, d: graph.dead_ends(_degrees(s, d)),
    "orphan_assets": lambda s, d: graph.orphans(_degrees(s, d)),
    "high_fanout": lambda s, d: graph.high_fanout(_degrees(s, d)),
    "reference_only_nodes": lambda s, d: graph.reference_only(row_assets(s, d), row_edges(s, d)),
    "exclusive_feeders": lambda s, d: graph.exclusive_feeders(row_edges(s, d)),
    "descendant_counts": lambda s, d: graph.descendant_counts(dim_edges(s, d)),
    "bfs_depth": lambda s, d: graph.depths(graph.endpoints(dim_edges(s, d)), dim_edges(s, d)),
    "critical_path_length": lambda s, d: graph.levels(dim_edges(s, d))[0].agg((F.max("level") + 1).cast("long").alias("critical_path_length")),
    "is_dag": lambda s, d: impact.is_dag(dim_edges(s, d)),
    "dead_asset_impact": lambda s, d: impact.dead_findings(dim_nodes(s, d), dim_edges(s, d), dim_columns(s, d)),
    "complexity_scores": lambda s, d: impact.complexity(dim_nodes(s, d), dim_edges(s, d), dim_sql(s, d)).select("name", *(F.bround(c, 4).alias(c) for c in ("depth_score", "fanout_score", "fanin_score", "sql_score", "combined"))),
    "complexity_p80": lambda s, d: impact.complexity_summary(impact.complexity(dim_nodes(s, d), dim_edges(s, d), dim_sql(s, d))),
    "stale_assets": stale_assets,
    "stale_annotations": lambda s, d: impact.annotations(stale_assets(s, d)),
    "path_exclude": lambda s, d: files(s, d).where(~text.has_excluded_part(F.col("path"), ["ADHOC", "target"])).select("path"),
    "type_canonical": lambda s, d: _t(s, d, "part").select("p_partkey", text.canonical_type(sql_type(F.col("p_partkey"))).alias("type")),
    "test_richness": lambda s, d: test_names(s, d).select("c_custkey", impact.richness(F.col("names")).alias("richness")),
    "overall_health": lambda s, d: impact.overall_health(dimension_scores(s, d)),
    "scan_diff_assets": lambda s, d: impact.added(row_assets(s, d), row_assets(s, d).where("ord % 3 <> 0"), ["name"]),
    "test_coverage": lambda s, d: scores.coverage(row_assets(s, d), "has_tests"),
    "doc_coverage": lambda s, d: scores.coverage(row_assets(s, d), "has_docs"),
    "missing_test_findings": lambda s, d: scores.missing_tests(row_assets(s, d), graph.out_degrees(row_edges(s, d))),
    "missing_doc_findings": lambda s, d: scores.missing_docs(row_assets(s, d)),
    "test_coverage_in_scope": lambda s, d: scores.coverage(scores.test_scope(row_assets(s, d)), "has_tests"),
    "doc_coverage_in_scope": lambda s, d: scores.coverage(scores.doc_scope(block_assets(s, d)), "has_docs"),
    "missing_test_findings_in_scope": lambda s, d: scores.missing_tests(scores.test_scope(row_assets(s, d)), graph.out_degrees(row_edges(s, d))),
    "missing_doc_findings_in_scope": lambda s, d: scores.missing_docs(scores.doc_scope(block_assets(s, d))),
    "contract_asset": lambda s, d: scores.best_asset(contracts(s, d), row_assets(s, d)),
    "path_owners": owners,
    "file_classify": lambda s, d: files(s, d).select("path", text.file_type(F.col("path"), F.col("content")).alias("file_type")),
    "dbt_refs": lambda s, d: files(s, d).select("path", F.concat_ws(",", text.refs(F.col("content"))).alias("refs")),
    "dbt_sources": lambda s, d: files(s, d).select("path", F.concat_ws(",", text.sources(F.col("content"))).alias("sources")),
    "jinja_strip": lambda s, d: files(s, d).select("path", text.without_templates(F.col("content")).alias("sql")),
}

COVERAGE = "WITH {a}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE {f}) AS covered FROM ra) SELECT total, covered, round_even(covered / total, 6) AS ratio, CAST(round_even(covered / total * 100, 0) AS INTEGER) AS score FROM n"
CLOSURE = f"{DIM_EDGES}, c(a, b) AS (SELECT source, target FROM de UNION SELECT c.a, de.target FROM c JOIN de ON c.b = de.source)"
COMPLEXITY = f"""WITH RECURSIVE {DIM_EDGES}, n AS (SELECT source AS name FROM de UNION SELECT target FROM de),
w(root, name, d) AS (SELECT name, name, 0 FROM n WHERE name NOT IN (SELECT target FROM de) UNION SELECT root, target, d + 1 FROM w JOIN de ON w.name = de.source),
dp AS (SELECT name, max(d) AS d FROM (SELECT root, name, min(d) AS d FROM w GROUP BY ALL) GROUP BY name),
r AS (SELECT n.name, coalesce(d, 0) AS d, (SELECT count(*) FROM de WHERE source = n.name) AS fo, (SELECT count(*) FROM de WHERE target = n.name) AS fi, len(n.name) AS sq FROM n LEFT JOIN dp USING (name)),
x AS (SELECT name, d / max(d) OVER () * 100 AS d, fo / max(fo) OVER () * 100 AS fo, fi / max(fi) OVER () * 100 AS fi, sq / max(sq) OVER () * 100 AS sq FROM r),
y AS (SELECT *, 0.25::DOUBLE * d + 0.25::DOUBLE * fo + 0.25::DOUBLE * fi + 0.25::DOUBLE * sq AS c FROM x)"""
ORACLES = {
    "is_dag": f"WITH RECURSIVE {CLOSURE} SELECT count(*) = 0 AS is_dag FROM c WHERE a = b",
    "dead_asset_impact": f"WITH RECURSIVE {CLOSURE}, dead AS (SELECT DISTINCT target AS name FROM de WHERE target NOT IN (SELECT source FROM de)), ch AS (SELECT b AS name, a AS r FROM c JOIN dead ON b = dead.name UNION SELECT name, name FROM dead), ws AS (SELECT name, sum(CASE WHEN r LIKE 'm%' THEN 3 ELSE 1 END) AS w FROM ch GROUP BY name), ex AS (SELECT target AS name, count(*) AS f FROM de WHERE source IN (SELECT source FROM de GROUP BY source HAVING count(*) = 1) GROUP BY target) SELECT CASE WHEN w >= 50 OR coalesce(f, 0) >= 5 THEN 'critical' WHEN w >= 20 OR coalesce(f, 0) >= 2 THEN 'warning' ELSE 'info' END AS severity, 'dead_asset' AS category, name AS asset_name, 'No downstream consumers; ' || coalesce(f, 0) || ' exclusive upstream feeder(s); estimated wasted compute (chain complexity)=' || w AS message FROM ws LEFT JOIN ex USING (name)",
    "complexity_scores": f"{COMPLEXITY} SELECT name, round_even(d, 4) AS depth_score, round_even(fo, 4) AS fanout_score, round_even(fi, 4) AS fanin_score, round_even(sq, 4) AS sql_score, round_even(c, 4) AS combined FROM y",
    "complexity_p80": f"{COMPLEXITY}, p AS (SELECT avg(c) AS m, quantile_cont(c, 0.8) AS p FROM y) SELECT CAST(round_even(m, 0) AS INTEGER) AS score, round_even(p, 6) AS threshold, (SELECT count(*) FROM y WHERE c >= p - 1e-9 AND c >= 1) AS above FROM p",
    "stale_assets": "SELECT 'warning' AS severity, 'stale_asset' AS category, CAST(o_orderkey AS VARCHAR) AS asset_name, 'Last commit on file is older than ~6 months (' || strftime(o_orderdate, '%Y-%m-%d') || ')' AS message FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 183 DAY",
    "stale_annotations": "SELECT '::warning title=quarryline::stale_asset [' || o_orderkey || '] Last commit on file is older than ~6 months (' || strftime(o_orderdate, '%Y-%m-%d') || ')' AS line FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 183 DAY",
    "path_exclude": f"WITH {FILES} SELECT path FROM f WHERE NOT starts_with(path, 'adhoc/')",
    "type_canonical": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'float' WHEN 2 THEN 'integer' ELSE 'geometry' END AS type FROM part",
    "test_richness": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'low' ELSE 'ok' END AS richness FROM customer",
    "overall_health": "SELECT CAST(round_even(avg(CASE WHEN n_nationkey = 6 THEN 100 - n_nationkey * 13 % 101 ELSE n_nationkey * 13 % 101 END), 0) AS INTEGER) AS overall FROM nation WHERE n_nationkey < 7",
    "scan_diff_assets": f"WITH {ROW_ASSETS} SELECT name FROM ra EXCEPT SELECT name FROM ra WHERE ord % 3 <> 0",
    "edge_dedupe": f"WITH {ROW_EDGES} SELECT * FROM re",
    "graph_degrees": f"WITH {DEGREES} SELECT * FROM dg",
    "dead_assets": f"WITH {DEGREES} SELECT name FROM dg WHERE out_degree = 0 AND in_degree > 0",
    "orphan_assets": f"WITH {DEGREES} SELECT name FROM dg WHERE out_degree = 0 AND in_degree = 0",
    "high_fanout": f"WITH {DEGREES} SELECT name, out_degree FROM dg WHERE out_degree > 15",
    "reference_only_nodes": f"WITH {ROW_EDGES}, {ROW_ASSETS} SELECT name FROM (SELECT source AS name FROM re UNION SELECT target FROM re) WHERE name NOT IN (SELECT name FROM ra)",
    "exclusive_feeders": f"WITH {ROW_EDGES} SELECT target AS name, count(*) AS feeders FROM re WHERE source IN (SELECT source FROM re GROUP BY source HAVING count(*) = 1) GROUP BY target",
    "descendant_counts": f"WITH RECURSIVE {DIM_EDGES}, c(a, b) AS (SELECT source, target FROM de UNION SELECT c.a, de.target FROM c JOIN de ON c.b = de.source) SELECT a AS name, count(*) AS descendants FROM c WHERE a <> b GROUP BY a",
    "bfs_depth": f"WITH RECURSIVE {DIM_EDGES}, n AS (SELECT source AS name FROM de UNION SELECT target FROM de), w(root, name, d) AS (SELECT name, name, 0 FROM n WHERE name NOT IN (SELECT target FROM de) UNION SELECT root, target, d + 1 FROM w JOIN de ON w.name = de.source) SELECT name, CAST(max(d) AS INTEGER) AS depth FROM (SELECT root, name, min(d) AS d FROM w GROUP BY ALL) GROUP BY name",
    "critical_path_length": f"WITH RECURSIVE {DIM_EDGES}, w(name, d) AS (SELECT source, 1 FROM de UNION SELECT target, d + 1 FROM w JOIN de ON w.name = de.source) SELECT CAST(max(d) AS BIGINT) AS critical_path_length FROM w",
    "test_coverage": COVERAGE.format(a=ROW_ASSETS, f="has_tests"),
    "doc_coverage": COVERAGE.format(a=ROW_ASSETS, f="has_docs"),
    "missing_test_findings": f"WITH {DEGREES}, x AS (SELECT ra.name, out_degree AS n, contains(file_path, 'staging') AS st FROM ra JOIN dg USING (name) WHERE NOT has_tests AND out_degree > 0) SELECT CASE WHEN n > 10 THEN CASE WHEN st THEN 'warning' ELSE 'critical' END WHEN st THEN 'info' ELSE 'warning' END AS severity, 'missing_test' AS category, name AS asset_name, 'No tests; ' || n || ' downstream dependent(s); staging=' || CASE WHEN st THEN 'True' ELSE 'False' END || ' (lower risk when True)' AS message FROM x",
    "missing_doc_findings": f"WITH {ROW_ASSETS} SELECT CASE WHEN asset_type = 'dbt_model' THEN 'warning' ELSE 'info' END AS severity, 'missing_documentation' AS category, name AS asset_name FROM ra WHERE NOT has_docs",
    "test_coverage_in_scope": COVERAGE.format(a=ROW_ASSETS, f="has_tests").replace("FROM ra)", "FROM ra WHERE asset_type = 'dbt_model')"),
    "doc_coverage_in_scope": COVERAGE.format(a=ROW_ASSETS, f="has_docs").replace("FROM ra)", "FROM ra WHERE ord % 3 <> 0)"),
    "missing_test_findings_in_scope": f"WITH {DEGREES}, x AS (SELECT ra.name, out_degree AS n, contains(file_path, 'staging') AS st FROM ra JOIN dg USING (name) WHERE asset_type = 'dbt_model' AND NOT has_tests AND out_degree > 0) SELECT CASE WHEN n > 10 THEN CASE WHEN st THEN 'warning' ELSE 'critical' END WHEN st THEN 'info' ELSE 'warning' END AS severity, 'missing_test' AS category, name AS asset_name, 'No tests; ' || n || ' downstream dependent(s); staging=' || CASE WHEN st THEN 'True' ELSE 'False' END || ' (lower risk when True)' AS message FROM x",
    "missing_doc_findings_in_scope": f"WITH {ROW_ASSETS} SELECT CASE WHEN asset_type = 'dbt_model' THEN 'warning' ELSE 'info' END AS severity, 'missing_documentation' AS category, name AS asset_name FROM ra WHERE NOT has_docs AND ord % 3 <> 0",
    "contract_asset": f"WITH {ROW_ASSETS}, {CONTRACTS}, h AS (SELECT dataset, name, ord, CASE WHEN dataset = name THEN 1 WHEN lower(dataset) = lower(name) THEN 2 ELSE 3 END AS tier FROM ct JOIN ra ON lower(split_part(dataset, '.', -1)) = lower(split_part(name, '.', -1))), b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY tier, ord) AS n FROM h) SELECT ct.dataset, b.name, b.tier FROM ct LEFT JOIN b ON ct.dataset = b.dataset AND n = 1",
    "path_owners": f"WITH {ROW_ASSETS} SELECT file_path AS path, CASE WHEN regexp_matches(file_path, '/c[0-9]+[.]sql$') THEN 'customers' WHEN starts_with(file_path, 'models/staging/') THEN 'staging' ELSE 'all' END AS owners FROM ra",
    "file_classify": f"WITH {FILES} SELECT path, CASE WHEN path LIKE 'models/%' THEN 'dbt_model' WHEN path LIKE '%.sql' THEN 'sql' WHEN contains(content, 'airflow') THEN 'airflow_dag' ELSE 'spark_job' END AS file_type FROM f",
    "dbt_refs": f"WITH {FILES} SELECT path, array_to_string(regexp_extract_all(content, 'ref\\(''([^'']+)''\\)', 1), ',') AS refs FROM f",
    "dbt_sources": f"WITH {FILES} SELECT path, coalesce(nullif(regexp_extract(content, 'source\\(''([^'']+)''', 1) || '.' || regexp_extract(content, 'source\\(''[^'']+'', ''([^'']+)''', 1), '.'), '') AS sources FROM f",
    "jinja_strip": f"WITH {FILES} SELECT path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\{{\\{{ config\\(.*?\\) \\}}\\}}', ' '), '\\{{\\{{ ref\\(''([^'']+)''\\) \\}}\\}}', '\\1', 'g'), '\\{{\\{{ source\\(''([^'']+)'', ''([^'']+)''\\) \\}}\\}}', '\\1.\\2', 'g'), '\\{{#.*?#\\}}', ' ') AS sql FROM f",
}
