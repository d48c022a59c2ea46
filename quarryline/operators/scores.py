"""Analyzers: findings and scores from 0 to 100, rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import is_mart


RULES = 10_000
#: Parts of findings, by which a later diff compares them.
NO_DOCS = "No documentation: add schema description, SQL header comment, or DAG doc_md"
WEAK_TESTS = "Tests present but schema suggests only not_null-style tests; consider uniqueness or relationships on mart/final models"


def share_score(part: Column, whole: Column) -> Column:
    """100 where there is nothing to score."""
    return F.when(whole == 0, 100).otherwise(F.bround(part / F.nullif(whole, F.lit(0)) * 100, 0)).cast("int")


def test_scope(assets: DataFrame) -> DataFrame:
    """What tests are asked of: dbt models if there are any, else all but sources, Airflow and Spark."""
    any_model = assets.agg(F.coalesce(F.bool_or(F.col("asset_type") == "dbt_model"), F.lit(False)).alias("__models"))  # one row
    other = ~F.coalesce(F.col("asset_type").isin("dbt_source", "airflow_dag", "airflow_task", "spark_job"), F.lit(False))
    inside = F.when(F.col("__models"), F.col("asset_type") == "dbt_model").otherwise(other)
    return assets.join(F.broadcast(any_model), F.lit(True)).where(inside).select(*assets.columns)


def doc_scope(assets: DataFrame) -> DataFrame:
    """What documentation is asked of: all but query blocks. tags: a map, or null."""
    return assets.where(F.coalesce(F.try_element_at("tags", F.lit("role")), F.lit("")) != "query_block")


def coverage(assets: DataFrame, flag: str) -> DataFrame:
    """total, covered, ratio (6 places), score."""
    n = assets.agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("covered"))
    ratio = F.bround(F.col("covered") / F.nullif(F.col("total"), F.lit(0)), 6)
    return n.select("total", "covered", ratio.alias("ratio"), share_score(F.col("covered"), F.col("total")).alias("score"))


def dead_severity(waste: Column, feeders: Column) -> Column:
    return F.when((waste >= 50) | (feeders >= 5), "critical").when((waste >= 20) | (feeders >= 2), "warning").otherwise("info")


def is_staging(path: Column, name: Column) -> Column:
    p, n = F.lower(path), F.lower(name)
    return p.contains("staging") | p.contains("/stg_") | p.contains("\\stg_") | n.startswith("stg_")


def missing_tests(assets: DataFrame, out_degrees: DataFrame, critical: int = 10) -> DataFrame:
    """Findings for untested assets that something depends on."""
    deps = F.coalesce(F.col("out_degree"), F.lit(0))
    staging = is_staging(F.col("file_path"), F.col("name"))
    severity = F.when(deps > critical, F.when(staging, "warning").otherwise("critical")).otherwise(F.when(staging, "info").otherwise("warning"))
    text = F.concat(F.lit("No tests; "), deps.cast("string"), F.lit(" downstream dependent(s); staging="), F.when(staging, "True").otherwise("False"), F.lit(" (lower risk when True)"))
    rows = assets.where(~F.col("has_tests")).join(out_degrees.select("name", "out_degree"), "name", "left").where(deps > 0)
    return rows.select(severity.alias("severity"), F.lit("missing_test").alias("category"), F.col("name").alias("asset_name"), text.alias("message"))


def missing_docs(assets: DataFrame) -> DataFrame:
    severity = F.when(F.col("asset_type").isin("dbt_model", "airflow_dag"), "warning").otherwise("info")
    return assets.where(~F.col("has_docs")).select(severity.alias("severity"), F.lit("missing_documentation").alias("category"), F.col("name").alias("asset_name"))


def weak_tests(assets: DataFrame) -> DataFrame:
    """Findings for mart models whose tests only ask for values that aren't null."""
    low = F.coalesce(F.try_element_at("tags", F.lit("test_richness")), F.lit("")) == "low"
    rows = assets.where(F.col("has_tests") & low & is_mart(F.col("file_path"), F.col("name")) & ~is_staging(F.col("file_path"), F.col("name")))
    return rows.select(F.lit("info").alias("severity"), F.lit("weak_test_coverage").alias("category"), F.col("name").alias("asset_name"), F.lit(WEAK_TESTS).alias("message"))


def last_match(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(path) by rules(line, pattern as a regex, owners): the last matching line wins. Up to RULES rules are sent to all executors."""
    hits = paths.join(F.broadcast(rules) if rules.limit(RULES + 1).count() <= RULES else rules, F.expr("path rlike pattern"), "left")
    return hits.groupBy("path").agg(F.max_by("owners", "line").alias("owners"))


def best_asset(contracts: DataFrame, assets: DataFrame) -> DataFrame:
    """contracts(dataset) to assets(name, ord): exact name, else ignoring case, else last segment; first asset of the best tier."""
    last = F.element_at(F.split("name", "\\."), -1)
    tiers = [(1, F.col("dataset"), F.col("name")), (2, F.lower("dataset"), F.lower("name")), (3, F.lower(F.element_at(F.split("dataset", "\\."), -1)), F.lower(last))]
    found = None
    for tier, left, right in tiers:
        hit = contracts.select("dataset", left.alias("k")).join(assets.select("name", "ord", right.alias("k")), "k").select("dataset", "name", "ord", F.lit(tier).alias("tier"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("dataset").agg(F.min(F.struct("tier", "ord", "name")).alias("x")).select("dataset", "x.name", "x.tier")
    return contracts.select("dataset").join(best, "dataset", "left")
