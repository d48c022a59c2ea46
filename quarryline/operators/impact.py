"""Findings and scores that build on the graph: waste behind dead ends, complexity, staleness, health."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import graph, scores

#: Parts of tags that mark intended ends.
TERMINAL = ("exposure", "dashboard", "export")
WEIGHT, PERCENTILE = 0.25, 0.8
STALE_DAYS = 183
#: Dimensions of the overall health, where higher is better.
POSITIVE = ["dead_assets", "test_coverage", "documentation", "ownership", "contracts", "cost_hotspots"]
#: Parts of test names that say more than "not null".
STRONG = ["unique", "relationship", "accepted_values", "expression", "dbt_utils"]


def is_dag(edges: DataFrame) -> DataFrame:
    """One row; an empty graph is acyclic."""
    return edges.sparkSession.createDataFrame([(bool(graph.levels(edges)[1]),)], "is_dag boolean")


def terminal(tags: Column, markers: Collection[str]) -> Column:
    """Whether a marker is part of any key or value."""
    hit = lambda x: F.coalesce(reduce(or_, (F.contains(F.lower(x), F.lit(m)) for m in markers), F.lit(False)), F.lit(False))
    return F.coalesce(F.exists(F.map_entries(tags), lambda e: hit(e["key"]) | hit(e["value"])), F.lit(False))


def dead_findings(assets: DataFrame, edges: DataFrame, columns: DataFrame, markers: Collection[str] = TERMINAL, whitelist: Collection[str] = ()) -> DataFrame:
    """A finding for each dead end that is an asset, isn't on the whitelist and has no terminal tag (``tags``, a
    map, where assets have it). columns(name, n_columns): a node costs 1 more than its columns, and a dead end
    wastes its own cost and that of all before it."""
    degrees = graph.degrees(assets, edges)
    asked = assets.where(~terminal(F.col("tags"), markers)) if "tags" in assets.columns else assets
    dead = graph.dead_ends(degrees).join(asked.select("name"), "name", "left_semi").where(~F.col("name").isin(*whitelist))
    back = graph.closure(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), dead)
    chain = back.select("start", "reached").unionByName(dead.select(F.col("name").alias("start"), F.col("name").alias("reached"))).distinct()
    cost = chain.join(columns.select(F.col("name").alias("reached"), "n_columns"), "reached", "left")
    waste = cost.groupBy(F.col("start").alias("name")).agg(F.sum(1 + F.coalesce("n_columns", F.lit(0))).alias("waste"))
    rows = waste.join(graph.exclusive_feeders(edges), "name", "left").withColumn("feeders", F.coalesce("feeders", F.lit(0)))
    text = F.concat(F.lit("No downstream consumers; "), F.col("feeders").cast("string"), F.lit(" exclusive upstream feeder(s); estimated wasted compute (chain complexity)="), F.col("waste").cast("string"))
    return rows.select(scores.dead_severity(F.col("waste"), F.col("feeders")).alias("severity"), F.lit("dead_asset").alias("category"), F.col("name").alias("asset_name"), text.alias("message"))


def dead_score(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: score, 100 without assets."""
    n = assets.agg(F.count("*").alias("total"))
    dead = findings.agg(F.count("*").alias("dead"))
    share = F.bround(F.col("dead") / F.nullif(F.col("total"), F.lit(0)) * 100, 0)
    return n.join(F.broadcast(dead), F.lit(True)).select(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), 100 - share)), F.lit(100)).cast("int").alias("score"))


def complexity(assets: DataFrame, edges: DataFrame, sql_counts: DataFrame) -> DataFrame:
    """name, four shares of the largest (0 to 100), and combined (not rounded). sql_counts(name, sql)."""
    degrees = graph.degrees(assets, edges).select("name", F.col("out_degree").alias("fanout"), F.col("in_degree").alias("fanin"))
    rows = assets.select("name").join(graph.depths(assets, edges), "name", "left").join(degrees, "name", "left").join(sql_counts, "name", "left")
    parts = ["depth", "fanout", "fanin", "sql"]
    rows = graph.checkpointed(rows.select("name", *(F.coalesce(c, F.lit(0)).alias(c) for c in parts)))
    largest = rows.agg(*(F.max(c).alias(f"max_{c}") for c in parts))  # one row
    share = lambda c: F.when(F.col(f"max_{c}") > 0, F.col(c) / F.nullif(F.col(f"max_{c}"), F.lit(0)) * 100).otherwise(0.0).alias(f"{c}_score")
    shares = rows.join(F.broadcast(largest), F.lit(True)).select("name", *map(share, parts))
    return shares.withColumn("combined", F.expr(" + ".join(f"{WEIGHT}D * {c}_score" for c in parts)))


def complexity_summary(combined: DataFrame) -> DataFrame:
    """One row: score (mean), threshold (80th percentile, interpolated), above (rows at or above it and of 1 or more)."""
    n = combined.agg(F.avg("combined").alias("mean"), F.percentile("combined", F.lit(PERCENTILE)).alias("p"))
    hit = (F.col("combined") >= F.col("p") - 1e-9) & (F.col("combined") >= 1)
    above = combined.join(F.broadcast(n), F.lit(True)).agg(F.count_if(hit).alias("above"))
    return n.join(F.broadcast(above), F.lit(True)).select(F.coalesce(F.bround("mean", 0), F.lit(0)).cast("int").alias("score"), F.coalesce(F.bround("p", 6), F.lit(0.0)).alias("threshold"), "above")


def complexity_findings(combined: DataFrame) -> DataFrame:
    """Findings for those at or above the 80th percentile, if their complexity is 1 or more."""
    n = combined.agg(F.percentile("combined", F.lit(PERCENTILE)).alias("p"))  # one row
    rows = combined.join(F.broadcast(n), F.lit(True)).where((F.col("combined") >= F.col("p") - 1e-9) & (F.col("combined") >= 1))
    text = F.format_string("Complexity %.1f at/above 80th percentile (threshold %.1f)", "combined", "p")
    return rows.select(F.lit("warning").alias("severity"), F.lit("high_complexity").alias("category"), F.col("name").alias("asset_name"), text.alias("message"))


def stale(commits: DataFrame, as_of: Column) -> DataFrame:
    """commits(asset_name, at): findings for those over 183 days before ``as_of``."""
    rows = commits.where(F.col("at") < as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS"))
    text = F.concat(F.lit("Last commit on file is older than ~6 months ("), F.date_format("at", "yyyy-MM-dd"), F.lit(")"))
    return rows.select(F.lit("warning").alias("severity"), F.lit("stale_asset").alias("category"), "asset_name", text.alias("message"))


def richness(names: Column) -> Column:
    """"low" if tests only ask for values that aren't null."""
    lower = F.transform(names, F.lower)
    strong = F.exists(lower, lambda n: n.rlike("|".join(STRONG)))
    only = F.forall(lower, lambda n: n.contains("not_null"))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "ok").when(strong, "ok").when(only, "low").otherwise("ok")


def overall_health(scores_: DataFrame) -> DataFrame:
    """scores(dimension, score) to one row: the mean, with complexity counted backwards; 100 without scores."""
    value = F.when(F.col("dimension").isin(POSITIVE), F.col("score")).when(F.col("dimension") == "complexity", F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("score"))))
    return scores_.agg(F.coalesce(F.bround(F.avg(value), 0), F.lit(100)).cast("int").alias("overall"))


def annotations(findings: DataFrame, title: str = "quarryline") -> DataFrame:
    """A line for each finding, in the form that hosted CI shows beside a change."""
    severity = F.lower("severity")
    level = F.when(severity == "critical", "error").when(severity == "warning", "warning").otherwise("notice")
    return findings.select(F.format_string(f"::%s title={title}::%s [%s] %s", level, "category", "asset_name", "message").alias("line"))


def added(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys that are new; with the tables exchanged, those that are gone."""
    return now.select(*key).subtract(before.select(*key))
