"""Cost hotspots: patterns in SQL files, weighted by what is downstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much a downstream node adds, how many count, and how much average weight takes off the score.
PER_NODE, MOST_NODES, PENALTY, RANKED = 0.12, 50, 8.0, 50
PARTITION = "MISSING_PARTITION_FILTER"


def partition_keys(assets: DataFrame) -> DataFrame:
    """name, partition_key, ord: from tags, the last row of a name wins, at the place of its first."""
    key = F.regexp_replace(F.try_element_at("tags", F.lit("partition_key")), r"^\s+|\s+$", "")
    rows = assets.select("name", key.alias("partition_key"), "ord").where("partition_key <> ''")
    return rows.groupBy("name").agg(F.max_by("partition_key", "ord").alias("partition_key"), F.min("ord").alias("ord"))


def eligible(assets: DataFrame) -> DataFrame:
    role = F.coalesce(F.try_element_at("tags", F.lit("role")), F.lit(""))
    return assets.where(F.lower("file_path").endswith(".sql") & (role != "query_block") & F.col("asset_type").isin("dbt_model", "table", "view"))


def weight(patterns: Column, downstream: Column) -> Column:
    return F.when(patterns > 0, patterns * (1 + PER_NODE * F.least(F.lit(MOST_NODES), downstream))).otherwise(0.0)


def hotspots(assets: DataFrame, patterns: DataFrame, unfiltered: DataFrame, descendants: DataFrame) -> DataFrame:
    """Eligible assets whose file has patterns: name, file_path, patterns, pattern_count, downstream, weight (4 places), ord.
    patterns(path, patterns); unfiltered(path): files that miss a partition filter; descendants(name, descendants)."""
    missed = unfiltered.select("path", F.lit(PARTITION).alias("missed")).distinct()
    by_file = patterns.join(missed, "path", "left").select(F.col("path").alias("file_path"), F.array_union("patterns", F.array_compact(F.array("missed"))).alias("patterns")).where(F.size("patterns") > 0)
    rows = eligible(assets).select("name", "file_path", "ord").join(by_file, "file_path").join(descendants, "name", "left")
    down = F.coalesce("descendants", F.lit(0))
    return rows.select("name", "file_path", "patterns", F.size("patterns").alias("pattern_count"), down.cast("long").alias("downstream"), F.bround(weight(F.size("patterns"), down), 4).alias("weight"), "ord")


def findings(rows: DataFrame) -> DataFrame:
    text = F.format_string("Static cost signals: %s (downstream nodes: %d, weighted impact: %.2f)", F.array_join("patterns", ", "), F.col("downstream"), F.col("weight"))
    return rows.select(F.lit("warning").alias("severity"), F.lit("cost_hotspot").alias("category"), F.col("name").alias("asset_name"), text.alias("message"), "file_path")


def ranked(rows: DataFrame, most: int = RANKED) -> DataFrame:
    """The heaviest, ties in the order of assets."""
    return rows.orderBy(F.desc("weight"), "ord").limit(most)


def summary(rows: DataFrame) -> DataFrame:
    """One row: score (100 without hotspots), instances, heaviest."""
    n = rows.agg(F.avg("weight").alias("mean"), F.coalesce(F.sum("pattern_count"), F.lit(0)).cast("long").alias("instances"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("heaviest"))
    score = F.bround(100 - F.least(F.lit(100.0), F.col("mean") * PENALTY), 0)
    return n.select(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), score)), F.lit(100)).cast("int").alias("score"), "instances", "heaviest")
