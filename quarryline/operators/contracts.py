"""Data contracts against assets: what a contract asks for and an asset lacks, has beyond it, or types otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import canonical_type
from quarryline.operators import scores


def matched(contracts: DataFrame, assets: DataFrame) -> DataFrame:
    """contracts(file_path, dataset, columns: map to types) with columns, each with the asset it is about (name null if there is none).
    assets(name, columns, column_types, ord), in scope; names that occur again match by their first row."""
    asked = contracts.where(F.size("columns") > 0)
    best = scores.best_asset(asked.select("dataset").distinct(), assets)
    first = assets.groupBy("name").agg(F.min_by(F.struct(F.col("columns").alias("a_columns"), F.col("column_types").alias("a_types")), "ord").alias("a"))
    return asked.join(best, "dataset", "left").join(first, "name", "left").select("file_path", "dataset", "columns", "name", "tier", "a.a_columns", "a.a_types")


def drift(rows: DataFrame) -> DataFrame:
    """rows of matched() with issues: array of (severity, category, message), empty where the asset complies."""
    issue = lambda severity, kind, message: F.struct(F.lit(severity).alias("severity"), F.lit(f"contract_{kind}").alias("category"), message.alias("message"))
    keys, has = F.map_keys("columns"), F.coalesce("a_columns", F.expr("cast(array() as array<string>)"))
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    missing = F.transform(F.array_sort(F.array_except(keys, has)), lambda c: issue("warning", "missing_column", F.concat(F.lit("Contract requires column "), quoted(c), F.lit(" not present on asset "), quoted(F.col("name")))))
    extra = F.transform(F.array_sort(F.array_except(has, keys)), lambda c: issue("info", "extra_column", F.concat(F.lit("Asset "), quoted(F.col("name")), F.lit(" has column "), quoted(c), F.lit(" not listed in contract"))))
    asked, actual = (lambda c: F.try_element_at("columns", c)), (lambda c: F.try_element_at("a_types", c))
    other = F.filter(F.array_sort(F.array_intersect(keys, has)), lambda c: F.coalesce(canonical_type(asked(c)) != canonical_type(actual(c)), F.lit(False)))
    types = F.transform(
        other, lambda c: issue("warning", "type_mismatch", F.concat(F.lit("Column "), quoted(c), F.lit(": contract type "), quoted(asked(c)), F.lit(" vs actual "), quoted(actual(c)), F.lit(" (asset "), quoted(F.col("name")), F.lit(")")))
    )
    none = F.array(issue("warning", "asset_not_found", F.concat(F.lit("No matching asset for contract dataset "), quoted(F.col("dataset")), F.lit(" (file "), F.col("file_path"), F.lit(")"))))
    return rows.withColumn("issues", F.when(F.col("name").isNull(), none).otherwise(F.concat(missing, extra, types)))


def findings(rows: DataFrame) -> DataFrame:
    """rows of drift() to findings, under the dataset's name and the contract's file."""
    each = rows.select("dataset", "file_path", F.explode("issues").alias("i"))
    return each.select("i.severity", "i.category", F.col("dataset").alias("asset_name"), "i.message", "file_path")


def summary(rows: DataFrame) -> DataFrame:
    """One row: total, compliant, ratio, score."""
    n = rows.agg(F.count("*").alias("total"), F.count_if(F.size("issues") == 0).alias("compliant"))
    ratio = F.bround(F.col("compliant") / F.nullif("total", F.lit(0)), 6)
    return n.select("total", "compliant", ratio.alias("ratio"), scores.share_score(F.col("compliant"), F.col("total")).alias("score"))
