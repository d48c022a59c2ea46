"""Owners of files: rules of a CODEOWNERS file, declared owners, authors of last commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import scores

#: Fixed value: part of what a later diff compares findings by.
NO_OWNER = "No identifiable owner: add CODEOWNERS, dbt meta.owner, or commit history"


def rules(texts: DataFrame) -> DataFrame:
    """texts(content) to line, pattern, owners (joined by ", "): lines with a pattern and at least one owner, comments taken off."""
    lines = texts.select(F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("line", "raw"))
    parts = F.filter(F.split(F.regexp_replace("raw", "#.*$", ""), r"\s+"), lambda x: x != "")
    return lines.select("line", parts.alias("parts")).where(F.size("parts") >= 2).select(
        "line", F.get("parts", F.lit(0)).alias("pattern"), F.array_join(F.slice("parts", 2, 1_000_000), ", ").alias("owners")
    )


def as_regex(pattern: Column) -> Column:
    """A path pattern as a regex over whole paths, null for one that matches nothing. Without a slash (a leading one doesn't count)
    it matches names in any folder; ``**`` stands for any number of folders; a trailing slash matches nothing."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\\", "/"), "^/", "")
    safe = F.regexp_replace(plain, r"([.+^${}()|])", r"\\$1")
    many, some = "\x01", "\x02"
    part = lambda x: F.when(x == "**", many).otherwise(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\[!", "[^"), r"\*+", some), r"\?", "[^/]"), some, "[^/]*")
    )
    whole = F.array_join(F.transform(F.split(safe, "/"), part), "/")
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, f"^{many}$", ".*"), f"/{many}$", "(?:/.*)?"), f"{many}/", "(?:[^/]+/)*")
    anywhere = F.when(plain.contains("/"), "").otherwise("(?:.*/)?")
    return F.when((plain != "") & ~plain.startswith("#") & ~plain.endswith("/"), F.concat(F.lit("^(?:"), anywhere, F.regexp_replace(whole, many, "[^/]*"), F.lit(")$")))


def owned(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """path, owners: the last rule that matches wins; null where none does."""
    return scores.last_match(paths, rules_.withColumn("pattern", as_regex(F.col("pattern"))).where("pattern is not null"))


def resolved(assets: DataFrame, rules_: DataFrame, commits: DataFrame, prefix: str = "") -> DataFrame:
    """assets in scope with owner: by a rule, else as declared, else the last author; and at, the last commit's time.
    commits(path, author, at); prefix: what rules see before an asset's path."""
    by_rule = owned(assets.select(F.concat(F.lit(prefix), "file_path").alias("path")).distinct(), rules_).withColumnRenamed("owners", "__rule")
    declared = F.nullif(F.regexp_replace("owner", r"^\s+|\s+$", ""), F.lit(""))
    rows = assets.withColumn("path", F.concat(F.lit(prefix), "file_path")).join(by_rule, "path", "left").drop("path")
    rows = rows.join(commits.select(F.col("path").alias("file_path"), F.col("author").alias("__author"), "at"), "file_path", "left")
    return rows.withColumn("owner", F.coalesce("__rule", declared, F.nullif("__author", F.lit("")))).drop("__rule", "__author")


def unowned(rows: DataFrame) -> DataFrame:
    return rows.where("owner is null").select(F.lit("warning").alias("severity"), F.lit("no_owner").alias("category"), F.col("name").alias("asset_name"), F.lit(NO_OWNER).alias("message"))


def summary(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: total, with_owner, no_owner, stale, ratio, score."""
    n = rows.agg(F.count("*").alias("total"), F.count("owner").alias("with_owner")).join(F.broadcast(stale.agg(F.count("*").alias("stale"))), F.lit(True))  # one row each
    ratio = F.bround(F.col("with_owner") / F.nullif("total", F.lit(0)), 6)
    return n.select("total", "with_owner", (F.col("total") - F.col("with_owner")).alias("no_owner"), "stale", ratio.alias("ratio"), scores.share_score(F.col("with_owner"), F.col("total")).alias("score"))
