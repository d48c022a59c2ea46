"""Facts of files as DataFrames: one Arrow pass a file type, errors kept beside the facts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarryline.functions import pyfacts, sqlfacts, text, yamlfacts

Reader = Callable[[str, str], list[dict]]


def _read(batches: Iterator[pa.RecordBatch], read: Reader, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            facts, warning = [], None
            try:
                facts = read(path, content or "")
            except Exception as e:  # a file that can't be read is a warning, the scan goes on
                warning = f"{path}: skipped ({type(e).__name__}: {e})"
            rows.append({"path": path, "facts": facts, "warning": warning})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def facts(files: DataFrame, read: Reader, struct: str) -> DataFrame:
    """files(path, content) to path, facts (array of struct) and warning (null where all went well)."""
    spec = f"path string, facts array<{struct}>, warning string"
    return files.select("path", "content").mapInArrow(partial(_read, read=read, schema=to_arrow_schema(T.StructType.fromDDL(spec))), spec)


def _sql(path: str, content: str, dialect: str | None) -> list[dict]:
    return sqlfacts.sql_facts(content, dialect)


def sql_statements(files: DataFrame, dialect: str | None = None) -> DataFrame:
    """path, facts: a row's statements with all that later operators ask of SQL text."""
    return facts(files, partial(_sql, dialect=dialect), sqlfacts.STATEMENT)


def airflow_facts(files: DataFrame) -> DataFrame:
    return facts(files, pyfacts.airflow, pyfacts.AIRFLOW)


def spark_facts(files: DataFrame) -> DataFrame:
    return facts(files, pyfacts.spark_job, pyfacts.SPARK)


def schema_facts(files: DataFrame) -> DataFrame:
    return facts(files, yamlfacts.schema_entries, yamlfacts.ENTRY)


def project_facts(files: DataFrame) -> DataFrame:
    return facts(files, yamlfacts.project, yamlfacts.PROJECT)


def contract_facts(files: DataFrame) -> DataFrame:
    return facts(files, yamlfacts.contracts, yamlfacts.CONTRACT)


def leading_documentation(content: Column) -> Column:
    """Whether text opens, after white space, with a comment that says something."""
    start = F.regexp_replace(content, r"^[﻿ \t\n\r]+", "")
    block = start.startswith("/*") & (F.length(F.regexp_replace(F.regexp_extract(start, r"(?s)^/\*(.*?)\*/", 1), r"\s", "")) > 0)
    line = F.regexp_extract(start, r"^(--[^\n\r]*)", 1)
    return F.coalesce(block | (F.length(F.regexp_replace(line, r"\s+$", "")) > 2), F.lit(False))


def features(statements: DataFrame) -> DataFrame:
    """path, joins, subqueries, ctes, cases, total over a file's statements."""
    total = lambda c: F.aggregate("facts", F.lit(0), lambda n, s: n + s[c]).alias(c)
    names = ["joins", "subqueries", "ctes", "cases"]
    return statements.select("path", *map(total, names)).withColumn("total", F.expr(" + ".join(names)))


def cost_patterns(statements: DataFrame) -> DataFrame:
    """path, patterns: distinct, in order of statements."""

    def of(s: Column) -> Column:
        select = s["kind"] == "select"
        named = [
            (s["star"], "SELECT_STAR"), (s["cross_join"], "CROSS_JOIN"), (s["kind"].isin("delete", "update") & ~s["has_where"], "MISSING_WHERE_CLAUSE"),
            (select & s["has_from"] & ~s["has_where"], "SELECT_WITHOUT_WHERE"), (select & s["has_from"] & ~s["limited"], "NO_LIMIT"),
        ]
        return F.array_compact(F.array(*(F.when(hit, name) for hit, name in named)))

    return statements.select("path", F.array_distinct(F.flatten(F.transform("facts", of))).alias("patterns"))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def missing_partition_filters(statements: DataFrame, keys: DataFrame) -> DataFrame:
    """Paths in which a SELECT reads a table with a partition key and its own WHERE doesn't name that key.
    keys(name, partition_key, ord): exact names first, else the first with the same last segment in any case."""
    selects = statements.select("path", F.posexplode("facts").alias("i", "s")).select("path", "i", F.posexplode("s.selects").alias("j", "x"))
    asked = selects.select("path", F.explode("x.tables").alias("table"), "x.where_columns")
    exact = keys.groupBy(F.col("name").alias("table")).agg(F.max_by("partition_key", "ord").alias("exact"))
    near = keys.groupBy(F.lower(last_segment(F.col("name"))).alias("low")).agg(F.min_by("partition_key", "ord").alias("near"))
    found = asked.join(exact, "table", "left").withColumn("low", F.lower(last_segment(F.col("table")))).join(near, "low", "left")
    key = F.lower(F.coalesce("exact", "near"))
    return found.where(key.isNotNull() & ~F.array_contains("where_columns", key)).select("path").distinct()


def sql_assets(files: DataFrame, statements: DataFrame) -> DataFrame:
    """Assets of plain SQL files: created tables and views, and a block for each SELECT."""
    documented = files.select("path", leading_documentation(F.col("content")).alias("has_docs"))
    each = statements.select("path", F.explode("facts").alias("s")).join(documented, "path")
    is_block = F.col("s.kind") == "select"
    rows = each.where(is_block | ((F.col("s.kind") == "create") & F.col("s.target").isNotNull()))
    block = F.create_map(F.lit("role"), F.lit("query_block"))
    return rows.select(
        F.when(is_block, F.concat("path", F.lit("#select"), F.col("s.idx").cast("string"))).otherwise(F.col("s.target")).alias("name"),
        F.when(is_block, "view").otherwise(F.col("s.target_kind")).alias("asset_type"), F.col("path").alias("file_path"), "s.columns", F.col("s.types").alias("column_types"), "has_docs",
        F.when(is_block, block).otherwise(F.expr("cast(map() as map<string,string>)")).alias("tags"), F.col("s.idx").alias("at"),
    )


def sql_edges(statements: DataFrame) -> DataFrame:
    """source, target, file_path, at: from each table that a statement reads to what it makes."""
    each = statements.select("path", F.explode("facts").alias("s"))
    target = F.when(F.col("s.kind") == "select", F.concat("path", F.lit("#select"), F.col("s.idx").cast("string"))).when(F.col("s.kind").isin("create", "insert"), F.col("s.target"))
    rows = each.select(F.explode("s.sources").alias("source"), target.alias("target"), F.col("path").alias("file_path"), F.col("s.idx").alias("at"))
    return rows.where("target is not null")


def model_tables(files: DataFrame, dialect: str | None = None) -> DataFrame:
    """path, tables: what a template's SQL reads once its marks are taken out."""
    plain = files.select("path", text.without_templates(F.col("content")).alias("content"))
    return sql_statements(plain, dialect).select("path", F.array_distinct(F.flatten(F.transform("facts", lambda s: s["sources"]))).alias("tables"))


def spark_edges(jobs: DataFrame) -> DataFrame:
    """Each table that a job reads to each that it writes."""
    each = jobs.select("path", F.explode("facts").alias("s"))
    return each.select("path", F.explode("s.writes").alias("target"), "s.reads").select(F.explode("reads").alias("source"), "target", F.col("path").alias("file_path"), F.lit(0).alias("at"))
