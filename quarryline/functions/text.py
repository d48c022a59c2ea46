"""Source text as columns: classification, template references, type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Template patterns.
REF = r"\{\{\s*ref\(['\"]([^'\"]+)['\"]\)\s*\}\}"
SOURCE = r"\{\{\s*source\(['\"]([^'\"]+)['\"],\s*['\"]([^'\"]+)['\"]\)\s*\}\}"
CONFIG = r"(?s)\{\{\s*config\((.+?)\)\s*\}\}"
COMMENT, BLOCK, EXPRESSION = r"(?s)\{#.*?#\}", r"(?s)\{%.*?%\}", r"(?s)\{\{.*?\}\}"
#: Type families.
FAMILIES = {
    "integer": ["int", "integer", "bigint", "smallint", "tinyint"],
    "string": ["varchar", "nvarchar", "text", "string"],
    "float": ["float", "double", "real"],
    "numeric": ["decimal", "numeric", "number"],
    "boolean": ["bool", "boolean"],
    "timestamp": ["timestamp", "timestamptz", "datetime"],
    "date": ["date"],
}


def file_type(path: Column, content: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    base = F.lower(name)
    yaml = base.endswith(".yml") | base.endswith(".yaml")
    return (
        F.when(base.endswith(".sql") & F.array_contains(F.split(path, "/"), "models"), "dbt_model")
        .when(yaml & (base.contains("schema") | base.contains("sources")), "dbt_schema")
        .when(name == "dbt_project.yml", "dbt_project")
        .when(base.endswith(".sql"), "sql")
        .when(base.endswith(".py") & (content.contains("from airflow") | content.contains("DAG(")), "airflow_dag")
        .when(base.endswith(".py") & (content.contains("SparkSession") | content.contains("spark.read")), "spark_job")
        .when(yaml & (content.contains("dataContractSpecification") | content.contains("dataset:")), "data_contract")
    )


def refs(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(REF), F.lit(1)))


def sources(content: Column) -> Column:
    pairs = F.arrays_zip(F.regexp_extract_all(content, F.lit(SOURCE), F.lit(1)).alias("a"), F.regexp_extract_all(content, F.lit(SOURCE), F.lit(2)).alias("b"))
    return F.array_distinct(F.transform(pairs, lambda x: F.concat(x["a"], F.lit("."), x["b"])))


def without_templates(content: Column) -> Column:
    for pattern, put in ((CONFIG, " "), (REF, "$1"), (SOURCE, "$1.$2"), (COMMENT, " "), (BLOCK, " "), (EXPRESSION, " ")):
        content = F.regexp_replace(content, pattern, put)
    return content


def canonical_type(kind: Column) -> Column:
    base = F.regexp_extract(F.lower(F.trim(F.regexp_replace(kind, r"\s+", " "))), r"^[^ (]*", 0)
    out = base
    for family, members in FAMILIES.items():
        out = F.when(base.isin(members), family).otherwise(out)
    return F.nullif(out, F.lit(""))


def has_excluded_part(path: Column, excluded: list[str]) -> Column:
    """Whether a part of the path is one of these names, in any case."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*(F.lit(x.lower()) for x in excluded))) if excluded else F.lit(False)


def excluded_names(raw: str | None) -> list[str]:
    """Names of a list parted by commas or semicolons, trimmed, in lower case."""
    return sorted({x.strip().lower() for x in (raw or "").replace(";", ",").split(",")} - {""})


def listed(raw: str | None, default: tuple[str, ...] = ()) -> tuple[str, ...]:
    """A comma list of the command line; the default where it isn't given, nothing where it is empty."""
    return default if raw is None else tuple(sorted({x.strip() for x in raw.split(",")} - {""}))


def stem(path: Column) -> Column:
    """A file's name without its last ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def folders(path: Column) -> Column:
    """All folders that a path is under, the top one ("") first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def is_mart(path: Column, name: Column) -> Column:
    p, n = F.lower(path), F.lower(name)
    return p.contains("marts") | p.contains("/mart/") | p.contains("intermediate") | p.contains("/int/") | n.startswith("fct_") | n.startswith("dim_") | n.startswith("mart_")
