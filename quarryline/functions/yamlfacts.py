"""What YAML files say about models, sources, projects and contracts. Values of another kind than expected are passed over."""

from __future__ import annotations

import yaml

ENTRY = (
    "struct<kind:string,name:string,description:string,has_docs:boolean,has_tests:boolean,columns:array<string>,types:map<string,string>,"
    "tests:array<string>,owner:string,partition_key:string,at:int>"
)
PROJECT = "struct<name:string,model_paths:array<string>>"
CONTRACT = "struct<dataset:string,columns:map<string,string>,at:int>"
#: Keys that name a thing, and that give a column's type in the older form.
NAMES = ("name", "physicalName", "logicalName")
TYPES = ("type", "logicalType", "physicalType", "dataType")


def load(content: str) -> dict:
    try:
        found = yaml.safe_load(content)
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def said(value: object) -> str | None:
    """A string that isn't blank, stripped."""
    return value.strip() if isinstance(value, str) and value.strip() else None


def dicts(value: object) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def test_names(value: object) -> list[str]:
    if not isinstance(value, list):
        return []
    return [str(y) for x in value for y in ([x] if isinstance(x, str) else x if isinstance(x, dict) else [])]


def entry(kind: str, name: str, given: dict, at: int) -> dict:
    columns = [x for x in dicts(given.get("columns")) if isinstance(x.get("name"), str)]
    every = dicts(given.get("columns"))
    described = said(given.get("description"))
    meta = given.get("meta") if isinstance(given.get("meta"), dict) else {}
    tested = [x for x in (given, *(every if kind == "model" else columns)) if isinstance(x.get("tests"), list) and x["tests"]]
    noted = [x for x in (every if kind == "model" else columns) if said(x.get("description"))]
    names = [x["name"] for x in columns]
    return {
        "kind": kind, "name": name, "description": given["description"] if described or (kind == "source" and isinstance(given.get("description"), str)) else None,
        "has_docs": bool(described or noted), "has_tests": bool(tested), "columns": list(dict.fromkeys(names)) if kind == "model" else names,
        "types": {x["name"]: said(x["data_type"]) for x in columns if said(x.get("data_type"))}, "tests": [y for x in tested for y in test_names(x["tests"])],
        "owner": said(meta.get("owner")), "partition_key": said(meta.get("partition_key")), "at": at,
    }


def schema_entries(path: str, content: str) -> list[dict]:
    """Models and tables of sources, in order."""
    found, out = load(content), []
    for model in dicts(found.get("models")):
        if isinstance(model.get("name"), str):
            out.append(entry("model", model["name"], model, len(out)))
    for source in dicts(found.get("sources")):
        for table in dicts(source.get("tables")):
            if isinstance(source.get("name"), str) and isinstance(table.get("name"), str):
                out.append(entry("source", f"{source['name']}.{table['name']}", table, len(out)))
    return out


def project(path: str, content: str) -> list[dict]:
    found = load(content)
    paths = found.get("model-paths", ["models"])
    listed = [x for x in paths if isinstance(x, str)] if isinstance(paths, list) else [paths] if isinstance(paths, str) else ["models"]
    return [{"name": str(found["name"]) if "name" in found else None, "model_paths": listed}]


def first_said(given: dict, keys: tuple[str, ...]) -> str | None:
    return next((x for k in keys if (x := said(given.get(k)))), None)


def contracts(path: str, content: str) -> list[dict]:
    """Datasets with columns: those under ``schema``, or else the one under ``dataset``."""
    found = load(content)
    out = []
    for table in dicts(found.get("schema")):
        columns = {n: said(x.get("logicalType")) or said(x.get("physicalType")) for x in dicts(table.get("properties")) if (n := first_said(x, NAMES))}
        if (name := first_said(table, NAMES)) and columns:
            out.append({"dataset": name, "columns": columns, "at": len(out)})
    dataset = found.get("dataset")
    if not out and isinstance(dataset, dict) and (name := first_said(dataset, NAMES)):
        columns = {n: said(next((x[k] for k in TYPES if x.get(k)), None)) for x in dicts(dataset.get("schema")) if (n := first_said(x, NAMES))}
        if columns:
            out.append({"dataset": name, "columns": columns, "at": 0})
    return out
