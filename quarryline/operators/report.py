"""What a scan writes: the payload, snapshots, a history of scores, a page, a summary for the terminal.

Reports are for people, so their rows (assets, edges, findings of a repository) are gathered on
the driver here and nowhere else; the DataFrames they come from have no bound."""

from __future__ import annotations

import html
import json
import os
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import graph

SEVERITIES = ["critical", "warning", "info"]
#: Rows shown of findings, edges, warnings and differences; entries kept of the history; days that snapshots are kept.
FINDINGS, EDGES, WARNINGS, DIFFERENCES, HISTORY, DAYS = 12, 20, 25, 30, 30, 30
RETENTION = "QUARRYLINE_SNAPSHOT_DAYS"


def rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity)), F.lit(0)).cast("int")


def all_findings(parts: list[DataFrame]) -> DataFrame:
    """Findings of analyzers in their order, which ``analyzer`` gives."""
    out = None
    for n, part in enumerate(parts):
        part = part.withColumn("analyzer", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def top_findings(findings: DataFrame, most: int = FINDINGS) -> DataFrame:
    """The gravest, those of earlier analyzers first, then by asset and message."""
    return findings.orderBy(rank(F.col("severity")), "analyzer", "asset_name", "message").limit(most)


def export_graph(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, file, importance: all nodes, with how many they reach; one on a cycle reaches itself."""
    known = graph.last_per_key(assets, ["name"]).select(F.col("name").alias("id"), F.col("asset_type").alias("type"), F.col("file_path").alias("file"))
    other = graph.reference_only(assets, edges).select(F.col("name").alias("id"), F.lit("external").alias("type"), F.lit("").alias("file"))
    reach = graph.closure(edges).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("n"))
    return known.unionByName(other).join(reach, "id", "left").select("id", "type", "file", F.coalesce("n", F.lit(0)).cast("long").alias("importance"))


def last_of_history(history: DataFrame, most: int = HISTORY) -> DataFrame:
    """history(value): JSON lines with scan_date; the last ones that can be read."""
    spec = "scan_date string, overall int, scores map<string,int>"
    read = history.select(F.from_json("value", spec, {"mode": "PERMISSIVE"}).alias("h")).where("h.scan_date is not null").select("h.*")
    return read.orderBy(F.desc("scan_date")).limit(most)


def daily(snapshots: DataFrame) -> DataFrame:
    """snapshots(at, payload): the last of each day."""
    return snapshots.groupBy(F.to_date("at").alias("day")).agg(F.max_by("payload", "at").alias("payload"))


def pruned(snapshots: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """Snapshots of the last days, and the last of each day before."""
    order = F.row_number().over(Window.partitionBy(F.to_date("at")).orderBy(F.desc("at")))
    rows = snapshots.withColumn("__n", order)
    return rows.where((F.col("at") >= now - F.make_interval(days=F.lit(days))) | (F.col("__n") == 1)).drop("__n")


def retention() -> int:
    """Days to keep snapshots, from the environment; what isn't a number counts as the default, less than none as none."""
    try:
        return max(0, int(os.environ.get(RETENTION, DAYS)))
    except ValueError:
        return DAYS


def parsed_counts(files: DataFrame, project_roots: DataFrame, inside: DataFrame) -> DataFrame:
    """One row: files found, and parsed by kind. inside(path): model files of projects, which projects count."""
    kinds = files.join(inside.withColumn("__in", F.lit(True)), "path", "left")
    sql = (F.col("file_type") == "sql") | ((F.col("file_type") == "dbt_model") & F.col("__in").isNull())
    n = kinds.agg(
        F.count("*").alias("discovered_file_count"), F.count_if(sql).alias("parsed_sql_file_count"), F.count_if(F.col("file_type") == "airflow_dag").alias("parsed_airflow_file_count"), F.count_if(F.col("file_type") == "spark_job").alias("parsed_spark_file_count")
    )
    return n.join(F.broadcast(project_roots.agg(F.count("*").alias("parsed_dbt_project_count"))), F.lit(True))  # one row each


def rows_of(df: DataFrame, *columns: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.select(*columns).collect()]


def write_json(path: str, data: object) -> None:
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_snapshot(folder: str, payload: dict, now: datetime | None = None) -> str | None:
    """The day's snapshot and one of this moment; old ones of moments go. None where the folder can't be written."""
    now = now or datetime.now(tz=UTC)
    try:
        os.makedirs(folder, exist_ok=True)
        day = os.path.join(folder, f"{now:%Y-%m-%d}.json")
        for path in (day, os.path.join(folder, f"{now:%Y-%m-%dT%H%M%S}.json")):
            write_json(path, payload)
        for old in Path(folder).glob("*.json"):
            if len(old.name) != len("2024-01-01.json") and old.stat().st_mtime < time.time() - retention() * 86_400:
                old.unlink()
        return day
    except OSError:
        return None


def append_history(path: str, entry: dict) -> list[dict]:
    """The last entries, this one among them; lines that can't be read are passed over."""
    kept = []
    if os.path.isfile(path):
        for line in Path(path).read_text(encoding="utf-8", errors="ignore").splitlines():
            try:
                found = json.loads(line)
            except ValueError:
                continue
            kept += [found] * isinstance(found, dict)
    kept = [*kept, entry][-HISTORY:]
    Path(path).write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in kept), encoding="utf-8")
    return kept


def tone(score: float) -> str:
    return "good" if score >= 85 else "warn" if score >= 65 else "bad"


def page(payload: dict, nodes: list[dict], history: list[dict], overall: int) -> str:
    """A self-contained page: scores, their history, the graph as data and a drawing, findings that a click sorts."""
    cards = "".join(f'<div class="card {tone(100 - v if k == "complexity" else v)}"><b>{v}</b>{html.escape(k)}</div>' for k, v in {"overall": overall, **payload["scores"]}.items())
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(f.get(c) or ''))}</td>" for c in ("severity", "category", "asset_name", "message", "file_path")) + "</tr>" for f in payload["findings"])
    points = " ".join(f"{10 + 580 * i / max(1, len(history) - 1):.0f},{110 - h.get('overall', 0):.0f}" for i, h in enumerate(history))
    data = json.dumps({"nodes": nodes, "links": [{"source": e["source"], "target": e["target"]} for e in payload["edges"]]}).replace("</", "<\\/")
    return f"""<!doctype html><meta charset="utf-8"><title>Pipeline report</title>
<style>body{{font:14px sans-serif;margin:2em}}.card{{display:inline-block;padding:1em;margin:.3em;border-radius:6px}}.card b{{display:block;font-size:24px}}
.good{{background:#cfe8cf}}.warn{{background:#f3e3b3}}.bad{{background:#f0c4c0}}td,th{{padding:.3em .6em;text-align:left;cursor:default}}svg{{border:1px solid #ccc}}</style>
<h1>{html.escape(str(payload["scan_root"]))}</h1>{cards}<h2>History</h2><svg width="600" height="120"><polyline fill="none" stroke="#357" points="{points}"/></svg>
<h2>Graph</h2><svg id="graph" width="900" height="600"></svg><h2>Findings</h2><table id="findings"><thead><tr><th>severity<th>category<th>asset<th>message<th>file</tr></thead><tbody>{rows}</tbody></table>
<script>const graph={data};
const place=new Map(graph.nodes.map((n,i)=>[n.id,[450+400*Math.cos(6.283*i/graph.nodes.length),300+270*Math.sin(6.283*i/graph.nodes.length)]]));
const svg=document.getElementById("graph"),put=(k,a,t)=>{{const e=document.createElementNS("http://www.w3.org/2000/svg",k);for(const x in a)e.setAttribute(x,a[x]);if(t)e.textContent=t;svg.append(e);return e}};
for(const l of graph.links){{const a=place.get(l.source),b=place.get(l.target);if(a&&b)put("line",{{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:"#aaa"}})}}
for(const n of graph.nodes){{const p=place.get(n.id),c=put("circle",{{cx:p[0],cy:p[1],r:4+Math.sqrt(n.importance),fill:n.type==="external"?"#999":"#357"}});const t=document.createElementNS("http://www.w3.org/2000/svg","title");t.textContent=n.id;c.append(t)}}
document.querySelectorAll("th").forEach((h,i)=>h.onclick=()=>{{const b=document.querySelector("tbody");[...b.rows].sort((x,y)=>x.cells[i].textContent.localeCompare(y.cells[i].textContent)).forEach(r=>b.append(r))}});</script>"""


def terminal(payload: dict, overall: int) -> str:
    """Assets, first edges, the graph, scores, gravest findings and warnings, as text."""
    out = [f"{payload['scan_root']}: {payload['discovered_file_count']} files, overall health {overall}", "", "Assets"]
    out += [f"  {a['name']}  {a['asset_type']}  {a['file_path']}" for a in payload["assets"]]
    out += ["", "Edges", *(f"  {e['source']} -> {e['target']}" for e in payload["edges"][:EDGES])]
    out += [f"  ... {len(payload['edges']) - EDGES} more"] if len(payload["edges"]) > EDGES else []
    out += ["", "Graph", *(f"  {k}: {v}" for k, v in payload["graph"].items()), "", "Scores", *(f"  {k}: {v}" for k, v in payload["scores"].items())]
    gravest = sorted(payload["findings"], key=lambda f: SEVERITIES.index(f["severity"]))[:FINDINGS]
    out += ["", "Findings", *(f"  {f['severity']} {f['category']} {f['asset_name']}: {f['message']}" for f in gravest)]
    warnings = payload.get("parse_warnings", [])
    out += ["", "Warnings", *(f"  {w}" for w in warnings[:WARNINGS])] if warnings else []
    return "\n".join(out)
