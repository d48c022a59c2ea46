"""Command line: ``python -m quarryline.cli scan|diff|ci``."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import tempfile
from datetime import UTC, datetime

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline import __version__
from quarryline.functions.text import listed
from quarryline.operators import graph, impact, ownership, report
from quarryline.plans import scan
from quarryline.sources import repository

#: Dimensions, in the order of reports, and parts of the assets and findings that reports give.
DIMENSIONS = ["dead_assets", "test_coverage", "documentation", "complexity", "ownership", "contracts", "cost_hotspots"]
KEY = ["severity", "category", "asset_name", "message"]


def session() -> SparkSession:
    builder = SparkSession.builder.appName("quarryline").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    if SparkSession.getActiveSession() is None and SparkConf().get("spark.master", "local").startswith("local"):
        # a scan is many small plans, which take longer to compile than to run
        builder = builder.config("spark.sql.codegen.wholeStage", "false").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def run(spark: SparkSession, root: str, dialect: str | None = None, exclude: str | None = None, whitelist: str | None = None, terminal: str | None = None, critical: int = 10) -> tuple[scan.Extracted, scan.Analysis]:
    root = os.path.abspath(root)
    found = scan.extracted(repository.files(spark, root, exclude), dialect, os.path.basename(root))
    text, prefix = repository.owner_rules_text(root)
    rules = ownership.rules(spark.createDataFrame([(text,)], "content string"))
    now = F.lit(datetime.now(tz=UTC).isoformat()).cast("timestamp")
    return found, scan.analyzed(found, rules, repository.commits(spark, root), now, prefix, listed(whitelist), tuple(x.lower() for x in listed(terminal, impact.TERMINAL)), critical)


def payload(root: str, found: scan.Extracted, made: scan.Analysis) -> dict:
    """The whole report as plain data."""
    d = {k: v.first().asDict() for k, v in made.details.items() if k not in ("dead_assets", "complexity_rows", "cost_rows")}
    roots = found.projects.select("root").distinct()
    inside = found.files.withColumn("root", F.explode(scan.text.folders(F.col("path")))).join(roots, "root", "left_semi").select("path").distinct()
    scores = {r.dimension: r.score for r in made.scores.collect()}
    dead = made.details["dead_assets"]
    analytics = graph.analytics(found.assets.select("name").distinct(), found.edges)
    analytics |= {
        "dead_asset_analysis": {"dead_asset_score": scores["dead_assets"], "dead_count": dead.count(), "total_count": found.assets.count(), "details": report.rows_of(dead, "asset_name", "severity", "message")},
        "test_coverage_analysis": d["test_coverage"], "documentation_coverage_analysis": d["documentation"], "ownership_analysis": d["ownership"], "contract_compliance_analysis": d["contracts"],
        "complexity_analysis": d["complexity"] | {"weights": dict.fromkeys(("depth", "fanout", "fanin", "sql"), impact.WEIGHT), "details": report.rows_of(made.details["complexity_rows"], "*")},
        "cost_hotspot_analysis": d["cost_hotspots"] | {"ranked": report.rows_of(scan.cost.ranked(made.details["cost_rows"]).drop("ord"), "*")},
    }
    counts = report.parsed_counts(found.files, roots, inside).first().asDict()
    out = {
        "version": __version__, "scan_root": root, **counts, "assets": report.rows_of(found.assets.orderBy("ord"), *scan.ASSET_COLUMNS), "edges": report.rows_of(found.edges.orderBy("ord", "source", "target"), "source", "target"),
        "graph": graph.summary(found.assets, found.edges).first().asDict(), "analytics": analytics, "findings": report.rows_of(made.findings.orderBy("analyzer", "asset_name", "message"), *scan.FINDING), "scores": {k: scores[k] for k in DIMENSIONS},
    }
    warnings = [r.warning for r in found.warnings.collect()]
    return out | ({"parse_warnings": warnings} if warnings else {})


def overall(made: scan.Analysis) -> int:
    return impact.overall_health(made.scores).first()["overall"]


def scan_command(spark: SparkSession, args: argparse.Namespace) -> int:
    found, made = run(spark, args.path, args.dialect, args.exclude, args.dead_asset_whitelist, args.dead_asset_terminal_tags, args.test_coverage_critical_deps)
    data, health = payload(os.path.abspath(args.path), found, made), overall(made)
    folder = os.path.join(args.path, ".quarryline")
    report.write_snapshot(os.path.join(folder, "snapshots"), data)
    if args.format == "json":
        print(json.dumps(data, indent=2, ensure_ascii=False, default=str))
        return 0
    os.makedirs(folder, exist_ok=True)
    history = report.append_history(os.path.join(folder, "history.jsonl"), {"scan_date": datetime.now(tz=UTC).isoformat(), "overall": health, "scores": data["scores"]})
    nodes = report.rows_of(report.export_graph(found.assets, found.edges), "id", "type", "file", "importance")
    with open(os.path.join(folder, "report.html"), "w", encoding="utf-8") as f:
        f.write(report.page(data, nodes, history, health))
    print(report.terminal(data, health))
    return 0


def differences(now: DataFrame, before: DataFrame, key: list[str]) -> dict[str, list]:
    return {"added": sorted(tuple(r) for r in impact.added(now, before, key).collect()), "removed": sorted(tuple(r) for r in impact.added(before, now, key).collect())}


def diff_command(spark: SparkSession, args: argparse.Namespace) -> int:
    top = repository.git_top(args.path)
    if top is None:
        print(f"{args.path} isn't in a git work tree", file=sys.stderr)
        return 2
    now = run(spark, args.path, args.dialect, args.exclude)
    with tempfile.TemporaryDirectory(prefix="quarryline-diff-") as folder:
        tree = os.path.join(folder, "tree")
        if subprocess.run(["git", "-C", top, "worktree", "add", "--detach", tree, args.ref], capture_output=True).returncode:
            print(f"git can't check out {args.ref}", file=sys.stderr)
            return 2
        try:
            before = run(spark, os.path.join(tree, os.path.relpath(os.path.realpath(args.path), os.path.realpath(top))), args.dialect, args.exclude)
            found = {"assets": differences(now[0].assets, before[0].assets, ["name"]), "findings": differences(now[1].findings, before[1].findings, KEY)}
        finally:
            subprocess.run(["git", "-C", top, "worktree", "remove", "--force", tree], capture_output=True)
    for kind, sides in found.items():
        for side, rows in sides.items():
            print(f"{kind} {side}: {len(rows)}")
            print("".join(f"  {'  '.join(map(str, r))}\n" for r in rows[: report.DIFFERENCES]), end="")
    return 0


def ci_command(spark: SparkSession, args: argparse.Namespace) -> int:
    found, made = run(spark, args.path, args.dialect, args.exclude)
    data, health = payload(os.path.abspath(args.path), found, made), overall(made)
    report.write_snapshot(os.path.join(args.path, ".quarryline", "snapshots"), data)
    print(report.terminal(data, health))
    if os.environ.get("GITHUB_ACTIONS") == "true":
        for r in impact.annotations(made.findings).collect():
            print(r.line)
    return 1 if health < args.threshold else 0


def share(text: str) -> int:
    if not 0 <= int(text) <= 100:
        raise argparse.ArgumentTypeError("from 0 to 100")
    return int(text)


def count(text: str) -> int:
    if int(text) < 0:
        raise argparse.ArgumentTypeError("0 or more")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarryline")
    top.add_argument("--version", "-V", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    made = {name: commands.add_parser(name) for name in ("scan", "diff", "ci")}
    made["scan"].add_argument("path")
    made["diff"].add_argument("ref")
    for name in ("diff", "ci"):
        made[name].add_argument("--path", default=".")
    for p in made.values():
        p.add_argument("--dialect", "-d")
        p.add_argument("--exclude", "-e")
    made["scan"].add_argument("--format", "-f", choices=["terminal", "json"], default="terminal")
    made["scan"].add_argument("--dead-asset-whitelist")
    made["scan"].add_argument("--dead-asset-terminal-tags")
    made["scan"].add_argument("--test-coverage-critical-deps", type=count, default=10)
    made["ci"].add_argument("--threshold", type=share, default=70)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return {"scan": scan_command, "diff": diff_command, "ci": ci_command}[args.command](session(), args)


if __name__ == "__main__":
    sys.exit(main())
