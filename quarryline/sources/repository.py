"""A repository as a table: a data source that walks a tree on the driver and reads files on executors.

``spark.dataSource.register(Repository)``, then ``spark.read.format("repository").option("exclude", "target").load(root)``
gives path (from the root, with "/") and content. Executors read the files, so the tree must be on a file
system that all of them see. Spark's own file readers leave out names that begin with "_"; this doesn't."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryline.functions.text import excluded_names

FILES_A_TASK = 2000
TREE = "path string, content string"


def walk(root: str, exclude: list[str]) -> Iterator[str]:
    """Paths of files under root, sorted; not of hidden files and folders, nor in folders with an excluded name, nor through links."""
    for folder, folders, names in os.walk(root, followlinks=False):
        folders[:] = sorted(x for x in folders if not x.startswith(".") and x.lower() not in exclude)
        for name in sorted(names):
            if not name.startswith("."):
                yield os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")


class Files(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.exclude = options["path"], excluded_names(options.get("exclude"))

    def partitions(self) -> list[Files]:
        paths = list(walk(self.root, self.exclude)) if os.path.isdir(self.root) else []
        return [Files(self.root, paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)] or [Files(self.root, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            full = Path(partition.root, path)
            asked = path.lower().endswith((".sql", ".py", ".yml", ".yaml"))  # what any reader looks into
            try:
                yield path, full.read_text(encoding="utf-8", errors="ignore") if asked else None
            except OSError:
                yield path, None


class Repository(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def files(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    spark.dataSource.register(Repository)
    return spark.read.format("repository").option("exclude", exclude or "").load(os.path.abspath(root))


def _git(root: str, *args: str, timeout: int = 60) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode == 0 else None


def git_top(root: str) -> str | None:
    found = _git(root, "rev-parse", "--show-toplevel", timeout=8)
    return found.strip() or None if found else None


def commits(spark: SparkSession, root: str) -> DataFrame:
    """path (from the scanned root), author and time of each file's last commit, from one run over the history."""
    rows, seen, now = [], set(), ("", 0)
    for line in (_git(root, "-c", "core.quotePath=false", "log", "--relative", "--name-only", "--format=%x01%ct|%an", "--", ".") or "").splitlines():
        if line.startswith("\x01"):
            stamp, _, author = line[1:].partition("|")
            now = (author, int(stamp))
        elif line and line not in seen:
            seen.add(line)
            rows.append((line, *now))
    found = spark.createDataFrame(rows, "path string, author string, stamp long")
    return found.select("path", "author", F.timestamp_seconds("stamp").alias("at"))


def owner_rules_text(root: str) -> tuple[str, str]:
    """The text of the first CODEOWNERS file (the repository's before the scanned root's, in .github before beside it), and
    what paths from the scanned root begin with, seen from that file's root."""
    top = git_top(root)
    for base in dict.fromkeys(os.path.realpath(x) for x in (top, root) if x):
        for found in (Path(base, ".github", "CODEOWNERS"), Path(base, "CODEOWNERS")):
            if found.is_file():
                inside = os.path.relpath(os.path.realpath(root), base).replace(os.sep, "/")
                return found.read_text(encoding="utf-8", errors="ignore"), "" if inside == "." else inside + "/"
    return "", ""
