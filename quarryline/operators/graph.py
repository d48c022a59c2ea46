"""The lineage graph as relations: edges(source, target), assets(name, ...).

Each operator is a plan of joins and aggregations; iterative ones write each
round to the session's checkpoint folder and stop when nothing new turns up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarryline-"))
    return df.checkpoint()


def checkpointed(df: DataFrame) -> DataFrame:
    return _cut(df)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()


def reference_only(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that only edges name."""
    return endpoints(edges).join(assets.select("name"), "name", "left_anti")


def nodes(assets: DataFrame, edges: DataFrame) -> DataFrame:
    return assets.select("name").union(endpoints(edges)).distinct()


def degrees(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """name, in_degree, out_degree over distinct edges, by one aggregation; orphans have zeros."""
    ends = distinct_edges(edges).select(F.explode(F.array(F.struct(F.col("source").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    alone = assets.select("name", F.lit(0).alias("o"), F.lit(0).alias("i"))
    return ends.unionByName(alone).groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def dead_ends(degrees_: DataFrame) -> DataFrame:
    return degrees_.where("out_degree = 0 and in_degree > 0").select("name")


def orphans(degrees_: DataFrame) -> DataFrame:
    return degrees_.where("out_degree = 0 and in_degree = 0").select("name")


def out_degrees(edges: DataFrame) -> DataFrame:
    return distinct_edges(edges).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("out_degree"))


def high_fanout(degrees_: DataFrame, threshold: int = 15) -> DataFrame:
    return degrees_.where(F.col("out_degree") > threshold).select("name", "out_degree")


def exclusive_feeders(edges: DataFrame) -> DataFrame:
    """name, feeders: upstream nodes that feed nothing else."""
    e = distinct_edges(edges)
    single = e.groupBy("source").agg(F.count("*").alias("n"), F.first("target").alias("name")).where("n = 1")
    return single.groupBy("name").agg(F.count("*").alias("feeders"))


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Distinct (start, reached), by semi-naive rounds. seeds (name) restrict the starts. A round writes
    its new pairs only, so all rounds together write each pair once."""
    e = _cut(distinct_edges(edges))
    first = e if seeds is None else e.join(seeds.select(F.col("name").alias("source")), "source", "left_semi")
    seen = frontier = _cut(first.select(F.col("source").alias("start"), F.col("target").alias("reached")))
    while frontier.head(1):
        step = frontier.join(e, frontier["reached"] == e["source"]).select("start", F.col("target").alias("reached")).distinct()
        frontier = _cut(step.join(seen, ["start", "reached"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def descendant_counts(edges: DataFrame) -> DataFrame:
    return closure(edges).where("start <> reached").groupBy(F.col("start").alias("name")).agg(F.count("*").alias("descendants"))


def depths(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """name, depth: the largest over roots of the shortest path's length; 0 where no root leads."""
    e = _cut(distinct_edges(edges))
    roots = degrees(assets, e).where("in_degree = 0").select("name")
    seen = frontier = _cut(roots.select(F.col("name").alias("root"), "name", F.lit(0).alias("d")))
    n = 0
    while frontier.head(1):
        n += 1
        step = frontier.join(e, frontier["name"] == e["source"]).select("root", F.col("target").alias("name")).distinct()
        frontier = _cut(step.join(seen, ["root", "name"], "left_anti").withColumn("d", F.lit(n)))
        seen = seen.unionByName(frontier)
    best = seen.groupBy("name").agg(F.max("d").alias("depth"))
    return nodes(assets, e).join(best, "name", "left").select("name", F.coalesce("depth", F.lit(0)).alias("depth"))


def levels(edges: DataFrame) -> tuple[DataFrame, bool]:
    """name, level (longest path to it, in edges) by peeling; and whether the graph is acyclic."""
    e = _cut(distinct_edges(edges))
    left = _cut(endpoints(e))
    out, n = None, 0
    while True:
        inside = e.join(left.select(F.col("name").alias("target")), "target", "left_semi").join(left.select(F.col("name").alias("source")), "source", "left_semi")
        fed = inside.select(F.col("target").alias("name")).distinct()
        peeled = _cut(left.join(fed, "name", "left_anti").withColumn("level", F.lit(n)))
        out = peeled if out is None else out.unionByName(peeled)
        if not peeled.head(1):
            return out, not left.head(1)
        left, n = _cut(left.join(peeled, "name", "left_anti")), n + 1


def first_per_key(rows: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key, in all its columns."""
    return _one_per_key(rows, key, order, F.min_by)


def last_per_key(rows: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    return _one_per_key(rows, key, order, F.max_by)


def _one_per_key(rows: DataFrame, key: list[str], order: str, pick) -> DataFrame:
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(pick(whole, F.col(order)).alias("__row")).select("__row.*")


def build(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph's nodes: assets with their attributes (the last of a name wins), and what only edges name, as kind reference_only."""
    known = last_per_key(assets, ["name"]).withColumn("kind", F.lit("asset"))
    return known.unionByName(reference_only(assets, edges).withColumn("kind", F.lit("reference_only")), allowMissingColumns=True)


def summary(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, is_directed_acyclic."""
    n = nodes(assets, edges).agg(F.count("*").alias("node_count"))
    m = distinct_edges(edges).agg(F.count("*").alias("edge_count"))
    return n.join(F.broadcast(m), F.lit(True)).withColumn("is_directed_acyclic", F.lit(bool(levels(edges)[1])))  # one row each


def core(edges: DataFrame) -> DataFrame:
    """Edges that are left when sources and sinks are taken away until there are none: all that are on cycles, or between them."""
    left = _cut(distinct_edges(edges))
    n = left.count()
    while n:
        fed, feeding = left.select(F.col("target").alias("source")).distinct(), left.select(F.col("source").alias("target")).distinct()
        less = _cut(left.join(fed, "source", "left_semi").join(feeding, "target", "left_semi").select("source", "target"))
        m = less.count()
        if m == n:
            break
        left, n = less, m
    return left


def cycles(edges: DataFrame) -> DataFrame:
    """cycle: the nodes of each elementary cycle, from its smallest on. There may be exponentially many."""
    e = core(edges)
    paths = _cut(e.where("source <= target").select(F.col("source").alias("start"), F.col("target").alias("last"), F.array("source").alias("path")))
    found = None
    while paths.head(1):
        closed = paths.where("start = last").select(F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        open_ = paths.where("start <> last and not array_contains(path, last)").select("start", "last", F.concat("path", F.array("last")).alias("path"))
        paths = _cut(open_.join(e, open_["last"] == e["source"]).where("target >= start").select("start", F.col("target").alias("last"), "path"))
    return found if found is not None else paths.select(F.col("path").alias("cycle"))


def critical_path(edges: DataFrame) -> list[str]:
    """A longest path, [] for a cyclic graph or one without edges; of several the one with the smallest names, seen from its end."""
    ranks, acyclic = levels(edges)
    if not acyclic:
        return []
    ranks = _cut(ranks)
    last = ranks.orderBy(F.desc("level"), "name").head()
    if last is None:
        return []
    before = distinct_edges(edges).join(ranks.select(F.col("name").alias("source"), F.col("level").alias("up")), "source").join(ranks.select(F.col("name").alias("target"), "level"), "target").where("up = level - 1")
    step = _cut(before.groupBy("target").agg(F.min("source").alias("source")))
    out = [last["name"]]
    for _ in range(last["level"]):
        out.append(step.where(F.col("target") == out[-1]).head()["source"])
    return out[::-1]


def analytics(assets: DataFrame, edges: DataFrame, threshold: int = 15) -> dict:
    """What a report says of the graph: sorted lists of dead ends, orphans, fan-outs and cycles, and a longest path."""
    d = _cut(degrees(assets, edges))
    listed = lambda df: sorted(r[0] for r in df.collect())
    dead, alone, loops, path = listed(dead_ends(d)), listed(orphans(d)), sorted(r[0] for r in cycles(edges).collect()), critical_path(edges)
    wide = sorted(high_fanout(d, threshold).collect(), key=lambda r: (-r[1], r[0]))
    return {
        "dead_asset_count": len(dead), "dead_assets": dead, "orphan_asset_count": len(alone), "orphan_assets": alone, "high_fanout": [{"asset": r[0], "out_degree": r[1]} for r in wide],
        "high_fanout_threshold": threshold, "cycle_count": len(loops), "cycles": loops, "critical_path_length": len(path), "critical_path": path,
    }
