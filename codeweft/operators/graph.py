"""The dependency graph as two tables, its merge rule, reachability and statistics.

Nodes: repo_id, id, name, kind, ... ; edges: repo_id, src, dst, type. Empty tables give empty graphs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import constants as C
from codeweft.functions import lexical as L
from codeweft.operators import resolve
from codeweft.session import stage, stage_counted

#: Edges that a round of `reachable` walks along: a round costs a job whatever it finds.
HOPS = 3

NODE_FIELDS = ["id", "name", "kind", "file_path", "start_line", "end_line", "language", "is_exported", "parent_id", "parent_class"]


def current_nodes(nodes: DataFrame, *more: str) -> DataFrame:
    """Each id once, as its last write left it; deleted ones are gone."""
    fields = [c for c in dict.fromkeys(["repo_id", *NODE_FIELDS, "ord", *more]) if c != "id"]
    v = F.max_by(F.struct(*fields, F.col("deleted_at").isNotNull().alias("gone")), F.struct("ord", F.col("deleted_at").isNotNull())).alias("v")
    return nodes.where(F.col("id").isNotNull()).groupBy("id").agg(v).select("id", "v.*").where("not gone").drop("gone")


def all_edges(nodes: DataFrame, calls: DataFrame, inheritance: DataFrame) -> DataFrame:
    """repo_id, src, dst, type: every edge of every type. `nodes` must have `calls` and `imports`."""
    parts = {
        "calls": resolve.call_edges(calls, nodes),
        "imports": resolve.import_edges(resolve.import_rows(nodes), nodes),
        "inherits": resolve.inheritance_edges(inheritance, nodes),
        "defines": resolve.defines_edges(nodes),
    }
    return reduce(DataFrame.unionByName, [df.withColumn("type", F.lit(t)) for t, df in parts.items()])


def hop_edges(nodes: DataFrame, calls: DataFrame, inheritance: DataFrame | None = None) -> DataFrame:
    """repo_id, src, dst: edges over which the same nodes are reached as over `all_edges`, or with the calls only, as over
    the call edges; names and files are vertices of their own, so that nothing is multiplied out."""
    if inheritance is None:
        return resolve.call_hops(calls, nodes)
    return resolve.call_hops(calls, nodes).union(resolve.import_hops(resolve.import_rows(nodes), nodes)).union(resolve.inheritance_edges(inheritance, nodes)).union(resolve.defines_edges(nodes))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): of several types the strongest holds."""
    rank = F.array_position(F.array(*[F.lit(t) for t in C.EDGE_TYPES]), F.col("type"))
    return edges.groupBy("repo_id", "src", "dst").agg(F.max_by("type", rank).alias("type"))


def entry_points(nodes: DataFrame) -> DataFrame:
    return nodes.where(L.is_entry(F.col("kind"), F.col("name"), F.col("is_exported")))


def reachable(starts: DataFrame, edges: DataFrame, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """repo_id, id of every node that can be reached from `starts` along edges of the types (all by default), which may
    lead over vertices of `hop_edges`.

    A frontier loop: each round joins the last round's nodes with the edges, HOPS times, and drops what was seen. Rounds are
    staged, so neither plan nor lineage grows with them."""
    e = edges.where(F.col("type").isin(*edge_types)) if edge_types else edges
    e = stage(e.select("repo_id", "src", "dst").distinct(), "edges")
    seen = frontier = stage(starts.select("repo_id", "id").distinct(), "reach-0")
    k = 1
    while True:
        steps = [frontier]
        for _ in range(HOPS):
            steps.append(e.join(steps[-1].withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").select("repo_id", F.col("dst").alias("id")).distinct())
        step = reduce(DataFrame.union, steps[1:]).distinct()
        frontier, found = stage_counted(step.join(seen, ["repo_id", "id"], "left_anti"), f"reach-{k}")
        if not found:
            return seen.where(~F.startswith("id", F.lit("\0")))
        seen = seen.unionByName(frontier)
        k += 1


def dead_functions(nodes: DataFrame, edges: DataFrame, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """Functions and methods that no entry point reaches."""
    live = reachable(entry_points(nodes), edges, edge_types)
    return nodes.where(F.col("kind").isin("function", "method")).join(live, ["repo_id", "id"], "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select("repo_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, ["repo_id", "id"], "left_anti")


def most_called(edges: DataFrame, nodes: DataFrame, k: int | None = None) -> DataFrame:
    """repo_id, id, name, callers: nodes by their number of callers; the top k if given. `edges` should be unmerged: where
    an import stands for a call between the same nodes the merge leaves the import only."""
    n = edges.where("type = 'calls'").groupBy("repo_id", F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    out = n.join(nodes.select("repo_id", "id", "name"), ["repo_id", "id"])
    return out.orderBy(F.desc("callers"), "id").limit(k) if k is not None else out


def most_complex(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, id, name, out_degree. The measure of complexity is this engine's choice: the number of edges going out."""
    n = edges.groupBy("repo_id", F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return n.join(nodes.select("repo_id", "id", "name"), ["repo_id", "id"])


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, nodes, edges, orphans per repository."""
    n = nodes.groupBy("repo_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("repo_id").agg(F.count("*").alias("edges"))
    o = orphans(nodes, edges).groupBy("repo_id").agg(F.count("*").alias("orphans"))
    zero = F.lit(0).cast("long")
    return n.join(e, "repo_id", "left").join(o, "repo_id", "left").select("repo_id", "nodes", F.coalesce("edges", zero).alias("edges"), F.coalesce("orphans", zero).alias("orphans"))
