"""Reports of the parsing and graph phases as text, one per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators import graph


def _line(title: str, *parts) -> Column:
    return F.concat(F.lit(f"{title:<13}: "), *[F.coalesce(p.cast("string"), F.lit("0")) for p in parts])


def parse_totals(results: DataFrame, nodes: DataFrame, edges: dict[str, DataFrame]) -> DataFrame:
    """repo_id, files, failed, nodes and a count for each table of `edges`."""
    r = results.select("repo_id", "file_path", "success").groupBy("repo_id", "file_path").agg(F.bool_and(F.coalesce("success", F.lit(False))).alias("fine"))
    out = r.groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(~F.col("fine")).alias("failed"))
    counts = {"nodes": nodes, **edges}
    out = reduce(lambda acc, kv: acc.join(kv[1].groupBy("repo_id").agg(F.count("*").alias(kv[0])), "repo_id", "full_outer"), counts.items(), out)
    return out.select("repo_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("files", "failed", *counts)])


def parse_report(results: DataFrame, nodes: DataFrame, edges: dict[str, DataFrame], shown: int = 5) -> DataFrame:
    """repo_id, report: totals and the first failed files."""
    t = parse_totals(results, nodes, edges)
    failed = results.where(~F.coalesce("success", F.lit(False))).select("repo_id", "file_path").distinct()
    j = t.join(_first(failed, shown), "repo_id", "left")
    lines = [_line("Repo", F.col("repo_id")), _line("Files parsed", F.col("files")), _line("Total nodes", F.col("nodes")), *[_line(k, F.col(k)) for k in edges], _line("Failed files", F.col("failed"))]
    return j.select("repo_id", F.concat_ws("\n", *lines, F.transform("names", lambda x: F.concat(F.lit("  x "), x))).alias("report"))


def _first(df: DataFrame, k: int) -> DataFrame:
    """repo_id, names: the first k file paths of each repository; no more than k of them are ever gathered (a limit on
    the rank is pushed below the window)."""
    w = Window.partitionBy("repo_id").orderBy("file_path")
    top = df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return top.groupBy("repo_id").agg(F.array_sort(F.collect_list("file_path")).alias("names"))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo_id, report: counts of nodes and edges, orphans, and both by kind."""
    pairs = lambda df, c, name: df.groupBy("repo_id", c).agg(F.count("*").alias("k")).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.col(c), F.col("k").cast("string")))).alias(name))
    j = graph.graph_stats(nodes, edges).join(pairs(nodes, "kind", "kinds"), "repo_id", "left").join(pairs(edges, "type", "types"), "repo_id", "left")
    shown = lambda c: F.concat_ws(", ", c)
    return j.select(
        "repo_id",
        F.concat_ws("\n", _line("Repo", F.col("repo_id")), _line("Nodes", F.col("nodes")), _line("Edges", F.col("edges")), _line("Orphans", F.col("orphans")), _line("Nodes/kind", shown("kinds")), _line("Edges/kind", shown("types"))).alias("report"),
    )
