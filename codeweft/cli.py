"""Command line: ingest, parse, graph, visualize. A bare source means `ingest SOURCE`."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

COMMANDS = ("ingest", "parse", "graph", "visualize")


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("codeweft").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft", description="Code intelligence over source repositories.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("ingest", "List a repository and find what changed."), ("parse", "Ingest, then extract program elements."), ("graph", "Parse, then build the dependency graph and report unreachable functions."), ("visualize", "Build and draw the dependency graph, of a stored repository too.")):
        c = sub.add_parser(name, help=text, description=text)
        c.add_argument("source", help="address of a repository or a directory")
        c.add_argument("-b", "--branch")
        c.add_argument("-f", "--force", action="store_true", help="drop the stored manifest: every file is new")
        c.add_argument("-v", "--verbose", action="store_true")
        c.add_argument("--store", default=os.environ.get("CODEWEFT_STORE", os.path.join(os.path.expanduser("~"), ".codeweft", "store")), help="folder of the tables")
        if name == "graph":
            c.add_argument("-z", "--visualize", action="store_true", help="Generate an HTML visualization")
        if name in ("graph", "visualize"):
            c.add_argument("-o", "--output", default="graph.html", help="file of the visualization")
        if name == "visualize":
            c.add_argument("--skip-ingest", action="store_true", help="the source is the id of a stored repository; nothing is read anew")
    return p


def _show(title: str, rows, cols: tuple[str, ...]) -> None:
    print(title)
    for r in rows:
        print("  " + "  ".join(str(r[c]) for c in cols))


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and not argv[0].startswith("-") and argv[0] not in COMMANDS:
        argv.insert(0, "ingest")
    args = _parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    from codeweft.session import drop_staged
    from codeweft.sources.store import Store

    spark = _session()
    try:
        return _run(args, spark, Store(spark, args.store))
    finally:
        drop_staged(spark)


def _draw(args: argparse.Namespace, store, repo_id: str) -> int:
    """Build, report and draw the graph of a stored repository."""
    from codeweft import pipeline, render
    from codeweft.operators import graph

    nodes, edges = pipeline.build_graph(store, repo_id)
    _show("Graph", graph.graph_stats(nodes, edges).collect(), ("nodes", "edges", "orphans"))
    dead = graph.dead_functions(nodes, edges)
    print(f"Unreachable functions: {dead.count()}")
    _show("First 20", dead.orderBy("file_path", "start_line").limit(20).collect(), ("file_path", "start_line", "name"))
    if args.command == "visualize" or args.visualize:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(render.html(nodes, edges, repo_id))
        print(f"wrote {args.output}")
    return 0


def _run(args: argparse.Namespace, spark: SparkSession, store) -> int:
    from codeweft import pipeline
    from codeweft.operators import manifest

    if args.command == "visualize" and args.skip_ingest:
        if not store.version("nodes", args.source):
            print(f"error: no repository {args.source} is stored", file=sys.stderr)
            return 1
        return _draw(args, store, args.source)
    try:
        found = pipeline.ingest(spark, store, args.source, args.branch, args.force)
    except (OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    r = found.repo
    meta = spark.createDataFrame([(r.repo_id, r.source, r.source_type, r.git_commit)], "repo_id string, source string, source_type string, git_commit string")
    print(manifest.summary_text(found.files, meta).first()["report"] if not found.files.isEmpty() else "no source files")
    _show("Languages", manifest.language_breakdown(found.files).collect(), ("language", "files"))
    changes = found.files.where(F.col("status").isin("new", "modified"))
    _show("Changes (first 20)", changes.orderBy("path").limit(20).collect(), ("status", "path"))
    if args.command == "ingest":
        found.commit(store)
        return 0
    if args.command == "parse" and changes.isEmpty():
        print("nothing to parse")
        found.commit(store)
        return 0
    results = pipeline.parse(store, found)
    found.commit(store)
    mine = store.read("nodes", found.repo.repo_id)
    _show("Kinds", mine.groupBy("kind").count().orderBy(F.desc("count"), "kind").collect(), ("kind", "count"))
    _show("Failed files (first 10)", results.where("not success").orderBy("file_path").limit(10).collect(), ("file_path", "errors"))
    if args.command == "parse":
        return 0
    return _draw(args, store, found.repo.repo_id)


if __name__ == "__main__":
    sys.exit(main())
