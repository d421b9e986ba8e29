"""The three phases over one repository: ingest, parse, graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.extract import table as xt
from codeweft.functions import lexical as L
from codeweft.operators import graph, manifest, resolve
from codeweft.session import stage
from codeweft.sources import git
from codeweft.sources.store import Store
from codeweft.sources.tree import read_tree


@dataclass
class Ingested:
    repo: git.RepoInfo
    files: DataFrame  # manifest rows with their status
    texts: DataFrame  # repo_id, path, language, content of the new and modified files
    before: DataFrame  # the snapshot they were compared with
    force: bool = False  # was the stored manifest dropped

    def commit(self, store: Store) -> None:
        """Make the listing the stored snapshot. Done last: when a phase before fails, the next run sees the same changes."""
        r = self.repo
        mine = manifest.upsert_snapshot(self.before, self.files).join(self.files.select("repo_id", "path", "last_modified"), ["repo_id", "path"], "left").withColumn("indexed_at", F.current_timestamp())
        store.write("files", r.repo_id, mine)
        meta = store.spark.createDataFrame([(r.repo_id, r.source, r.source_type, r.git_branch, r.git_commit)], "repo_id string, source string, source_type string, git_branch string, git_commit string")
        known = store.read("repo_meta", r.repo_id)
        store.write("repo_meta", r.repo_id, manifest.upsert_meta(known.limit(0) if self.force else known, meta.withColumn("last_indexed_at", F.current_timestamp())))


def listing(tree: DataFrame) -> DataFrame:
    """Files with language, hash, size, lines and text. Bytes that aren't UTF-8 are replaced; files of no known language
    are dropped."""
    text = F.col("content").cast("string")
    rows = tree.withColumn("text", text)
    return rows.select(
        "repo_id", "path", L.detect_language(F.col("path"), F.col("text")).alias("language"), F.sha2("content", 256).alias("sha256"), "size_bytes", "last_modified", L.count_lines(F.col("text")).alias("line_count"), "text"
    ).where(F.col("language").isNotNull())


def ingest(spark: SparkSession, store: Store, source: str, branch: str | None = None, force: bool = False) -> Ingested:
    """List a repository and compare it with its stored snapshot; with `force` that is dropped: all files are new, and what
    is stored of the repository makes way for what is found."""
    repo = git.resolve(source, branch)
    current = stage(listing(read_tree(spark, repo.path, repo.repo_id)), "listing")
    stored = store.read("files", repo.repo_id)
    before = stored.limit(0) if force else stored
    status = manifest.file_status(current.drop("text"), before)
    files = stage(status.join(current.select("repo_id", "path", "last_modified"), ["repo_id", "path"], "left"), "manifest")
    changed = files.where(F.col("status").isin("new", "modified")).select("repo_id", "path")
    texts = current.join(changed, ["repo_id", "path"], "left_semi").select("repo_id", "path", "language", F.col("text").alias("content"))
    return Ingested(repo, files, texts, before, force)


def parse(store: Store, found: Ingested) -> DataFrame:
    """Extract the changed files and bring the stored elements and edges up to date; the parse results."""
    repo_id = found.repo.repo_id
    rows = stage(xt.extract(found.texts), "extracted")
    if found.force:
        store.drop(repo_id, "nodes", "call_edges", "import_edges", "inheritance_edges", "reference_edges", "parse_results")
    elif store.version("nodes", repo_id):
        store.delete_files(repo_id, found.files.where("status != 'unchanged'").select(F.col("path").alias("file_path")))
    store.upsert_nodes(repo_id, xt.nodes(rows))
    for tag, name in (("call", "call_edges"), ("import", "import_edges"), ("inherit", "inheritance_edges")):
        store.append(name, repo_id, xt.edges(rows, tag))
    store.append("parse_results", repo_id, xt.results(rows))
    return xt.results(rows)


def build_graph(store: Store, repo_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and merged edges of a repository, stored as well."""
    nodes = stage(store.read("nodes", repo_id), "graph-nodes")
    imports = store.read("import_edges", repo_id).select("repo_id", "source_file", "target_module").where(F.col("target_module").isNotNull()).distinct()
    parts = {
        "calls": resolve.call_edges(store.read("call_edges", repo_id), nodes),
        "imports": resolve.import_edges(imports, nodes),
        "inherits": resolve.inheritance_edges(store.read("inheritance_edges", repo_id), nodes),
        "defines": resolve.defines_edges(nodes),
    }
    every = None
    for t, df in parts.items():
        df = df.withColumn("type", F.lit(t))
        every = df if every is None else every.unionByName(df)
    edges = stage(graph.merge_edges(every), "graph-edges")
    store.save_graph(repo_id, nodes, edges)
    return nodes, edges
