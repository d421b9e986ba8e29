"""Versioned Parquet tables in a folder, one version line per table and repository.

A write makes a new version directory of one repository's part of a table and then switches to it by adding a small
file, so a reader never sees half a table, a failed write leaves the last version in place, and no other repository is
touched or read. A version is a list of what to add and what to take away, so appending and deleting write only what
they are about. Old versions stay until `prune`.
"""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import schemas
from codeweft.session import delete, list_names, read_text, stage, write_text

TABLES = {
    "files": schemas.FILE,
    "repo_meta": schemas.REPO_META,
    "nodes": f"repo_id string, ord bigint, {schemas.NODE}",
    "call_edges": f"repo_id string, ord bigint, {schemas.CALL_EDGE}",
    "import_edges": f"repo_id string, ord bigint, {schemas.IMPORT_EDGE}",
    "inheritance_edges": f"repo_id string, ord bigint, {schemas.INHERITANCE_EDGE}",
    "reference_edges": f"repo_id string, ord bigint, {schemas.REFERENCE_EDGE}",
    "parse_results": f"repo_id string, {schemas.PARSE_RESULT}",
    "graph_nodes": f"repo_id string, {schemas.GRAPH_NODE}",
    "graph_edges": f"repo_id string, {schemas.GRAPH_EDGE}",
}
#: Steps after which a version is written out whole.
MOST_STEPS = 16
#: The column by which rows of a table belong to a file.
FILE_KEY = {"nodes": "file_path", "call_edges": "file_path", "import_edges": "source_file", "parse_results": "file_path"}


class Store:
    """The tables in `folder`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- versions

    def _part(self, name: str, repo_id: str) -> str:
        return f"{self.folder}/{name}/{quote(repo_id, safe='')}"

    def version(self, name: str, repo_id: str) -> int:
        """The current version of a repository's part of a table, 0 if there is none."""
        marks = [x for x in list_names(self.spark, f"{self._part(name, repo_id)}/_versions") if x.isdigit()]
        return int(max(marks, default="0"))

    def repos(self, name: str) -> list[str]:
        """Repositories with a version of the table."""
        return [r for x in list_names(self.spark, f"{self.folder}/{name}") if self.version(name, r := unquote(x))]

    def _steps(self, name: str, repo_id: str, version: int | None = None) -> list[list[str]]:
        """What makes up a version: [`rows`, folder] adds rows, [`gone`, folder, column] takes away those before it whose
        column has one of the folder's values."""
        v = self.version(name, repo_id) if version is None else version
        said = read_text(self.spark, f"{self._part(name, repo_id)}/_versions/{v:09d}") if v else "[]"
        return json.loads(said) if said else [["rows", f"v{v:09d}"]]

    def read(self, name: str, repo_id: str | None = None) -> DataFrame:
        """A table, of one repository or all; empty if it was never written. Columns that older versions lack are null."""
        reader, plain, parts = self.spark.read.schema(TABLES[name]), [], []
        for r in self.repos(name) if repo_id is None else [repo_id]:
            steps, rows, folders = self._steps(name, r), None, []
            for kind, folder, *column in [*steps, ["end", ""]]:
                path = f"{self._part(name, r)}/{folder}"
                if kind == "rows":
                    folders.append(path)
                elif folders and (kind == "gone" or rows is not None):
                    more = reader.parquet(*folders)
                    rows, folders = more if rows is None else rows.unionByName(more), []
                if kind == "gone" and rows is not None:
                    rows = rows.join(self.spark.read.parquet(path), column[0], "left_anti").select(rows.columns)
            plain += folders
            parts += [] if rows is None else [rows]
        parts += [reader.parquet(*plain)] if plain else []
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], TABLES[name])

    def _fit(self, name: str, repo_id: str, df: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], TABLES[name]).schema
        return df.where(F.col("repo_id") == repo_id).select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])

    def _switch(self, name: str, repo_id: str, v: int, steps: list[list[str]]) -> None:
        write_text(self.spark, f"{self._part(name, repo_id)}/_versions/{v:09d}", json.dumps(steps))

    def write(self, name: str, repo_id: str, df: DataFrame) -> None:
        """Make the rows of `repo_id` in `df` its part of the table; `df` may be derived from the table itself."""
        v = self.version(name, repo_id) + 1
        self._fit(name, repo_id, df).write.mode("overwrite").parquet(f"{self._part(name, repo_id)}/v{v:09d}")
        self._switch(name, repo_id, v, [["rows", f"v{v:09d}"]])

    def change(self, name: str, repo_id: str, new: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Take away the rows whose value of the one column of `gone` is in it, then add `new`. Only these are written, until
        a version has MOST_STEPS steps; then it is written out whole."""
        v, steps = self.version(name, repo_id) + 1, self._steps(name, repo_id)
        if gone is not None and steps:
            gone.distinct().write.mode("overwrite").parquet(f"{self._part(name, repo_id)}/d{v:09d}")
            steps.append(["gone", f"d{v:09d}", gone.columns[0]])
        if new is not None:
            self._fit(name, repo_id, new).write.mode("overwrite").parquet(f"{self._part(name, repo_id)}/v{v:09d}")
            steps.append(["rows", f"v{v:09d}"])
        self._switch(name, repo_id, v, steps)
        if len(steps) > MOST_STEPS:
            self.write(name, repo_id, self.read(name, repo_id))

    def prune(self, name: str, repo_id: str, keep: int = 2) -> None:
        """Remove what none of the last `keep` versions is made of."""
        v = self.version(name, repo_id)
        kept = {step[1] for k in range(max(1, v - keep + 1), v + 1) for step in self._steps(name, repo_id, k)}
        for x in list_names(self.spark, self._part(name, repo_id)):
            if x[0] in "vd" and x[1:].isdigit() and int(x[1:]) <= v and x not in kept:
                delete(self.spark, f"{self._part(name, repo_id)}/{x}")

    # --- elements and edges

    def upsert_nodes(self, repo_id: str, new: DataFrame) -> None:
        """Rows replace those of their id; within `new` the last written row of an id holds."""
        rest = [c for c in new.columns if c not in ("repo_id", "id")]
        last = new.where(F.col("repo_id") == repo_id).groupBy("repo_id", "id").agg(F.max_by(F.struct(*rest), F.struct("file_path", "ord")).alias("v")).select("repo_id", "id", "v.*")
        last = stage(last, "last-nodes")
        self.change("nodes", repo_id, last, last.select("id"))

    def append(self, name: str, repo_id: str, new: DataFrame) -> None:
        self.change(name, repo_id, new)

    def delete_files(self, repo_id: str, gone: DataFrame) -> None:
        """Remove everything of the files in `gone` (file_path): elements, edges from them, and the inheritance and
        reference edges of their elements."""
        gone = gone.select("file_path").distinct()
        ids = self.read("nodes", repo_id).join(gone, "file_path", "left_semi").select("id")
        for name, key in (("inheritance_edges", "child_id"), ("reference_edges", "source_id")):
            if self.version(name, repo_id):
                self.change(name, repo_id, gone=ids.withColumnRenamed("id", key))
        for name, key in reversed(FILE_KEY.items()):
            if self.version(name, repo_id):
                self.change(name, repo_id, gone=gone.withColumnRenamed("file_path", key))

    def drop(self, repo_id: str, *names: str) -> None:
        """Empty a repository's part of the tables."""
        for name in names:
            if self.version(name, repo_id):
                self._switch(name, repo_id, self.version(name, repo_id) + 1, [])

    def nodes_of_file(self, repo_id: str, path: str) -> DataFrame:
        return self.read("nodes", repo_id).where(F.col("file_path") == path)

    def nodes_of_kind(self, repo_id: str, kind: str) -> DataFrame:
        return self.read("nodes", repo_id).where(F.col("kind") == kind)

    def children(self, repo_id: str, parent_id: str) -> DataFrame:
        return self.read("nodes", repo_id).where(F.col("parent_id") == parent_id)

    def find_by_name(self, repo_id: str, name: str) -> DataFrame:
        """Nodes by name, upper and lower case alike."""
        return self.read("nodes", repo_id).where(F.lower("name") == name.lower())

    # --- files

    def snapshot(self, repo_id: str) -> DataFrame:
        """path, sha256 of the stored files."""
        return self.read("files", repo_id).select("path", "sha256")

    def records(self, repo_id: str) -> DataFrame:
        return self.read("files", repo_id).withColumn("status", F.lit("unchanged"))

    # --- graph

    def save_graph(self, repo_id: str, nodes: DataFrame, edges: DataFrame) -> None:
        self.write("graph_nodes", repo_id, nodes)
        self.write("graph_edges", repo_id, edges)

    def load_graph(self, repo_id: str) -> tuple[DataFrame, DataFrame] | None:
        if not self.version("graph_nodes", repo_id):
            return None
        return self.read("graph_nodes", repo_id), self.read("graph_edges", repo_id)


LISTS = ("children", "typed_parameters", "parameters", "calls", "imports", "bases", "decorators", "ref_names")


def to_json_columns(nodes: DataFrame) -> DataFrame:
    """Nodes with their lists as JSON text, for stores without arrays; null lists become `[]`."""
    return nodes.withColumns({c: F.coalesce(F.to_json(c), F.lit("[]")) for c in LISTS})


def from_json_columns(nodes: DataFrame) -> DataFrame:
    """The way back; a text that isn't a list of the right kind becomes an empty list."""
    kinds = {c: "array<struct<name:string,type:string>>" if c == "typed_parameters" else "array<string>" for c in LISTS}
    return nodes.withColumns({c: F.coalesce(F.from_json(c, k), F.from_json(F.lit("[]"), k)) for c, k in kinds.items()})
