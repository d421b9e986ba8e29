"""A source tree as a DataFrame: listed on the driver with whole directories pruned, read in the tasks.

Registered as the data source `sourcetree` with options `path`, `repo_id` and, if wanted, `max_bytes`. File formats that
come with Spark skip names that begin with `_` or `.`, such as package initialisers, so they can't list a repository.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweft import constants as C
from codeweft.session import ship
from codeweft.sources.ignore import Ignore

SCHEMA = "repo_id string, path string, size_bytes bigint, last_modified timestamp, content binary"
#: Bytes and files a task reads.
TASK_BYTES, TASK_FILES = 32 << 20, 2_000


def suffix(name: str) -> str:
    """Extension with its dot, in lower case; '' for names that only begin with a dot."""
    head, dot, tail = name.rpartition(".")
    return (dot + tail).lower() if head and tail and head.strip(".") else ""


def walk(root: str, max_bytes: int = C.MAX_FILE_BYTES, sniff: bool = True) -> list[tuple[str, int]]:
    """(relative path, size) of the source files of a tree. Excluded, hidden and ignored directories aren't entered;
    files need a source extension or none, must not be ignored, too large or, with `sniff`, which opens them, binary."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            ignored = Ignore(f)
    except OSError:
        ignored = Ignore(())
    out = []
    for here, dirs, files in os.walk(root):
        rel = os.path.relpath(here, root)
        at = lambda name: name if rel == "." else f"{rel}/{name}".replace(os.sep, "/")  # noqa: B023, E731
        dirs[:] = sorted(d for d in dirs if d not in C.EXCLUDED_DIRS and not d.startswith(".") and not ignored(at(d), True))
        for name in sorted(files):
            if (ext := suffix(name)) and ext not in C.SOURCE_EXTENSIONS or ignored(at(name)):
                continue
            try:
                full = os.path.join(here, name)
                size = os.stat(full).st_size
                if size > max_bytes:
                    continue
                if sniff:
                    with open(full, "rb") as f:
                        if b"\0" in f.read(C.SNIFFED_BYTES):
                            continue
            except OSError:
                continue
            out.append((at(name), size))
    return out


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.repo = options.get("repo_id") or os.path.basename(self.root)
        self.max_bytes = int(options.get("max_bytes") or C.MAX_FILE_BYTES)

    def partitions(self) -> list[Part]:
        parts, size = [[]], 0
        # The driver lists only; binary files are told where they are read.
        for path, n in walk(self.root, self.max_bytes, sniff=False):
            if size + n > TASK_BYTES or len(parts[-1]) >= TASK_FILES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Part(p) for p in parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, path)
            try:
                stat = os.stat(full)
                with open(full, "rb") as f:
                    content = f.read()
            except OSError:
                continue  # gone since it was listed
            if b"\0" in content[: C.SNIFFED_BYTES]:
                continue
            yield self.repo, path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, tz=timezone.utc), content


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, repo_id: str, max_bytes: int = C.MAX_FILE_BYTES) -> DataFrame:
    """Files of a tree that every executor can reach under the same path."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    ship(spark)
    spark.dataSource.register(SourceTree)
    return spark.read.format("sourcetree").option("repo_id", repo_id).option("max_bytes", str(max_bytes)).load(root)
