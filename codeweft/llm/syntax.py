"""Source files that do not parse.

Each text is parsed in the language its path's extension names (see `parsing`); what an earlier parser said is carried
along, never believed. Files of other extensions and null texts are left out: nothing can be said of them. An empty
text is valid. Of several texts of one path any invalid one makes the file invalid. Repeated rows count once; extra
columns are dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import plain_path, ship

CHECKED = "repo_id string, path string, language string, accepted boolean, errors array<string>"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from codeweft.llm.parsing import check

    sys.setrecursionlimit(20_000)
    for b in batches:
        langs, errors = [], []
        for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lang, found = check(path, text)
            langs.append(lang)
            errors.append(found)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array([e is None or not e for e in errors]), pa.array(errors, pa.list_(pa.string()))],
            names=["repo_id", "path", "language", "accepted", "errors"],
        )


def check_sources(sources: DataFrame) -> DataFrame:
    """repo_id, path, language (by extension), accepted, errors (all, first cause first) of each source text.

    The texts are parsed where they are read: only verdicts are ever shuffled."""
    ship(sources.sparkSession)
    return (
        sources.select("repo_id", plain_path(F.col("path")).alias("path"), "content")
        .where(F.col("content").isNotNull() & F.col("path").isNotNull())
        .mapInArrow(_check, CHECKED)
        .where(F.col("language").isNotNull())
    )


def parse_verdicts(sources: DataFrame, results: DataFrame) -> DataFrame:
    """repo_id, file_path, language, accepted, errors, first_cause, claimed_success (by the latest result, null if it
    didn't say) of the files of `results`."""
    verdicts = check_sources(sources).groupBy("repo_id", F.col("path").alias("file_path")).agg(
        F.min(F.struct("accepted", "language", "errors")).alias("v")
    )
    claims = (
        results.select("repo_id", plain_path(F.col("file_path")).alias("file_path"), "parsed_at", "success")
        .groupBy("repo_id", "file_path")
        .agg(F.max(F.struct("parsed_at", "success")).alias("c"))
    )
    return verdicts.join(claims, ["repo_id", "file_path"]).select(
        "repo_id", "file_path", "v.language", "v.accepted", "v.errors", F.get("v.errors", F.lit(0)).alias("first_cause"), F.col("c.success").alias("claimed_success")
    )


def parse_rates(verdicts: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    return verdicts.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("accepted")).alias("invalid"), (F.count_if(~F.col("accepted")) / F.count("*")).alias("rate")
    )
