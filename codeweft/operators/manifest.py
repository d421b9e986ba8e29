"""The manifest of a repository: what changed, snapshot rows, and reports over them.

Keys are (repo_id, path). Repeated rows of a key must be reduced before (`latest`); a null hash never equals another.
Empty tables give empty results, reports give zero counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import lexical as L

KEY = ["repo_id", "path"]
#: What the operators read of a file's row; whatever else it has can't clash with their own columns.
FIELDS = [*KEY, "language", "sha256", "size_bytes", "line_count"]


def latest(files: DataFrame, order: str = "indexed_at") -> DataFrame:
    """Of each path the row with the largest `order`; ties by hash."""
    rest = [c for c in files.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct(order, F.coalesce("sha256", F.lit("")))).alias("v")
    return files.groupBy(*KEY).agg(newest).select(*KEY, *[F.col("v")[c].alias(c) for c in rest])


def file_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Current rows with their status against the stored ones, and a row for each stored path that is gone: language
    `unknown`, empty hash, size and lines 0."""
    old = stored.select(*KEY, F.col("sha256").alias("old_sha"))
    gone = F.col("sha256").isNull()
    return current.select(FIELDS).join(old, KEY, "full_outer").select(
        *KEY,
        F.when(gone, "unknown").otherwise(F.col("language")).alias("language"),
        F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.when(gone, 0).otherwise(F.col("size_bytes")).alias("size_bytes"),
        L.status(F.col("old_sha"), F.col("sha256")).alias("status"),
        F.when(gone, 0).otherwise(F.col("line_count")).alias("line_count"),
    )


def change_set(current: DataFrame, stored: DataFrame) -> DataFrame:
    """repo_id, path, sha256 of the current rows that are new or have another hash than the stored one."""
    old = stored.select(*KEY, F.col("sha256").alias("old_sha"))
    return current.select(*KEY, "sha256").join(old, KEY, "left").where(~F.col("old_sha").eqNullSafe(F.col("sha256"))).select(*KEY, "sha256")


def upsert_snapshot(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot: rows of `changes` replace stored ones, deleted ones leave. An unchanged row has its lines
    counted only once, so a stored count survives a 0."""
    old = stored.select(*KEY, F.col("language").alias("o_language"), F.col("sha256").alias("o_sha"), F.col("size_bytes").alias("o_size"), F.col("line_count").alias("o_lines"))
    lines = F.when((F.col("status") == "unchanged") & (F.coalesce("line_count", F.lit(0)) == 0), F.col("o_lines")).otherwise(F.col("line_count"))
    j = changes.select(*FIELDS, "status").join(old, KEY, "full_outer").where(F.col("status").isNull() | (F.col("status") != "deleted"))
    kept = F.col("status").isNull()
    return j.select(
        *KEY,
        F.when(kept, F.col("o_language")).otherwise(F.col("language")).alias("language"),
        F.when(kept, F.col("o_sha")).otherwise(F.col("sha256")).alias("sha256"),
        F.when(kept, F.col("o_size")).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(kept, F.col("o_lines")).otherwise(lines).alias("line_count"),
    )


def upsert_meta(stored: DataFrame, new: DataFrame) -> DataFrame:
    """repo_meta with `new` merged in; of a known repository source and source_type stay as they are."""
    fields = ["git_branch", "git_commit", "last_indexed_at"]
    old = stored.select("repo_id", F.lit(True).alias("known"), *[F.col(c).alias(f"o_{c}") for c in ["source", "source_type", *fields]])
    j = new.select("repo_id", "source", "source_type", *fields).withColumn("fresh", F.lit(True)).join(old, "repo_id", "full_outer")
    known, fresh = F.coalesce("known", F.lit(False)), F.coalesce("fresh", F.lit(False))
    return j.select(
        "repo_id",
        *[F.when(known, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("source", "source_type")],
        *[F.when(fresh, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in fields],
    )


def last_indexed_at(meta: DataFrame) -> DataFrame:
    return meta.groupBy("repo_id").agg(F.max("last_indexed_at").alias("last_indexed_at"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files per language without deleted ones, the most frequent first."""
    return files.where("status != 'deleted'").groupBy("repo_id", "language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language", "repo_id")


def summary(files: DataFrame) -> DataFrame:
    """Counts of the manifest report, per repository."""
    live = F.col("status") != "deleted"
    return files.groupBy("repo_id").agg(
        F.count_if(live).alias("files"),
        F.coalesce(F.sum(F.when(live, F.col("line_count"))), F.lit(0)).cast("long").alias("lines"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("new", "modified", "unchanged", "deleted")],
    )


def summary_text(files: DataFrame, meta: DataFrame) -> DataFrame:
    """repo_id, report: the manifest report as text."""
    per = language_breakdown(files).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("o"), "language", "files"))).alias("l"))
    langs = F.array_join(F.transform("l", lambda x: F.format_string("'%s': %d", x["language"], x["files"])), ", ")
    j = summary(files).join(meta.select("repo_id", "source", "source_type", "git_commit"), "repo_id", "left").join(per, "repo_id", "left")
    line = lambda title, *cols: F.concat(F.lit(f"{title:<10}: "), *cols)
    return j.select(
        "repo_id",
        F.concat_ws(
            "\n",
            line("Repo", F.col("repo_id")),
            line("Source", F.coalesce("source", F.lit("")), F.lit(" ("), F.coalesce("source_type", F.lit("")), F.lit(")")),
            line("Commit", F.coalesce("git_commit", F.lit("N/A"))),
            line("Files", F.col("files").cast("string"), F.lit(" ("), F.format_number("lines", 0), F.lit(" lines)")),
            *[line(s.capitalize(), F.col(f"{s}_files").cast("string")) for s in ("new", "modified", "unchanged", "deleted")],
            line("Languages", F.lit("{"), F.coalesce(langs, F.lit("")), F.lit("}")),
        ).alias("report"),
    )


def newest_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in `order`; for wide rows without a struct to aggregate."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
