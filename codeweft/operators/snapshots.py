"""What changed between full snapshots, by content-defined chunks of the key-sorted snapshots.

Paths and hashes are compared in plain spelling. Rows without path, or of a snapshot repo_meta doesn't list, are
ignored; a null hash shows that the path exists, but never a change. Of repeated or conflicting rows of one path in one
snapshot the latest `indexed_at` holds (ties: the larger hash). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import is_blank, plain_hash, plain_path, ship, stage


def snapshot_order(meta: DataFrame) -> DataFrame:
    """repo_id, snapshot_id (of a delivery), seq (its snapshot's place from 1 on), label (smallest id of the snapshot), last (is it the repo's last)."""
    commit = F.lower(F.trim("git_commit"))
    group = F.when(is_blank(commit), F.concat(F.lit("delivery "), F.col("snapshot_id").cast("string"))).otherwise(commit)
    deliveries = meta.where(F.col("repo_id").isNotNull() & F.col("snapshot_id").isNotNull()).select("repo_id", "snapshot_id", group.alias("grp"), "last_indexed_at")
    snaps = deliveries.groupBy("repo_id", "grp").agg(F.min("last_indexed_at").alias("began"), F.min("snapshot_id").alias("label"))
    by_repo = Window.partitionBy("repo_id")
    snaps = snaps.select(
        "repo_id", "grp", "label", F.row_number().over(by_repo.orderBy("began", "label")).alias("seq"), F.count("*").over(by_repo).alias("n")
    )
    return deliveries.select("repo_id", "snapshot_id", "grp").distinct().join(snaps, ["repo_id", "grp"]).select("repo_id", "snapshot_id", "seq", "label", (F.col("seq") == F.col("n")).alias("last"))


def snapshot_rows(files: DataFrame, order: DataFrame) -> DataFrame:
    """repo_id, seq, path, sha: each path of each snapshot once, over all its deliveries."""
    rows = files.select("repo_id", "snapshot_id", plain_path(F.col("path")).alias("path"), plain_hash(F.col("sha256")).alias("sha"), "indexed_at").where(F.col("path") != "")
    newest = F.max(F.struct(F.col("sha").isNotNull().alias("known"), "indexed_at", "sha"))
    return (
        rows.join(order.select("repo_id", "snapshot_id", "seq"), ["repo_id", "snapshot_id"])
        .groupBy("repo_id", "seq", "path")
        .agg(newest.alias("v"))
        .select("repo_id", "seq", "path", F.col("v.sha").alias("sha"))
    )


_CHUNKED = "repo_id string, seq int, path string, sha string, chunk string"


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Give each row of a sorted partition the path its chunk begins with. A chunk also begins where a snapshot or the
    partition does: a chunk cut there matches nothing and its rows are compared one by one."""
    chunk, last = "", None
    for b in batches:
        repos, seqs, paths, cuts = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
        out = []
        for repo, seq, path, cut in zip(repos, seqs, paths, cuts):
            if cut or (repo, seq) != last:
                chunk, last = path, (repo, seq)
            out.append(chunk)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.string())], names=["repo_id", "seq", "path", "sha", "chunk"])


def chunk_rows(rows: DataFrame, mean_rows: int = 8) -> DataFrame:
    """Cut each key-sorted snapshot into chunks where the hash of a path says so, on average every `mean_rows` rows:
    the same keys give the same cuts in every snapshot, wherever rows came or went between them."""
    ship(rows.sparkSession)
    cut = (F.xxhash64("path") % mean_rows == 0).alias("cut")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartitionByRange(n, "repo_id", "seq", "path")
        .sortWithinPartitions("repo_id", "seq", "path")
        .select("repo_id", "seq", "path", "sha", cut)
        .mapInArrow(_label, _CHUNKED)
    )


def snapshot_changes(files: DataFrame, meta: DataFrame, mean_rows: int = 8) -> DataFrame:
    """repo_id, snapshot_id, path, change_kind, old_sha, new_sha between each snapshot and the one before.

    Chunks with the same first key and digest in both snapshots hold the same rows and are dropped from both; the
    rows of all others meet in a full outer join. How the snapshots are cut decides only how many rows are joined.
    """
    order = stage(snapshot_order(meta), "snapshot-order")
    rows = stage(snapshot_rows(files, order), "snapshot-rows")
    chunked = stage(chunk_rows(rows, mean_rows), "chunks")
    snaps = order.select("repo_id", "seq", "label", "last").distinct()
    digests = stage(
        chunked.groupBy("repo_id", "seq", "chunk").agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("path", F.coalesce("sha", F.lit("?")))).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit(7), F.coalesce("sha", F.lit("?")), "path")).alias("h2"),
        ),
        "digests",
    )
    # Each chunk counts twice: for its own snapshot (side 1) and, unless that is the last, for the next (side 0).
    sides = digests.select("repo_id", "seq", "chunk", "n", "h1", "h2", F.lit(1).alias("side")).where("seq > 1").unionByName(
        digests.join(snaps.where(~F.col("last")).select("repo_id", "seq"), ["repo_id", "seq"], "left_semi").select(
            "repo_id", (F.col("seq") + 1).alias("seq"), "chunk", "n", "h1", "h2", F.lit(0).alias("side")
        )
    )
    odd = (
        sides.groupBy("repo_id", "seq", "chunk", "n", "h1", "h2")
        .agg(F.count("*").alias("times"), F.max("side").alias("side"))
        .where("times = 1")
        .select("repo_id", (F.col("seq") - 1 + F.col("side")).cast("int").alias("own"), "chunk", "side")
    )
    left = chunked.join(odd, (chunked.repo_id == odd.repo_id) & (chunked.seq == odd.own) & (chunked.chunk == odd.chunk)).select(
        chunked.repo_id, (F.col("own") + 1 - F.col("side")).cast("int").alias("seq"), "path", "sha", "side"
    )
    # One row per path with what either side says: a full outer join of the two sides by grouping, in one shuffle.
    pairs = left.groupBy("repo_id", "seq", "path").agg(
        F.max(F.when(F.col("side") == 0, F.struct(F.lit(True).alias("there"), "sha"))).alias("old"),
        F.max(F.when(F.col("side") == 1, F.struct(F.lit(True).alias("there"), "sha"))).alias("new"),
    )
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.sha") != F.col("new.sha"), "changed")
    )
    return (
        pairs.select("repo_id", "seq", "path", kind.alias("change_kind"), F.col("old.sha").alias("old_sha"), F.col("new.sha").alias("new_sha"))
        .where(F.col("change_kind").isNotNull())
        .join(snaps.select("repo_id", "seq", F.col("label").alias("snapshot_id")), ["repo_id", "seq"])
        .select("repo_id", "snapshot_id", "path", "change_kind", "old_sha", "new_sha")
    )
