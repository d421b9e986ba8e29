"""A stream of listed files kept up to date: each micro-batch is taken through the manifest by its batch id.

The manifest drops what was taken before with the same checksum, writes the rest under the batch id and commits it, so a
batch that Spark repeats after a failure is written once. What a batch took is handed on to `then`. Batch ids belong to a checkpoint: a new checkpoint needs a new manifest folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators.incremental import Manifest, latest_rows
from codeweft.session import plain_hash, plain_path


def consume(stream: DataFrame, folder: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start consuming `stream` (columns of `files`); `trigger` as in DataStreamWriter.trigger, all that is there by default."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.select("repo_id", plain_path(F.col("path")).alias("path"), plain_hash(F.col("sha256")).alias("sha256"), "size_bytes", "indexed_at")
        rows = rows.where(F.col("sha256").isNotNull() & (F.col("path") != "") & F.col("indexed_at").isNotNull())
        m = Manifest(df.sparkSession, folder)
        m.process(batch_id, latest_rows(rows))
        if then:
            then(m.batches().where(F.col("run_id") == batch_id), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
