"""Process only new or changed records: a manifest of what was taken, batches by run id, and a commit after each.

A run lists what it can see, drops what the manifest holds with the same checksum, writes the rest as the batch of its
run id (writing again replaces it) and then commits by adding one small file. A run that dies before the commit leaves
nothing that later runs can see, so nothing is skipped or repeated; a committed run that is tried again does nothing.
Runs that are due together are caught up together: they read the manifest once, are written as one batch and committed
by one file, and each of them takes what it would have taken alone.
Rows with null path, hash or time are ignored: they can't be told from others. Ties on `indexed_at` go to the larger
hash. The size is kept beside the checksum, which alone decides. Empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.session import list_names, new_path, plain_hash, plain_path, read_text, stage, write_text

BATCH = "repo_id string, path string, sha256 string, size_bytes bigint, seq int, run_id bigint"
#: Runs after which the manifest is written out as one state.
COMPACT_EVERY = 16
#: Runs that a replay catches up at once.
RUNS_AT_ONCE = 16


class Manifest:
    """The manifest in a folder: `batches/<run>` and `states/<seq>` as parquet, `commits/<seq>-<run>.json` and
    `state-marks/<seq>.json` beside them; what has no mark doesn't count. A batch of several runs has the number and id
    of the last, and its commit names them all. A mark names the runs before it, so that only later commits are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _since(self, seq: int) -> list[tuple[int, int, list[int]]]:
        """(seq, batch, runs) of the commits after number `seq`."""
        names = [x for x in list_names(self.spark, f"{self.folder}/commits") if x.endswith(".json")]
        later = [(k, batch, x) for x in names for k, batch in [tuple(map(int, x[:-5].split("-", 1)))] if k > seq]
        return [(k, batch, json.loads(read_text(self.spark, f"{self.folder}/commits/{x}"))["runs"]) for k, batch, x in later]

    def committed(self) -> list[tuple[int, int]]:
        """(seq, run_id) of the committed runs, in their order."""
        mark = self.state_seq()
        runs = json.loads(read_text(self.spark, f"{self.folder}/state-marks/{mark:09d}.json"))["runs"] if mark else []
        for _, _, more in self._since(mark):
            runs += more
        return list(enumerate(runs, 1))

    def batches(self) -> DataFrame:
        """Every record that a committed run took."""
        reader = self.spark.read.schema(BATCH)
        paths = [f"{self.folder}/batches/{int(x[:-5].split('-', 1)[1])}" for x in list_names(self.spark, f"{self.folder}/commits") if x.endswith(".json")]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], BATCH)

    def last_taken(self) -> DataFrame:
        """repo_id, path and the checksum and size last taken: the newest state and the batches since."""
        mark = self.state_seq()
        paths = [f"{self.folder}/batches/{batch}" for _, batch, _ in self._since(mark)]
        paths += [f"{self.folder}/states/{mark}"] if mark else []
        rows = self.spark.read.schema(BATCH).parquet(*paths) if paths else self.spark.createDataFrame([], BATCH)
        newest = F.max(F.struct("seq", "sha256", "size_bytes", "run_id")).alias("v")
        return rows.groupBy("repo_id", "path").agg(newest).select("repo_id", "path", "v.sha256", "v.size_bytes", "v.seq", "v.run_id")

    def state_seq(self) -> int:
        """The run number up to which the newest state goes, 0 for none."""
        return max((int(x[:-5]) for x in list_names(self.spark, f"{self.folder}/state-marks") if x.endswith(".json")), default=0)

    def compact(self) -> None:
        """Write what was last taken of every path as a state, so that later runs needn't read all batches before it."""
        runs = [r for _, r in self.committed()]
        self.last_taken().write.mode("overwrite").parquet(f"{self.folder}/states/{len(runs)}")
        write_text(self.spark, f"{self.folder}/state-marks/{len(runs):09d}.json", json.dumps({"runs": runs}))

    def write_batch(self, runs: int | Sequence[int], listing: DataFrame) -> int:
        """Write what `listing` (repo_id, path, sha256, size_bytes and, for several runs, run_id: what each of them sees
        that those before it didn't) holds beyond the manifest as the batch of `runs`; the number of its last run."""
        runs = [runs] if isinstance(runs, int) else list(runs)
        if "run_id" not in listing.columns:
            listing = listing.withColumn("run_id", F.lit(runs[0]).cast("long"))
        before = len(self.committed())
        place = F.array_position(_array(runs, "bigint"), F.col("run_id")).cast("int") + before
        previous = F.lag("sha256").over(Window.partitionBy("repo_id", "path").orderBy("seq"))
        listed = listing.select("repo_id", "path", "sha256", "size_bytes", place.alias("seq"), "run_id").withColumn("previous", previous)
        taken = self.last_taken().select(*(F.col(c).alias(f"taken_{c}") for c in ("repo_id", "path", "sha256")))
        same = F.col("previous").isNull()
        for c in ("repo_id", "path", "sha256"):
            same &= F.col(c) == F.col(f"taken_{c}")
        fresh = listed.where(F.col("previous").isNull() | (F.col("previous") != F.col("sha256"))).join(taken, same, "left_anti")
        fresh.drop("previous").write.mode("overwrite").parquet(f"{self.folder}/batches/{runs[-1]}")
        return before + len(runs)

    def commit(self, runs: int | Sequence[int], seq: int) -> None:
        runs = [runs] if isinstance(runs, int) else list(runs)
        write_text(self.spark, f"{self.folder}/commits/{seq:09d}-{runs[-1]}.json", json.dumps({"runs": runs}))

    def process(self, runs: int | Sequence[int], listing: DataFrame) -> bool:
        """One run, or several that are due together, in their order; false when all were committed before."""
        done = {r for _, r in self.committed()}
        due = [r for r in ([runs] if isinstance(runs, int) else runs) if r not in done]
        if not due:
            return False
        if "run_id" in listing.columns:
            listing = listing.where(F.array_contains(_array(due, "bigint"), F.col("run_id")))
        seq = self.write_batch(due, listing)
        self.commit(due, seq)
        if seq // COMPACT_EVERY > (seq - len(due)) // COMPACT_EVERY:
            self.compact()
        return True


def _array(values: Sequence, kind: str) -> Column:
    """A constant array, as one expression however many values there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def first_at_or_after(c: Column, starts: Sequence, kind: str) -> Column:
    """The index of the first of `starts` (ascending) that isn't before `c`, their number if there is none: a binary search."""
    if not starts:
        return F.lit(0)
    sorted_ = _array([s.isoformat(sep=" ") for s in starts], kind)
    lo, hi = "lo", "hi"

    def halve(r: Column, _: Column) -> Column:
        mid = F.floor((r[lo] + r[hi]) / 2).cast("int")
        before = F.get(sorted_, mid) < c
        open_ = r[lo] < r[hi]
        return F.struct(F.when(open_ & before, mid + 1).otherwise(r[lo]).alias(lo), F.when(open_ & ~before, mid).otherwise(r[hi]).alias(hi))

    steps = F.sequence(F.lit(0), F.lit(len(starts).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias(lo), F.lit(len(starts)).alias(hi)), halve)[lo]


def latest_rows(files: DataFrame, *more: str) -> DataFrame:
    """Of each path (and value of the columns `more`) the row that arrived last."""
    newest = F.max(F.struct("indexed_at", "sha256", "size_bytes")).alias("v")
    return files.groupBy("repo_id", "path", *more).agg(newest).select("repo_id", "path", "v.sha256", "v.size_bytes", *more)


def replay_runs(files: DataFrame, runs: DataFrame, folder: str | None = None, at_once: int = RUNS_AT_ONCE) -> DataFrame:
    """run_id, repo_id, path, sha256, size_bytes: what each succeeded run of `runs` takes of `files`.

    The runs go one after the other through the manifest, `at_once` of them caught up together. Arrivals are reduced to
    the last of each path for the run that is the first to see them, and written once, parted by what is caught up
    together; a path's latest row can only have moved in a run that sees a new arrival of it, so no arrival is read
    twice. Runs are few (a run log, not data) and collected.
    """
    spark = files.sparkSession
    kind = dict(runs.dtypes)["started_at"]
    log = runs.where((F.lower(F.trim("status")) == "succeeded") & F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
    log = log.groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.min("started_at").alias("began")).orderBy("began", "run_id").select("run_id", F.col("began").cast("timestamp_ntz").alias("began")).collect()
    rows = files.select("repo_id", plain_path(F.col("path")).alias("path"), plain_hash(F.col("sha256")).alias("sha256"), "size_bytes", F.col("indexed_at").cast(kind).cast("timestamp_ntz").alias("indexed_at")).where(
        F.col("sha256").isNotNull() & (F.col("path") != "") & F.col("indexed_at").isNotNull() & F.col("repo_id").isNotNull()
    )
    manifest = Manifest(spark, folder or new_path(spark, "manifest"))
    if not log:
        return manifest.batches().drop("seq")
    ids, starts = [r.run_id for r in log], [r.began for r in log]
    seen = rows.withColumn("first_run", first_at_or_after(F.col("indexed_at"), starts, "timestamp_ntz")).where(F.col("first_run") < len(log))
    seen = latest_rows(seen, "first_run").withColumns({"run_id": F.get(_array(ids, "bigint"), F.col("first_run")), "part": F.floor(F.col("first_run") / at_once).cast("int")}).drop("first_run")
    arrivals = stage(seen, "arrivals", ["part"])
    for k in range(0, len(log), at_once):
        manifest.process(ids[k : k + at_once], arrivals.where(F.col("part") == k // at_once).drop("part"))
    return manifest.batches().drop("seq")
