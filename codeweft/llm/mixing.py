"""Mix sources to target shares by a curriculum whose weights change over time.

Each source has a weight schedule w(t), t from 0 to 1, with integral equal to its target share; at every t the weights
of all sources add up to 1. Integrated, it says how many tokens of the source are due by time t; a copy of a document
that begins after c tokens of its source is due when that demand reaches c, so inverting the demand gives the copy its
training position. The copies are then range-sorted by position.

The total is the largest that all sources can meet within their `max_repeats`, so that shares come out as targeted up
to one document each. Sources without tokens are left out and the shares of the others scaled to 1; documents of a
source without target, with null source or without tokens are never drawn. Repeated rows of a document count once.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.encoding import token_counts
from codeweft.session import stage

#: Slope of the schedules: sources of short texts begin above their share and end below it, long ones the other way.
TILT = 0.5
#: Buckets of a source's shuffled order for cumulative sums; a bucket holds this share of the source's copies.
BUCKETS = 1 << 16


def source_plan(sized: DataFrame, targets: DataFrame, total: int | None = None, tilt: float = TILT, slopes: dict[str, float] | None = None) -> DataFrame:
    """source, target_share, max_repeats, share (scaled), available, demand (tokens to draw), slope. One row per source:
    the window over all sources runs over the target table's few rows.

    `slopes` is the caller's schedule: a source's weight goes from share * (1 - slope) to share * (1 + slope), sources
    that it doesn't name stay level. Slopes are shifted so that all weights add up to 1 at any time, and scaled down
    together where that takes one beyond 1. By default they follow the mean length of a source's texts, up to `tilt`."""
    avail = sized.groupBy("source").agg(F.sum("tokens").alias("available"), (F.sum("tokens") / F.count("*")).alias("mean_tokens"))
    goals = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = Window.partitionBy()
    p = goals.join(avail, "source").where("available > 0")
    # Sums of doubles depend on their order; rounded, every run gives the same plan.
    p = p.withColumn("share", F.round(F.col("target_share") / F.sum("target_share").over(every), 12))
    most = F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(every)
    p = p.withColumn("total", F.least(most, F.lit(float(total))) if total is not None else most)
    p = p.withColumn("demand", F.floor(F.col("share") * F.col("total")).cast("long"))
    # Slopes add up to 0 when weighted by share, and none exceeds the tilt: every schedule stays positive.
    given = slopes is not None
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in slopes.items() for x in kv])[F.col("source")], F.lit(0.0)) if slopes else F.lit(0.0)
    p = p.withColumn("raw", named.cast("double") if given else F.percent_rank().over(Window.orderBy("mean_tokens", "source")))
    p = p.withColumn("raw", F.col("raw") - F.sum(F.col("raw") * F.col("share")).over(every))
    most_raw = F.max(F.abs("raw")).over(every)
    scale = 1 / F.greatest(most_raw, F.lit(1.0)) if given else F.lit(tilt) / F.greatest(most_raw, F.lit(1e-9))
    return p.withColumn("slope", F.round(F.col("raw") * scale, 9)).drop("raw", "mean_tokens")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, tilt: float = TILT, seed: int = 17, slopes: dict[str, float] | None = None, **tokenizer) -> DataFrame:
    """position (0 to 1), doc_id, source, copy (from 0), tokens: the drawn copies in training order.

    Cumulative sums run in two steps, bucket totals per source first, then within a bucket, so that no task ever holds
    a source. A bucket is a range of the seeded hash by which each round through a source is shuffled."""
    known = docs.where(F.col("source").isNotNull() & F.col("text").isNotNull())
    counted = token_counts(known.select("doc_id", "text"), **tokenizer).where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    sized = stage(known.groupBy("doc_id").agg(F.min("source").alias("source")).join(counted, "doc_id"), "sized")
    plan = stage(source_plan(sized, targets, total, tilt, slopes), "mix-plan")
    copies = sized.join(plan.select("source", "available", "demand", "slope"), "source").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("demand") / F.col("available")).cast("int") - 1))
    )
    copies = copies.where("demand > 0").withColumn("h", F.xxhash64("doc_id", "copy", F.lit(seed)))
    copies = copies.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * BUCKETS).cast("int"))
    sums = copies.groupBy("source", "copy", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "copy", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("source", "copy", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["source", "copy", "bucket"])
    placed = placed.withColumn("begin", F.col("copy") * F.col("available") + F.col("bucket_start") + F.col("inside")).where("begin < demand")
    # Demand by time t is demand * (t + slope * (t*t - t)); its inverse at the copy's middle.
    x = F.least((F.col("begin") + F.col("tokens") / 2.0) / F.col("demand"), F.lit(1.0))
    a = F.col("slope")
    root = (-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * x)) / (2 * a)
    placed = placed.withColumn("position", F.least(F.when(F.abs(a) < 1e-6, x).otherwise(root), F.lit(1.0)))
    return placed.select("position", "doc_id", "source", "copy", "tokens").orderBy("position", "doc_id", "copy")


def mix_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, documents, tokens, share reached, most_used, max_repeats of every source with a target."""
    used = drawn.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"), (F.max("copy") + 1).alias("most_used"))
    goals = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    share = F.coalesce("tokens", F.lit(0)) / F.sum("tokens").over(Window.partitionBy())
    return goals.join(used, "source", "left").select(
        "source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), share.alias("share"), F.coalesce("most_used", F.lit(0)).alias("most_used"), "max_repeats"
    )
