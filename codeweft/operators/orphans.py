"""References to records that do not exist: direct orphans, and those inherited down the foreign keys.

Nulls and blanks: a null or blank reference points nowhere by intent and is never an orphan; a row of the nodes with
null `id` is ignored; a null time makes nothing late. Repeated rows count once; of rows with the same `ord` the deleted
one holds. Empty tables give no rows. Only the named columns are read, so further columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import is_blank, stage, stage_counted

#: (table, field) pairs that refer to ir_nodes.id.
REFERENCE_FIELDS = (
    ("ir_call_edges", "caller_id"),
    ("ir_call_edges", "callee_id"),
    ("ir_inheritance_edges", "parent_id"),
    ("ir_reference_edges", "target_id"),
)


def node_states(nodes: DataFrame) -> DataFrame:
    """One row per id: whether its current version is deleted, that version's parent, and when the id first came."""
    newest = F.max(F.struct("ord", F.col("deleted_at").isNotNull().alias("deleted"), "parent_id"))
    return (
        nodes.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(newest.alias("v"), F.min("parsed_at").alias("first_parsed"))
        .select("id", "v.deleted", "v.parent_id", "first_parsed")
    )


def references(edges: dict[str, DataFrame]) -> DataFrame:
    """Every reference that names something: table_name, field_name, edge_id, ref_id, recorded_at."""
    parts = [
        edges[t]
        .select(F.lit(t).alias("table_name"), F.lit(f).alias("field_name"), F.col("id").alias("edge_id"), F.col(f).alias("ref_id"), "recorded_at")
        .where(~is_blank(F.col("ref_id")))
        for t, f in REFERENCE_FIELDS
        if t in edges
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def find_orphans(nodes: DataFrame, edges: dict[str, DataFrame]) -> DataFrame:
    """table_name, field_name, edge_id, ref_id, recorded_at, state, origin, level of each orphan reference.

    origin `direct` (level 0): the node is `missing`, `deleted`, or came `late`. origin `inherited` (level n): the node
    exists, but n parent links above it a parent is missing or deleted; found by semi-joins down the parent key until
    a round adds nothing (each node has one parent, so a round never meets a node twice and circles are never entered).

    Plan: the references are first reduced to their distinct ids with map-side combination, so a hot id is one row
    when it meets the nodes; only the faulty ids (staged) go back to the references. Both sides of that second join
    are plain exchanges, which the adaptive skew join can split.
    """
    states = stage(node_states(nodes), "node-states")
    refs = references(edges)
    live = states.where(~F.col("deleted") & ~is_blank(F.col("parent_id")))
    ids = (
        refs.select("ref_id", "recorded_at")
        .unionByName(live.select(F.col("parent_id").alias("ref_id"), F.lit(None).cast("timestamp_ntz" if dict(refs.dtypes)["recorded_at"] == "timestamp_ntz" else "timestamp").alias("recorded_at")))
        .groupBy("ref_id")
        .agg(F.min("recorded_at").alias("first_used"))
    )
    state = (
        F.when(F.col("id").isNull(), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("first_parsed") > F.col("first_used"), "late")
    )
    faulty = stage(
        ids.join(states, ids.ref_id == states.id, "left").select("ref_id", state.alias("state"), "first_parsed").where(F.col("state").isNotNull()),
        "faulty-ids",
    )
    direct = (
        refs.join(faulty, "ref_id")
        .where((F.col("state") != "late") | (F.col("first_parsed") > F.col("recorded_at")))
        .withColumns({"origin": F.lit("direct"), "level": F.lit(0)})
        .drop("first_parsed")
    )
    gone = faulty.where(F.col("state") != "late").select(F.col("ref_id").alias("above"))
    inherited = _cascade(live, gone)
    if inherited is None:
        return direct
    below = (
        refs.join(inherited, refs.ref_id == inherited.id)
        .drop("id")
        .withColumns({"state": F.lit("inherited"), "origin": F.lit("inherited")})
    )
    return direct.unionByName(below)


def _cascade(live: DataFrame, gone: DataFrame) -> DataFrame | None:
    """id, level of the live nodes under something that is gone."""
    rounds, frontier, level = [], gone, 1
    while True:
        found, n = stage_counted(
            live.join(frontier, live.parent_id == F.col("above"), "left_semi").select("id", F.lit(level).alias("level")),
            f"orphans-{level}",
        )
        if not n:
            break
        rounds.append(found)
        frontier, level = found.select(F.col("id").alias("above")), level + 1
    if not rounds:
        return None
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, month, origin and state."""
    month = F.date_format("recorded_at", "yyyy-MM")
    return (
        orphans.dropDuplicates(["table_name", "field_name", "edge_id", "state"])
        .groupBy("table_name", month.alias("month"), "origin", "state")
        .agg(F.count("*").alias("n"))
    )
