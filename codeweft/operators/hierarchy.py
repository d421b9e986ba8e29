"""Parent-child links to full hierarchies: root, depth, path and descendants of each node, and circles.

The links are contracted where they lie: a task holds the nodes of some blocks (parts of files) and joins every node to
its fragment's exit (its topmost ancestor there), with the distance. Exits whose parent lies elsewhere make up a quotient
forest, a small fraction of the nodes when blocks follow the files. Those of its nodes that hang on a root are solved by
that; the rest is contracted again, by new blocks that bring children to their parents, and so on until nothing is left.
The fragments are then expanded, level by level. Circles within a fragment show in the contraction of that level.

A task holds TASK_NODES nodes or so at any level and any size of the data: the number of tasks follows the number of
nodes, and blocks larger than that are split. At each level below the first about a quarter of the nodes are expected to
go, besides those on a root; a quotient that fits one task is gone at once.

Rows with null id are ignored; of rows with the same `ord` the deleted one holds. A parent that is not among the nodes
makes a root, as does a blank one; a node naming itself is a circle of one. Where several nodes list the same child
the smallest id counts. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import ship, stage

#: Nodes that a task holds, and that a block may have before it is split.
TASK_NODES, BLOCK_NODES = 100_000, 25_000
#: A fragment spans at most so many lines of a file, so that no single file fills a task.
BLOCK_LINES = 5_000
#: Nodes without a line are scattered over so many blocks of their file.
SCATTER = 256


def current_links(nodes: DataFrame) -> DataFrame:
    """id, parent (null for none), block: the nodes whose current version isn't deleted, with their parents."""
    newest = F.max(F.struct("ord", F.col("deleted_at").isNotNull().alias("deleted"), "parent_id", "repo_id", "file_path", "start_line"))
    live = stage(
        nodes.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(newest.alias("v"))
        .where(~F.col("v.deleted"))
        .select("id", "v.ord", "v.parent_id", F.xxhash64("v.repo_id", "v.file_path", F.coalesce(F.floor(F.col("v.start_line") / BLOCK_LINES), -1 - F.pmod(F.xxhash64("id"), F.lit(SCATTER)))).alias("block")),
        "live-nodes",
    )
    claims = nodes.select(F.col("id").alias("by"), F.col("ord").alias("by_ord"), F.explode("children").alias("child"))
    bare = live.where(F.col("parent_id").isNull()).select(F.col("id").alias("child"))
    owner = live.select(F.col("id").alias("by"), F.col("ord").alias("by_ord"))
    claimed = claims.join(bare, "child", "left_semi").join(owner, ["by", "by_ord"], "left_semi").groupBy("child").agg(F.min("by").alias("by"))
    return stage(
        live.join(claimed, live.id == claimed.child, "left").select("id", F.coalesce("parent_id", "by").alias("parent"), "block"), "links"
    )


def _fragments(ids: pa.Array, parents: pa.Array, steps: np.ndarray, lows: pa.Array, ways: pa.Array | None) -> dict[str, pa.Array]:
    """Contract the links among `ids`. A link has a number of steps, the smallest id it leads over (its end included), and
    the ids it leads over, down from its end to the node.

    exit, dist: the topmost ancestor within, and how many steps up; up, up_steps, up_low: the exit's own link, to a parent
    outside (null if it has none); low: the smallest id between the node and its exit, without the node; tin, size: the
    node's place and extent in a walk through its fragment, so that x is at or above y just when both have one exit and
    tin(x) <= tin(y) < tin(x) + size(x). Nodes of or under a circle within have `ring` (its smallest id) and dist -1 or
    -2 instead.
    """
    n = len(ids)
    par = pc.fill_null(pc.index_in(parents, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    order = pc.sort_indices(lows)
    rank = np.empty(n, np.int64)
    rank[order.to_numpy()] = np.arange(n)
    inner = par >= 0
    top, hops, dist, low = np.where(inner, par, np.arange(n)), inner.astype(np.int64), np.where(inner, steps, 0), np.where(inner, rank, n)
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        low = np.minimum(low, low[top])
        hops, dist = hops + hops[top], dist + dist[top]
        nxt = top[top]
        if (nxt == top).all():
            break
        top = nxt
    in_ring = par[top] >= 0
    ring = np.full(n, -1)
    if in_ring.any():
        on = np.unique(top[in_ring])
        seen = np.full(n, -1)
        for s in on:
            if seen[s] < 0:
                loop, x = [], s
                while seen[x] < 0:
                    seen[x] = n
                    loop.append(x)
                    x = par[x]
                seen[loop] = rank[loop].min()
        ring[in_ring] = seen[top[in_ring]]
        dist[in_ring] = np.where(seen[in_ring.nonzero()[0]] >= 0, -1, -2)
    tin, size = np.zeros(n, np.int64), np.ones(n, np.int64)
    free = (~in_ring).nonzero()[0]
    by_level = free[np.argsort(hops[free], kind="stable")]
    levels = np.split(by_level, np.flatnonzero(np.diff(hops[by_level])) + 1) if len(by_level) else []
    for idx in reversed(levels[1:]):
        np.add.at(size, par[idx], size[idx])
    for k, idx in enumerate(levels):
        if k:
            idx = idx[np.argsort(par[idx], kind="stable")]
            before = np.cumsum(size[idx]) - size[idx]
            first = np.r_[True, par[idx][1:] != par[idx][:-1]]
            tin[idx] = tin[par[idx]] + 1 + before - before[np.maximum.accumulate(np.where(first, np.arange(len(idx)), 0))]
    none = pa.array(in_ring)
    at = pa.array(top)
    value = lambda r, least, most: lows.take(order.take(pa.array(np.where((r < least) | (r >= most), None, r), pa.int64())))
    out = {
        "id": ids,
        "exit": pc.if_else(none, None, ids.take(at)),
        "dist": pa.array(dist),
        "up": pc.if_else(none, None, parents.take(at)),
        "up_steps": pa.array(steps[top]),
        "up_low": lows.take(at),
        "low": value(low, 0, n),
        "tin": pa.array(tin),
        "size": pa.array(size),
        "ring": value(ring, 0, n),
    }
    if ways is not None:
        own = ways.to_pylist()
        way: list = [[]] * n
        for idx in levels[1:]:
            for i in idx.tolist():
                way[i] = way[par[i]] + own[i]
        out["way"] = pa.array(way, pa.list_(pa.string()))
        out["up_way"] = ways.take(at)
    return out


_FRAGMENT = "id string, exit string, dist bigint, up string, up_steps bigint, up_low string, low string, tin bigint, size bigint, ring string"


def _contract(t: pa.Table) -> pa.Table:
    """The nodes of one task."""
    t = t.combine_chunks()
    one = lambda c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type)
    return pa.table(_fragments(one("id"), one("parent"), one("steps").to_numpy(zero_copy_only=False), one("low"), one("way") if "way" in t.column_names else None))


def _in_tasks(nodes: DataFrame, n: int, held: int) -> tuple[DataFrame, int]:
    """`nodes` with the task each belongs to, and how many tasks: whole blocks while they fit, parts of larger ones."""
    tasks = max(1, math.ceil(n / held))
    if tasks == 1:
        return nodes.withColumn("task", F.lit(0)), 1
    most = max(1, min(BLOCK_NODES, held // 2))
    large = nodes.groupBy("block").agg(F.ceil(F.count("*") / most).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0).cast("long"))
    return nodes.join(large, "block", "left").withColumn("task", F.pmod(F.xxhash64("block", part), F.lit(tasks)).cast("int")).drop("parts"), tasks


def _solve(nodes: DataFrame, paths: bool, held: int, level: int, tasks: int | None = None) -> DataFrame:
    """id, root, depth, way (the ids below the root down to the node; null on or under a circle) of every one of `nodes`:
    id, parent, steps, low, block and, with `paths`, way, of the link to the parent. depth -1: on a circle, -2: under one."""
    columns = ["id", "parent", "steps", "low", *["way"] * paths]
    if tasks is None:
        nodes, tasks = _in_tasks(nodes, nodes.count(), held)
    else:
        nodes = nodes.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int"))
    frags = stage(
        nodes.select(*columns, "task").repartition(tasks, "task").groupBy("task").applyInArrow(_contract, _FRAGMENT + ", way array<string>, up_way array<string>" * paths),
        f"fragments-{level}",
    )
    if not paths:
        frags = frags.withColumns({c: F.lit(None).cast("array<string>") for c in ("way", "up_way")})
    ends = frags.where((F.col("dist") == 0) & F.col("up").isNotNull()).select(F.col("id").alias("e"), F.col("up").alias("e_up"), F.col("up_steps").alias("e_steps"), F.col("up_low").alias("e_low"), F.col("up_way").alias("e_way"))
    # The exits' links, from exit to exit. `rooted`: the upper one has no parent, so the lower one is solved.
    links = stage(
        ends.join(frags, F.col("e_up") == F.col("id")).select(
            F.col("e").alias("id"), F.col("exit").alias("to"), (F.col("dist") + F.col("e_steps")).alias("steps"), F.least("e_low", "low").alias("low"), "tin", "ring",
            F.concat("way", "e_way").alias("way"), F.col("up").isNull().alias("rooted"),
        ),
        f"quotient-{level}",
    )
    minus = lambda k: F.lit(k).cast("long")
    solved = links.where("rooted").select("id", F.coalesce("ring", "to").alias("root"), F.when(F.col("ring").isNotNull(), minus(-2)).otherwise(F.col("steps")).alias("depth"), F.when(F.col("ring").isNull(), F.col("way")).alias("way"))
    rest = links.where("not rooted")
    entries = None
    if not rest.isEmpty():
        # Nodes of the next level: the unsolved, and as its roots the others that such ones hang on.
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0
        block = F.when(coin("id") & ~coin("to"), F.col("to")).otherwise(F.col("id"))
        below = rest.select("id", F.col("to").alias("parent"), "steps", "low", F.xxhash64(block, F.lit(level)).alias("block"), "way")
        over = rest.select(F.col("to").alias("id")).distinct().join(rest, "id", "left_anti").select(
            "id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("steps"), F.lit(None).cast("string").alias("low"), F.xxhash64("id", F.lit(level)).alias("block"), F.array().cast("array<string>").alias("way"))
        deeper = _solve(stage(below.unionByName(over), f"level-{level + 1}"), paths, held, level + 1)
        above = solved.select(F.col("id").alias("root"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("way").alias("a_way"))
        on_tree = (F.col("depth") >= 0) & (F.coalesce("a_depth", F.lit(0)) >= 0)
        more = deeper.join(over.select(F.col("id").alias("over")), F.col("id") == F.col("over"), "left_anti").join(above, "root", "left").select(
            "id", F.when(F.col("depth") < 0, F.col("root")).otherwise(F.coalesce("a_root", "root")).alias("root"),
            F.when(F.col("depth") < 0, F.col("depth")).when(F.col("a_depth") < 0, minus(-2)).otherwise(F.coalesce("a_depth", F.lit(0)) + F.col("depth")).alias("depth"),
            F.when(on_tree, F.concat(F.coalesce("a_way", F.array().cast("array<string>")), "way")).alias("way"),
        )
        more = stage(more, f"solved-{level}")
        solved = solved.unionByName(more)
        # In fragments of a circle through several, the nodes at or above the point where it comes in are on it.
        rings = more.where("depth = -1").select(F.col("id").alias("rid"))
        entries = links.join(rings, F.col("id") == F.col("rid"), "left_semi").select(F.col("to").alias("ring_exit"), F.col("tin").alias("at"))
    local = frags.where(F.col("ring").isNotNull() | F.col("up").isNull()).select("id", F.coalesce("ring", "exit").alias("root"), F.col("dist").alias("depth"), F.when(F.col("ring").isNull(), F.col("way")).alias("way"))
    far = frags.where(F.col("ring").isNull() & F.col("up").isNotNull()).alias("f")
    s = solved.alias("s")
    # Exits whose parent is nowhere among the nodes are roots: they have no row in `solved`.
    placed = far.join(s, F.col("f.exit") == F.col("s.id"), "left").select(
        "f.id", "f.exit", "f.tin", "f.size", F.coalesce("s.root", "f.exit").alias("root"),
        F.when(F.col("s.depth") < 0, F.col("s.depth")).otherwise(F.coalesce("s.depth", F.lit(0)) + F.col("f.dist")).alias("depth"),
        F.when(F.col("s.id").isNull(), F.col("f.way")).when(F.col("s.depth") >= 0, F.concat("s.way", "f.way")).alias("way"),
    )
    if entries is None:
        return local.unionByName(placed.select("id", "root", F.when(F.col("depth") < 0, minus(-2)).otherwise(F.col("depth")).alias("depth"), "way"))
    odd = placed.where("depth < 0")
    inside = (F.col("exit") == F.col("ring_exit")) & (F.col("tin") <= F.col("at")) & (F.col("at") < F.col("tin") + F.col("size"))
    on = odd.where("depth = -1").join(entries, inside, "left_semi").select(F.col("id").alias("oid"))
    odd = odd.join(on, F.col("id") == F.col("oid"), "left").select("id", "root", F.when(F.col("oid").isNotNull(), minus(-1)).otherwise(minus(-2)).alias("depth"), "way")
    return local.unionByName(placed.where("depth >= 0").select("id", "root", "depth", "way")).unionByName(odd)


def resolve_hierarchy(links: DataFrame, with_paths: bool = False, one_task: int = TASK_NODES, partitions: int | None = None) -> DataFrame:
    """node_id, root_id, depth and, with `with_paths`, path (ids from the root to the node; null on or under a circle)
    of each row of `links` (id, parent, block). depth -1: on a circle, -2: below one; root_id is then its smallest id.

    `one_task`: nodes that a task holds (64 at least); `partitions`: tasks of the first level, by default as many as that takes."""
    ship(links.sparkSession)
    nodes = links.select("id", "parent", F.lit(1).cast("long").alias("steps"), F.col("parent").alias("low"), "block", *[F.array("id").alias("way")] * with_paths)
    solved = _solve(nodes, with_paths, max(64, one_task), 0, partitions)
    out = solved.select(F.col("id").alias("node_id"), F.col("root").alias("root_id"), "depth", *[F.when(F.col("depth") >= 0, F.concat(F.array("root"), "way")).alias("path")] * with_paths)
    return out


def descendants(resolved: DataFrame) -> DataFrame:
    """ancestor_id, descendant_id, distance: every pair of a node and one below it, from the paths (a node of depth d
    gives d rows, so the result is as large as the sum of depths)."""
    d = resolved.where("depth > 0").select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("pos", "ancestor_id"))
    return d.select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


def circle_links(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """The links that run in circles: id, parent, root_id of each node on one."""
    on = resolved.where("depth = -1").select("node_id", "root_id")
    return links.join(on, links.id == on.node_id).select("id", "parent", "root_id")
