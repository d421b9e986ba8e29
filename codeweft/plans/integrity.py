"""Queries of the general data problems: orphan references, snapshot changes, hierarchies, incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import hierarchy, incremental, orphans, snapshots
from codeweft.session import stage, table

EDGE_TABLES = ("ir_call_edges", "ir_inheritance_edges", "ir_reference_edges")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(table(spark, d, "ir_nodes"), {t: table(spark, d, t) for t in EDGE_TABLES})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).where("origin = 'direct'").select("table_name", "field_name", "edge_id", "state").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = snapshots.snapshot_changes(table(spark, d, "files"), table(spark, d, "repo_meta"))
    return out.select("repo_id", "snapshot_id", "path", "change_kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolve_hierarchy(hierarchy.current_links(table(spark, d, "ir_nodes")))
    return out.where("depth >= 4 or depth < 0").select("node_id", "root_id", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolve_hierarchy(hierarchy.current_links(table(spark, d, "ir_nodes")), with_paths=True)
    return out.select("node_id", "root_id", "depth", F.concat_ws(" > ", "path").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(stage(hierarchy.resolve_hierarchy(hierarchy.current_links(table(spark, d, "ir_nodes")), with_paths=True), "resolved"))


def p5_circles(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.current_links(table(spark, d, "ir_nodes"))
    return hierarchy.circle_links(links, hierarchy.resolve_hierarchy(links))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.replay_runs(table(spark, d, "files"), table(spark, d, "index_runs")).select("run_id", "repo_id", "path")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p5_found, p5_paths, p5_descendants, p5_circles, p6_found)}

_STATES = """
  cur AS (SELECT id, deleted_at IS NOT NULL AS deleted, parent_id FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, deleted_at NULLS LAST) rn FROM ir_nodes) WHERE rn = 1),
  firsts AS (SELECT id, min(parsed_at) AS first_parsed FROM ir_nodes GROUP BY id),
  states AS (SELECT cur.*, first_parsed FROM cur JOIN firsts USING (id)),
  refs AS (
    SELECT DISTINCT 'ir_call_edges' AS table_name, 'caller_id' AS field_name, id AS edge_id, caller_id AS ref_id, recorded_at FROM ir_call_edges
    UNION ALL SELECT DISTINCT 'ir_call_edges', 'callee_id', id, callee_id, recorded_at FROM ir_call_edges
    UNION ALL SELECT DISTINCT 'ir_inheritance_edges', 'parent_id', id, parent_id, recorded_at FROM ir_inheritance_edges
    UNION ALL SELECT DISTINCT 'ir_reference_edges', 'target_id', id, target_id, recorded_at FROM ir_reference_edges),
  direct AS (SELECT DISTINCT table_name, field_name, edge_id, ref_id, recorded_at,
      CASE WHEN s.id IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN first_parsed > recorded_at THEN 'late' END AS state
    FROM refs LEFT JOIN states s ON ref_id = s.id WHERE trim(ref_id) <> '')"""

_FOREST = """
  cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, deleted_at NULLS LAST) rn FROM ir_nodes) WHERE rn = 1 AND deleted_at IS NULL),
  claim AS (SELECT child, min(id) AS owner FROM (SELECT id, unnest(children) AS child FROM cur) GROUP BY child),
  link AS (SELECT cur.id, coalesce(cur.parent_id, owner) AS parent FROM cur LEFT JOIN claim ON cur.id = child),
  tree AS (SELECT id AS node_id, id AS root_id, CAST(0 AS BIGINT) AS depth, id AS path FROM link WHERE parent IS NULL OR parent NOT IN (SELECT id FROM link)
    UNION ALL SELECT link.id, root_id, depth + 1, path || ' > ' || link.id FROM link JOIN tree ON parent = node_id),
  odd AS (SELECT id, parent FROM link WHERE id NOT IN (SELECT node_id FROM tree)),
  reach AS (SELECT id, parent AS up FROM odd UNION SELECT reach.id, odd.parent FROM reach JOIN odd ON up = odd.id),
  ring AS (SELECT id FROM reach WHERE id = up),
  bad AS (SELECT reach.id AS node_id, min(up) AS root_id, CAST(CASE WHEN reach.id IN (SELECT id FROM ring) THEN -1 ELSE -2 END AS BIGINT) AS depth
    FROM reach WHERE up IN (SELECT id FROM ring) GROUP BY reach.id)"""

SQL = {
    "p2_found": f"WITH {_STATES} SELECT DISTINCT table_name, field_name, edge_id, state FROM direct WHERE state IS NOT NULL",
    "p2_report": f"""WITH RECURSIVE {_STATES},
  below AS (SELECT c.id FROM cur c LEFT JOIN cur p ON c.parent_id = p.id WHERE NOT c.deleted AND trim(c.parent_id) <> '' AND (p.id IS NULL OR p.deleted)
    UNION SELECT c.id FROM cur c JOIN below b ON c.parent_id = b.id WHERE NOT c.deleted),
  found AS (SELECT table_name, field_name, edge_id, recorded_at, 'direct' AS origin, state FROM direct WHERE state IS NOT NULL
    UNION ALL SELECT DISTINCT table_name, field_name, edge_id, recorded_at, 'inherited', 'inherited' FROM refs JOIN below ON ref_id = below.id)
  SELECT table_name, strftime(recorded_at, '%Y-%m') AS month, origin, state, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY ALL""",
    "p3_found": r"""WITH d AS (SELECT DISTINCT repo_id, snapshot_id, coalesce(lower(nullif(trim(git_commit), '')), 'delivery ' || snapshot_id) AS grp, last_indexed_at FROM repo_meta),
  s AS (SELECT repo_id, grp, min(last_indexed_at) AS began, min(snapshot_id) AS label FROM d GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY began, label) AS seq FROM s),
  m AS (SELECT DISTINCT d.repo_id, d.snapshot_id, o.seq FROM d JOIN o USING (repo_id, grp)),
  r AS (SELECT f.repo_id, seq, regexp_replace(regexp_replace(trim(path), '[/\\]+', '/', 'g'), '^(\./)+', '') AS path,
      max(trim(regexp_replace(lower(trim(sha256)), '^sha256:', ''))) AS sha FROM files f JOIN m ON f.repo_id = m.repo_id AND f.snapshot_id = m.snapshot_id GROUP BY ALL),
  p AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.seq, b.seq) AS seq, coalesce(a.path, b.path) AS path,
      CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.sha <> b.sha THEN 'changed' END AS change_kind
    FROM (SELECT * FROM r WHERE seq > 1) a FULL JOIN (SELECT repo_id, seq + 1 AS seq, path, sha FROM r) b ON a.repo_id = b.repo_id AND a.seq = b.seq AND a.path = b.path)
  SELECT p.repo_id, label AS snapshot_id, path, change_kind FROM p JOIN o ON p.repo_id = o.repo_id AND p.seq = o.seq WHERE change_kind IS NOT NULL""",
    "p5_found": f"WITH RECURSIVE {_FOREST} SELECT node_id, root_id, depth FROM tree WHERE depth >= 4 UNION ALL SELECT * FROM bad",
    "p5_paths": f"WITH RECURSIVE {_FOREST} SELECT node_id, root_id, depth, path FROM tree UNION ALL SELECT *, '' FROM bad",
    "p5_descendants": f"""WITH RECURSIVE {_FOREST},
  pairs AS (SELECT parent AS ancestor_id, id AS descendant_id, CAST(1 AS BIGINT) AS distance FROM link WHERE id IN (SELECT node_id FROM tree WHERE depth > 0)
    UNION ALL SELECT link.parent, descendant_id, distance + 1 FROM pairs JOIN link ON link.id = ancestor_id WHERE link.parent IN (SELECT node_id FROM tree))
  SELECT * FROM pairs""",
    "p5_circles": f"WITH RECURSIVE {_FOREST} SELECT link.id, parent, root_id FROM link JOIN bad ON link.id = node_id WHERE depth = -1",
    "p6_found": r"""WITH f AS (SELECT DISTINCT repo_id, regexp_replace(regexp_replace(trim(path), '[/\\]+', '/', 'g'), '^(\./)+', '') AS path,
      trim(regexp_replace(lower(trim(sha256)), '^sha256:', '')) AS sha, indexed_at FROM files),
  seen AS (SELECT run_id, started_at, repo_id, path, arg_max(sha, (indexed_at, sha)) AS sha
    FROM f JOIN index_runs ON status = 'succeeded' AND indexed_at <= started_at GROUP BY ALL),
  step AS (SELECT *, lag(sha) OVER (PARTITION BY repo_id, path ORDER BY started_at, run_id) AS before FROM seen)
  SELECT run_id, repo_id, path FROM step WHERE before IS NULL OR before <> sha""",
}
