"""Queries of the code-intelligence operators over the test tables, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import constants as C
from codeweft.functions import lexical as L
from codeweft.operators import graph, manifest, resolve
from codeweft.session import plain_hash, plain_path, stage, table

#: Rows that arrived before are the stored state of a manifest, later ones the current listing.
CUT = "2025-06-01 00:00:00"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(key: str, table_: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


# --- files: listing, languages, manifests

_PLAIN = r"regexp_replace(regexp_replace(trim(path), '[/\\]+', '/', 'g'), '^(\./)+', '')"
_SHA = "trim(regexp_replace(lower(trim(sha256)), '^sha256:', ''))"
_EXT = r"lower(regexp_extract(split_part(path, '/', -1), '^.+(\.[^.]+)$', 1))"


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files")
    return f.withColumns({"path": plain_path(F.col("path")), "sha256": plain_hash(F.col("sha256"))})


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return manifest.latest(_files(spark, d).where(F.col("indexed_at") < F.lit(CUT).cast("timestamp_ntz")))


def _current(spark: SparkSession, d: str) -> DataFrame:
    return manifest.latest(_files(spark, d).where(F.col("indexed_at") >= F.lit(CUT).cast("timestamp_ntz")))


def _status(spark: SparkSession, d: str) -> DataFrame:
    return manifest.file_status(_current(spark, d), _stored(spark, d))


# arg_max skips nulls, so nullable columns go through a struct.
_LATEST = """SELECT repo_id, path, v.language AS language, v.sha AS sha256, v.size_bytes AS size_bytes, v.line_count AS line_count FROM (
    SELECT repo_id, path, arg_max({{'language': language, 'sha': sha, 'size_bytes': size_bytes, 'line_count': line_count}}, (indexed_at, sha)) AS v FROM f WHERE {} GROUP BY repo_id, path)"""
_MANIFEST = f"""f AS (SELECT * EXCLUDE (path), {_PLAIN} AS path, {_SHA} AS sha FROM files),
  stored AS ({_LATEST.format(f"indexed_at < TIMESTAMP '{CUT}'")}),
  cur AS ({_LATEST.format(f"indexed_at >= TIMESTAMP '{CUT}'")}),
  status AS (SELECT coalesce(c.repo_id, s.repo_id) AS repo_id, coalesce(c.path, s.path) AS path, CASE WHEN c.path IS NULL THEN 'unknown' ELSE c.language END AS language,
      coalesce(c.sha256, '') AS sha256, CASE WHEN c.path IS NULL THEN 0 ELSE c.size_bytes END AS size_bytes,
      CASE WHEN c.path IS NULL THEN 'deleted' WHEN s.path IS NULL THEN 'new' WHEN s.sha256 <> c.sha256 THEN 'modified' ELSE 'unchanged' END AS status,
      CASE WHEN c.path IS NULL THEN 0 ELSE c.line_count END AS line_count
    FROM cur c FULL JOIN stored s ON c.repo_id = s.repo_id AND c.path = s.path)"""


@query(f"""SELECT DISTINCT repo_id, path FROM (SELECT repo_id, {_PLAIN} AS path, size_bytes FROM files)
  WHERE len(list_filter(string_split(path, '/')[1:-2], lambda d: d IN ({_in(C.EXCLUDED_DIRS)}) OR starts_with(d, '.'))) = 0
    AND ({_EXT} = '' OR {_EXT} IN ({_in(C.SOURCE_EXTENSIONS)})) AND coalesce(size_bytes, 0) <= {C.MAX_FILE_BYTES}""")
def scan_filter(spark, d):
    f = _files(spark, d)
    return f.where(L.is_listed(F.col("path"), F.col("size_bytes"))).select("repo_id", "path").distinct()


@query(f"""SELECT DISTINCT path, coalesce({_case(_EXT, C.EXTENSION_LANGUAGE)}, {_case("split_part(path, '/', -1)", C.FILENAME_LANGUAGE)}) AS detected FROM (SELECT {_PLAIN} AS path FROM files)""")
def detect_language(spark, d):
    return _files(spark, d).select("path", L.detect_language(F.col("path")).alias("detected")).distinct()


@query("""SELECT DISTINCT repo_id, path, CASE WHEN starts_with(base, 'python') THEN 'python' WHEN starts_with(base, 'node') THEN 'javascript' WHEN starts_with(base, 'ruby') THEN 'ruby'
    WHEN starts_with(base, 'bash') THEN 'shell' WHEN starts_with(base, 'sh') THEN 'shell' WHEN starts_with(base, 'zsh') THEN 'shell' WHEN starts_with(base, 'perl') THEN 'perl' WHEN starts_with(base, 'php') THEN 'php' END AS interpreter
  FROM (SELECT repo_id, path, regexp_extract(trim(split_part(content[1:128], chr(10), 1)), '([^/\\s]*)$', 1) AS base FROM source_files WHERE starts_with(content, '#!'))""")
def shebang_language(spark, d):
    s = table(spark, d, "source_files").where(F.startswith("content", F.lit("#!")))
    return s.select("repo_id", "path", L.shebang_language(F.col("content")).alias("interpreter")).distinct()


@query("SELECT DISTINCT repo_id, path, sha256(content) AS sha256, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes FROM source_files")
def file_sha256(spark, d):
    return table(spark, d, "source_files").select("repo_id", "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes")).distinct()


@query("SELECT DISTINCT repo_id, path, CAST(length(content) - length(replace(content, chr(10), '')) AS INTEGER) AS line_count, strpos(content[1:8192], chr(0)) > 0 AS is_binary FROM source_files")
def line_count(spark, d):
    c = F.col("content")
    return table(spark, d, "source_files").select("repo_id", "path", L.count_lines(c).alias("line_count"), L.is_binary(c).alias("is_binary")).distinct()


@query(f"""WITH {_MANIFEST} SELECT c.repo_id, c.path, c.sha256 FROM cur c LEFT JOIN stored s ON c.repo_id = s.repo_id AND c.path = s.path WHERE s.sha256 IS DISTINCT FROM c.sha256""")
def change_set(spark, d):
    return manifest.change_set(_current(spark, d), _stored(spark, d))


@query(f"WITH {_MANIFEST} SELECT * FROM status")
def file_status(spark, d):
    return _status(spark, d)


@query(f"WITH {_MANIFEST} SELECT repo_id, language, CAST(count(*) AS BIGINT) AS files FROM status WHERE status <> 'deleted' GROUP BY ALL")
def language_breakdown(spark, d):
    return manifest.language_breakdown(_status(spark, d))


@query(f"""WITH {_MANIFEST} SELECT repo_id, CAST(count(*) FILTER (status <> 'deleted') AS BIGINT) AS files, CAST(coalesce(sum(line_count) FILTER (status <> 'deleted'), 0) AS BIGINT) AS lines,
    CAST(count(*) FILTER (status = 'new') AS BIGINT) AS new_files, CAST(count(*) FILTER (status = 'modified') AS BIGINT) AS modified_files,
    CAST(count(*) FILTER (status = 'unchanged') AS BIGINT) AS unchanged_files, CAST(count(*) FILTER (status = 'deleted') AS BIGINT) AS deleted_files FROM status GROUP BY repo_id""")
def manifest_summary(spark, d):
    return manifest.summary(_status(spark, d))


@query(f"""WITH {_MANIFEST} SELECT repo_id, path, language, sha256, size_bytes, CASE WHEN status = 'unchanged' AND coalesce(line_count, 0) = 0 THEN o_lines ELSE line_count END AS line_count
  FROM (SELECT status.*, s.line_count AS o_lines FROM status LEFT JOIN stored s USING (repo_id, path)) WHERE status <> 'deleted'""")
def snapshot_upsert(spark, d):
    return manifest.upsert_snapshot(_stored(spark, d), _status(spark, d))


def _newest_meta(meta: DataFrame) -> DataFrame:
    return manifest.newest_per(meta.dropDuplicates(), ["repo_id"], ["last_indexed_at", "snapshot_id", "git_branch", "git_commit"]).drop("snapshot_id")


_META = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY last_indexed_at DESC NULLS LAST, snapshot_id DESC NULLS LAST, git_branch DESC NULLS LAST, git_commit DESC NULLS LAST) AS rn
    FROM (SELECT DISTINCT * FROM repo_meta) WHERE last_indexed_at {} TIMESTAMP '2025-04-01') WHERE rn = 1"""


@query(f"""WITH o AS ({_META.format('<')}), n AS ({_META.format('>=')})
  SELECT coalesce(n.repo_id, o.repo_id) AS repo_id, CASE WHEN o.repo_id IS NOT NULL THEN o.source ELSE n.source END AS source, CASE WHEN o.repo_id IS NOT NULL THEN o.source_type ELSE n.source_type END AS source_type,
    CASE WHEN n.repo_id IS NOT NULL THEN n.git_branch ELSE o.git_branch END AS git_branch, CASE WHEN n.repo_id IS NOT NULL THEN n.git_commit ELSE o.git_commit END AS git_commit,
    CASE WHEN n.repo_id IS NOT NULL THEN n.last_indexed_at ELSE o.last_indexed_at END AS last_indexed_at FROM n FULL JOIN o ON n.repo_id = o.repo_id""")
def meta_upsert(spark, d):
    meta, cut = table(spark, d, "repo_meta"), F.lit("2025-04-01").cast("timestamp_ntz")
    return manifest.upsert_meta(_newest_meta(meta.where(F.col("last_indexed_at") < cut)), _newest_meta(meta.where(F.col("last_indexed_at") >= cut)))


@query("SELECT repo_id, max(last_indexed_at) AS last_indexed_at FROM repo_meta GROUP BY repo_id")
def last_indexed(spark, d):
    return manifest.last_indexed_at(table(spark, d, "repo_meta"))


@query(r"""SELECT DISTINCT source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '\.git$', ''), '^git@([^:]+):', '\1/'), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[/\\:@]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM repo_meta""")
def url_slug(spark, d):
    return table(spark, d, "repo_meta").select("source", L.url_slug(F.col("source")).alias("slug")).distinct()


# --- nodes

_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC, deleted_at NULLS LAST) AS rn FROM ir_nodes) WHERE rn = 1 AND deleted_at IS NULL)"


def _nodes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return graph.current_nodes(table(spark, d, "ir_nodes"), *more)


@query(f"WITH {_CUR} SELECT id, repo_id, name, kind, file_path, start_line, end_line, language, parent_id, ord FROM cur")
def latest_node_by_id(spark, d):
    return _nodes(spark, d).select("id", "repo_id", "name", "kind", "file_path", "start_line", "end_line", "language", "parent_id", "ord")


@query(f"WITH {_CUR}, n AS (SELECT name, count(*) AS c FROM cur GROUP BY name ORDER BY c DESC, name LIMIT 20) SELECT id, cur.name FROM cur WHERE lower(cur.name) IN (SELECT lower(name) FROM n)")
def find_by_name(spark, d):
    n = _nodes(spark, d)
    wanted = n.groupBy("name").count().orderBy(F.desc("count"), "name").limit(20).select(F.lower("name").alias("wanted")).distinct()
    return n.join(wanted, F.lower("name") == F.col("wanted"), "left_semi").select("id", "name")


@query(f"WITH {_CUR}, n AS (SELECT DISTINCT lower(name) AS wanted FROM cur) SELECT wanted, id, cur.name FROM cur JOIN n ON lower(cur.name) = wanted")
def find_by_every_name(spark, d):
    """Each name there is, looked up in all nodes; `find_by_name` looks up the 20 most frequent only, as its SQL does."""
    n = _nodes(spark, d)
    wanted = stage(n.select(F.lower("name").alias("wanted")).distinct(), "wanted")
    return n.join(wanted, F.lower("name") == F.col("wanted")).select("wanted", "id", "name")


@query(f"WITH {_CUR} SELECT repo_id, parent_id, string_agg(id, ' ' ORDER BY start_line, id) AS kids FROM cur WHERE parent_id IS NOT NULL GROUP BY repo_id, parent_id")
def children_of(spark, d):
    n = _nodes(spark, d).where("parent_id is not null")
    kids = F.array_sort(F.collect_list(F.struct("start_line", "id")))
    return n.groupBy("repo_id", "parent_id").agg(F.array_join(F.transform(kids, lambda x: x["id"]), " ").alias("kids"))


@query(f"""WITH {_CUR} SELECT p.repo_id, p.id, string_agg(c.id, ' ' ORDER BY c.ord, c.id) AS kids FROM cur p JOIN cur c ON c.parent_id = p.id AND c.file_path = p.file_path AND c.repo_id = p.repo_id GROUP BY p.repo_id, p.id""")
def linked_children(spark, d):
    return resolve.link_children(_nodes(spark, d)).select("repo_id", "id", F.array_join("children", " ").alias("kids"))


@query(f"""WITH {_CUR} SELECT CASE WHEN kind IN ({_in(C.FUNCTION_KINDS)}) THEN 'functions' WHEN kind IN ({_in(C.CLASS_KINDS)}) THEN 'classes' WHEN kind IN ({_in(C.IMPORT_KINDS)}) THEN 'imports' ELSE 'other' END AS grp, CAST(count(*) AS BIGINT) AS n FROM cur GROUP BY ALL""")
def kind_groups(spark, d):
    k = F.col("kind")
    grp = F.when(k.isin(*C.FUNCTION_KINDS), "functions").when(k.isin(*C.CLASS_KINDS), "classes").when(k.isin(*C.IMPORT_KINDS), "imports").otherwise("other")
    return _nodes(spark, d).groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))


@query(f"WITH {_CUR} SELECT repo_id, kind, language, CAST(count(*) AS BIGINT) AS n FROM cur GROUP BY ALL")
def ir_stats_by_kind(spark, d):
    return _nodes(spark, d).groupBy("repo_id", "kind", "language").agg(F.count("*").alias("n"))


@query(f"""WITH {_CUR} SELECT 'nodes' AS what, CAST(count(*) AS BIGINT) AS n FROM cur UNION ALL SELECT 'call_edges', count(DISTINCT id) FROM ir_call_edges
  UNION ALL SELECT 'inheritance_edges', count(DISTINCT id) FROM ir_inheritance_edges UNION ALL SELECT 'reference_edges', count(DISTINCT id) FROM ir_reference_edges
  UNION ALL SELECT 'parsed_files', count(DISTINCT (repo_id, file_path)) FROM parse_results UNION ALL SELECT 'failed_files', count(DISTINCT (repo_id, file_path)) FROM parse_results WHERE NOT success""")
def report_totals(spark, d):
    rows = [_nodes(spark, d).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n")]
    for what, t in (("call_edges", "ir_call_edges"), ("inheritance_edges", "ir_inheritance_edges"), ("reference_edges", "ir_reference_edges")):
        rows.append(table(spark, d, t).select("id").distinct().agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n"))
    p = table(spark, d, "parse_results")
    for what, q in (("parsed_files", p), ("failed_files", p.where("not success"))):
        rows.append(q.select("repo_id", "file_path").distinct().agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query("SELECT DISTINCT repo_id, file_path FROM parse_results WHERE NOT success")
def failed_files(spark, d):
    return table(spark, d, "parse_results").where("not success").select("repo_id", "file_path").distinct()


@query(f"""WITH {_CUR}, n AS (SELECT repo_id, file_path, count(*) AS nodes FROM cur GROUP BY ALL), c AS (SELECT repo_id, file_path, count(DISTINCT id) AS calls FROM ir_call_edges GROUP BY ALL)
  SELECT n.repo_id, n.file_path, CAST(nodes AS BIGINT) AS nodes, CAST(coalesce(calls, 0) AS BIGINT) AS calls FROM n LEFT JOIN c ON n.repo_id = c.repo_id AND n.file_path = c.file_path""")
def per_file_counts(spark, d):
    n = _nodes(spark, d).groupBy("repo_id", "file_path").agg(F.count("*").alias("nodes"))
    c = table(spark, d, "ir_call_edges").select("repo_id", "file_path", "id").distinct().groupBy("repo_id", "file_path").agg(F.count("*").alias("calls"))
    return n.join(c, ["repo_id", "file_path"], "left").select("repo_id", "file_path", "nodes", F.coalesce("calls", F.lit(0).cast("long")).alias("calls"))


@query(f"WITH {_CUR} SELECT id, substr(concat_ws(':', repo_id, file_path, name, CAST(start_line AS VARCHAR)), 1, 128) AS made, {_case('kind', C.KIND_COLOURS).replace(' END', f" ELSE '{C.OTHER_COLOUR}' END")} AS colour FROM cur")
def node_ids(spark, d):
    return _nodes(spark, d).select("id", L.node_id(F.col("repo_id"), F.col("file_path"), F.col("name"), F.col("start_line")).alias("made"), L.kind_colour(F.col("kind")).alias("colour"))


_PY_TARGET = r"""nullif(split_part(CASE WHEN regexp_extract({0}, '^from\s+(\.*\S+)\s+import', 1) <> '' THEN regexp_replace(regexp_extract({0}, '^from\s+(\.*\S+)\s+import', 1), '^\.+', '') ELSE regexp_extract({0}, '^import\s+(\S+)', 1) END, '.', 1), '')"""
_ES_RAW = r"""regexp_extract({0}, 'from\s+[''"]([^''"]+)[''"]', 1)"""
_ES_TARGET = "nullif(CASE WHEN " + _ES_RAW + " LIKE '.%' OR " + _ES_RAW + " LIKE '/%' THEN regexp_replace(" + _ES_RAW + r", '\.\w+$', '') ELSE lower(split_part(" + _ES_RAW + ", '/', 1)) END, '')"
_GO_TARGET = r"""nullif(split_part(regexp_extract({0}, '["`]([^"`]+)["`]', 1), '/', -1), '')"""
_TARGET = f"CASE language WHEN 'python' THEN {_PY_TARGET} WHEN 'javascript' THEN {_ES_TARGET} WHEN 'typescript' THEN {_ES_TARGET} WHEN 'go' THEN {_GO_TARGET} END".format("name")
_TARGET = f"coalesce({_TARGET}, imports[1])"
_STEM = "split_part(split_part(replace({}, '\\', '/'), '/', -1), '.', 1)"
_IMPORTS = f"imp AS (SELECT DISTINCT * FROM (SELECT repo_id, file_path AS source_file, {_TARGET} AS target_module FROM cur WHERE kind = 'import') WHERE target_module IS NOT NULL)"


@query(f"WITH {_CUR}, {_IMPORTS} SELECT repo_id, source_file, target_module, {_STEM.format('target_module')} AS stem FROM imp")
def import_targets(spark, d):
    return resolve.import_rows(_nodes(spark, d, "imports")).withColumn("stem", L.stem(F.col("target_module")))


@query(f"""SELECT language, callee_name, split_part(callee_name, '.', -1) AS leaf, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT e.id, e.callee_name, {_case("split_part(e.file_path, '.', -1)", {k[1:]: v for k, v in C.EXTENSION_LANGUAGE.items()})} AS language FROM ir_call_edges e)
  WHERE NOT CASE WHEN language = 'python' THEN lower(split_part(callee_name, '.', -1)) IN ({_in(C.PYTHON_NOISE)}) WHEN language IN ('javascript', 'typescript') THEN split_part(callee_name, '.', -1) IN ({_in(C.JAVASCRIPT_NOISE)}) OR callee_name = 'require'
    WHEN language = 'go' THEN lower(split_part(callee_name, '.', -1)) IN ({_in(C.GO_NOISE)}) ELSE FALSE END GROUP BY ALL""")
def kept_callees(spark, d):
    e = table(spark, d, "ir_call_edges").select("id", "callee_name", L.detect_language(F.col("file_path")).alias("language")).distinct()
    return e.where(~L.is_noise(F.col("language"), F.col("callee_name"))).groupBy("language", "callee_name", L.leaf(F.col("callee_name")).alias("leaf")).agg(F.count("*").alias("n"))


# --- edges

_TYPED = """typed AS (SELECT DISTINCT e.repo_id, e.caller_id AS src, e.callee_id AS dst FROM ir_call_edges e JOIN cur a ON a.id = e.caller_id AND a.repo_id = e.repo_id JOIN cur b ON b.id = e.callee_id AND b.repo_id = e.repo_id)"""
_WANTED = """wanted AS (SELECT DISTINCT e.repo_id, e.caller_id AS src, e.callee_name AS name FROM ir_call_edges e JOIN cur a ON a.id = e.caller_id AND a.repo_id = e.repo_id LEFT JOIN cur b ON b.id = e.callee_id AND b.repo_id = e.repo_id WHERE b.id IS NULL)"""
_RESOLVED = """(SELECT DISTINCT w.repo_id, w.src, n.id AS dst FROM {0} w JOIN cur n ON n.repo_id = w.repo_id AND n.name = w.name
    UNION SELECT w.repo_id, w.src, n.id FROM {0} w JOIN cur n ON n.repo_id = w.repo_id AND n.name = split_part(w.name, '.', -1) WHERE (w.repo_id, w.name) NOT IN (SELECT (repo_id, name) FROM cur))"""
_NAMED = f"named AS {_RESOLVED.format('wanted')}"
_LISTED = f"lists AS (SELECT DISTINCT repo_id, id AS src, unnest(calls) AS name FROM cur), listed AS {_RESOLVED.format('lists')}"
_CALLS = f"{_TYPED}, {_WANTED}, {_NAMED}, {_LISTED}, calls_e AS (SELECT * FROM typed UNION SELECT * FROM named UNION SELECT * FROM listed)"
_IMPORT_E = f"""{_IMPORTS}, paths AS (SELECT DISTINCT repo_id, file_path FROM cur),
  hits AS (SELECT DISTINCT i.repo_id, i.source_file, i.target_module, p.file_path FROM imp i JOIN paths p ON i.repo_id = p.repo_id AND (p.file_path = i.target_module OR ends_with(p.file_path, '/' || i.target_module) OR {_STEM.format('p.file_path')} = {_STEM.format('i.target_module')})),
  rest AS (SELECT * FROM imp WHERE (repo_id, target_module) NOT IN (SELECT (repo_id, target_module) FROM hits)),
  fulls AS (SELECT r.*, n.id AS dst FROM rest r JOIN cur n ON n.repo_id = r.repo_id AND n.name = r.target_module),
  stems AS (SELECT r.*, n.id AS dst FROM rest r JOIN cur n ON n.repo_id = r.repo_id AND n.name = {_STEM.format('r.target_module')} WHERE (r.repo_id, r.target_module) NOT IN (SELECT (repo_id, target_module) FROM fulls)),
  goals AS (SELECT h.repo_id, h.source_file, n.id AS dst FROM hits h JOIN cur n ON n.repo_id = h.repo_id AND n.file_path = h.file_path UNION SELECT repo_id, source_file, dst FROM fulls UNION SELECT repo_id, source_file, dst FROM stems),
  imports_e AS (SELECT DISTINCT g.repo_id, s.id AS src, g.dst FROM goals g JOIN cur s ON s.repo_id = g.repo_id AND s.file_path = g.source_file WHERE s.id <> g.dst)"""
_INHERIT_E = """lastn AS (SELECT repo_id, name, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY file_path DESC, start_line DESC, id DESC) AS k FROM cur) WHERE k = 1),
  inherits_e AS (SELECT DISTINCT e.repo_id, e.child_id AS src, coalesce(p.id, l.id) AS dst FROM ir_inheritance_edges e JOIN cur c ON c.id = e.child_id AND c.repo_id = e.repo_id
    LEFT JOIN cur p ON p.id = e.parent_id AND p.repo_id = e.repo_id LEFT JOIN lastn l ON l.repo_id = e.repo_id AND l.name = e.parent_name WHERE coalesce(p.id, l.id) IS NOT NULL)"""
_DEFINE_E = "defines_e AS (SELECT DISTINCT c.repo_id, c.parent_id AS src, c.id AS dst FROM cur c JOIN cur p ON p.id = c.parent_id AND p.repo_id = c.repo_id)"
_EDGES = f"""{_CUR}, {_CALLS}, {_IMPORT_E}, {_INHERIT_E}, {_DEFINE_E},
  every AS (SELECT *, 'calls' AS type, 1 AS r FROM calls_e UNION ALL SELECT *, 'imports', 2 FROM imports_e UNION ALL SELECT *, 'inherits', 3 FROM inherits_e UNION ALL SELECT *, 'defines', 4 FROM defines_e),
  merged AS (SELECT repo_id, src, dst, arg_max(type, r) AS type FROM every GROUP BY repo_id, src, dst)"""
_REACH = """entry AS (SELECT repo_id, id FROM cur WHERE coalesce(is_exported, TRUE) OR kind = 'module' OR name = 'main' OR (kind = 'function' AND regexp_matches(name, '^[A-Z]'))),
  reach AS (SELECT repo_id, id FROM entry UNION SELECT m.repo_id, m.dst FROM reach JOIN {} m ON m.repo_id = reach.repo_id AND m.src = reach.id)"""


def _staged_nodes(spark: SparkSession, d: str) -> DataFrame:
    return stage(_nodes(spark, d, "calls", "imports"), "nodes")


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _staged_nodes(spark, d)
    edges = graph.merge_edges(graph.all_edges(n, table(spark, d, "ir_call_edges"), table(spark, d, "ir_inheritance_edges")))
    return n, stage(edges, "merged")


def _hops(spark: SparkSession, d: str, nodes: DataFrame) -> DataFrame:
    return graph.hop_edges(nodes, table(spark, d, "ir_call_edges"), table(spark, d, "ir_inheritance_edges"))


@query(f"WITH {_CUR}, {_TYPED} SELECT * FROM typed")
def call_edges_typed(spark, d):
    return resolve.typed_calls(table(spark, d, "ir_call_edges"), _nodes(spark, d))


@query(f"WITH {_CUR}, {_WANTED}, {_NAMED} SELECT * FROM named")
def call_edges_fallback(spark, d):
    return resolve.named_calls(table(spark, d, "ir_call_edges"), _staged_nodes(spark, d))


@query(f"WITH {_CUR}, {_LISTED} SELECT * FROM listed")
def call_edges_listed(spark, d):
    return resolve.listed_calls(_staged_nodes(spark, d))


@query(f"WITH {_CUR}, {_IMPORT_E} SELECT * FROM imports_e")
def import_edges(spark, d):
    n = _staged_nodes(spark, d)
    return resolve.import_edges(resolve.import_rows(n), n)


@query(f"WITH {_CUR}, {_INHERIT_E} SELECT * FROM inherits_e")
def inheritance_edges(spark, d):
    return resolve.inheritance_edges(table(spark, d, "ir_inheritance_edges"), _nodes(spark, d))


@query(f"WITH {_CUR}, {_DEFINE_E} SELECT * FROM defines_e")
def defines_edges(spark, d):
    return resolve.defines_edges(_nodes(spark, d))


@query(f"WITH {_EDGES} SELECT * FROM merged")
def merged_edges(spark, d):
    return _merged(spark, d)[1]


@query(f"WITH {_EDGES} SELECT repo_id, type, CAST(count(*) AS BIGINT) AS n FROM merged GROUP BY ALL")
def edges_by_kind(spark, d):
    return _merged(spark, d)[1].groupBy("repo_id", "type").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_CUR}, {_REACH.split(',' + chr(10))[0]} SELECT * FROM entry")
def entry_points(spark, d):
    return graph.entry_points(_nodes(spark, d)).select("repo_id", "id")


@query(f"WITH RECURSIVE {_EDGES}, {_REACH.format('merged')} SELECT * FROM reach")
def reachable_nodes(spark, d):
    n = _staged_nodes(spark, d)
    return graph.reachable(graph.entry_points(n), _hops(spark, d, n))


@query(f"WITH RECURSIVE {_EDGES}, {_REACH.format('merged')} SELECT repo_id, id, name, kind FROM cur WHERE kind IN ('function', 'method') AND (repo_id, id) NOT IN (SELECT (repo_id, id) FROM reach)")
def dead_functions(spark, d):
    n = _staged_nodes(spark, d)
    return graph.dead_functions(n, _hops(spark, d, n)).select("repo_id", "id", "name", "kind")


@query(f"WITH RECURSIVE {_CUR}, {_CALLS}, {_REACH.format('calls_e')} SELECT repo_id, id, name, kind FROM cur WHERE kind IN ('function', 'method') AND (repo_id, id) NOT IN (SELECT (repo_id, id) FROM reach)")
def dead_functions_by_calls(spark, d):
    """By all calls, also where an import leads from and to the same nodes, which the merged edges show instead."""
    n = _staged_nodes(spark, d)
    return graph.dead_functions(n, graph.hop_edges(n, table(spark, d, "ir_call_edges"))).select("repo_id", "id", "name", "kind")


@query(f"WITH {_EDGES} SELECT repo_id, id FROM cur WHERE (repo_id, id) NOT IN (SELECT (repo_id, src) FROM merged) AND (repo_id, id) NOT IN (SELECT (repo_id, dst) FROM merged)")
def orphans(spark, d):
    return graph.orphans(*_merged(spark, d)).select("repo_id", "id")


@query(f"WITH {_CUR}, {_CALLS} SELECT m.repo_id, m.dst AS id, cur.name, CAST(count(*) AS BIGINT) AS callers FROM calls_e m JOIN cur ON cur.repo_id = m.repo_id AND cur.id = m.dst GROUP BY ALL ORDER BY callers DESC, m.dst LIMIT 20")
def most_called(spark, d):
    n = _staged_nodes(spark, d)
    return graph.most_called(resolve.call_edges(table(spark, d, "ir_call_edges"), n).withColumn("type", F.lit("calls")), n, 20)


@query(f"WITH {_EDGES} SELECT m.repo_id, m.src AS id, cur.name, CAST(count(*) AS BIGINT) AS out_degree FROM merged m JOIN cur ON cur.repo_id = m.repo_id AND cur.id = m.src GROUP BY ALL")
def most_complex(spark, d):
    n, e = _merged(spark, d)
    return graph.most_complex(e, n)


@query(f"""WITH {_EDGES}, n AS (SELECT repo_id, count(*) AS nodes FROM cur GROUP BY ALL), e AS (SELECT repo_id, count(*) AS edges FROM merged GROUP BY ALL),
  o AS (SELECT repo_id, count(*) AS orphans FROM cur WHERE (repo_id, id) NOT IN (SELECT (repo_id, src) FROM merged) AND (repo_id, id) NOT IN (SELECT (repo_id, dst) FROM merged) GROUP BY ALL)
  SELECT n.repo_id, CAST(nodes AS BIGINT) AS nodes, CAST(coalesce(edges, 0) AS BIGINT) AS edges, CAST(coalesce(orphans, 0) AS BIGINT) AS orphans FROM n LEFT JOIN e USING (repo_id) LEFT JOIN o USING (repo_id)""")
def graph_stats(spark, d):
    return graph.graph_stats(*_merged(spark, d))

