"""Names and paths of edges resolved to nodes.

Everything is resolved within a repository: nodes and edges carry `repo_id`. A name may belong to many nodes; then the
edge leads to all of them, as the semantics want, after names and edges were made distinct. Joins go by equality only;
hot names meet a small side that AQE broadcasts when its size allows, and are split as skewed partitions otherwise.
Null ids and names resolve to nothing; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import lexical as L
from codeweft.session import is_blank, stage


def _meant(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, name, target: the full name first; its last part only where no node has the full name. The decision is made
    per distinct (repo, name)."""
    names = wanted.select("repo_id", "name").distinct()
    have = nodes.select("repo_id", F.col("name").alias("known")).where(F.col("known").isNotNull()).distinct()
    full = names.join(have, (names.repo_id == have.repo_id) & (names.name == have.known), "left").select(names.repo_id, "name", F.coalesce("known", L.leaf(F.col("name"))).alias("target"))
    # Staged, so that both sides of the next join are plain exchanges and a hot name can be split.
    return stage(full, "names")


def _by_name(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, src, dst. `wanted`: repo_id, src, name; the edges meet the resolved names in one join."""
    full = _meant(wanted, nodes)
    ids = nodes.select("repo_id", F.col("name").alias("target"), F.col("id").alias("dst"))
    return wanted.join(full, ["repo_id", "name"]).join(ids, ["repo_id", "target"]).select("repo_id", "src", "dst")


def typed_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges whose callee_id is a node."""
    e = edges.select("repo_id", F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).where(~is_blank(F.col("dst"))).distinct()
    ids = nodes.select("repo_id", "id")
    e = e.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi")
    return e.join(ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst")


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, src, name of the call edges without a callee_id among the nodes."""
    ids = nodes.select("repo_id", "id")
    e = edges.select("repo_id", F.col("caller_id").alias("src"), "callee_id", F.col("callee_name").alias("name")).where(F.col("name").isNotNull()).distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi")
    return e.join(ids.withColumnRenamed("id", "callee_id"), ["repo_id", "callee_id"], "left_anti").select("repo_id", "src", "name")


def _listed(nodes: DataFrame) -> DataFrame:
    """repo_id, src, name of the nodes' own `calls` lists."""
    return nodes.select("repo_id", F.col("id").alias("src"), F.explode("calls").alias("name")).where(F.col("name").isNotNull())


def named_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges without a callee_id among the nodes, resolved by name."""
    return _by_name(_named(edges, nodes).distinct(), nodes).distinct()


def listed_calls(nodes: DataFrame) -> DataFrame:
    """What the nodes' own `calls` lists resolve to."""
    return _by_name(_listed(nodes).distinct(), nodes).distinct()


def call_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All three: names of both kinds are resolved together, each (source, name) once."""
    wanted = _named(edges, nodes).union(_listed(nodes)).distinct()
    return typed_calls(edges, nodes).union(_by_name(wanted, nodes)).distinct()


def vertex(kind: str, c: Column) -> Column:
    """The id of a vertex that stands for a name or file; no node has such an id."""
    return F.concat(F.lit(f"\0{kind} "), c)


def call_hops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, src, dst: the call edges with a vertex for each name between callers and called, so that a common name
    costs its uses plus its nodes, not their product. The same nodes can be reached."""
    wanted = _named(edges, nodes).union(_listed(nodes)).distinct()
    full = _meant(wanted, nodes)
    uses = wanted.join(full, ["repo_id", "name"]).select("repo_id", "src", vertex("name", F.col("target")).alias("dst"))
    known = nodes.select("repo_id", F.col("name").alias("target"), "id").join(full.select("repo_id", "target").distinct(), ["repo_id", "target"], "left_semi")
    return typed_calls(edges, nodes).union(uses).union(known.select("repo_id", vertex("name", F.col("target")), "id"))


def import_rows(nodes: DataFrame) -> DataFrame:
    """repo_id, source_file, target_module of the import nodes: by the statement that names them, or where its language
    has no rule for that, the first of their `imports`."""
    target = F.coalesce(L.import_target(F.col("language"), F.col("name")), F.get("imports", F.lit(0)))
    return (
        nodes.where(F.col("kind") == "import")
        .select("repo_id", F.col("file_path").alias("source_file"), target.alias("target_module"))
        .where(F.col("target_module").isNotNull())
        .distinct()
    )


def import_files(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, source_file, target_module, file_path of the files each import means: the path itself, a path that ends
    in it, or one with its stem. Three equalities over distinct paths stand for the disjunction."""
    paths = nodes.select("repo_id", "file_path").where(F.col("file_path").isNotNull()).distinct()
    mods = imports.select("repo_id", "target_module").distinct()
    exact = mods.join(paths, (mods.repo_id == paths.repo_id) & (mods.target_module == paths.file_path)).select(mods.repo_id, "target_module", "file_path")
    parts = F.split("file_path", "/")
    tails = paths.select("repo_id", "file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "/"))).alias("tail")).where("tail != ''")
    ends = mods.join(tails, (mods.repo_id == tails.repo_id) & (mods.target_module == tails["tail"])).select(mods.repo_id, "target_module", "file_path")
    stems = paths.select("repo_id", "file_path", L.stem(F.col("file_path")).alias("stem"))
    m = mods.withColumn("stem", L.stem(F.col("target_module")))
    alike = m.join(stems, ["repo_id", "stem"]).select("repo_id", "target_module", "file_path")
    return imports.join(exact.union(ends).union(alike).distinct(), ["repo_id", "target_module"])


def import_goals(imports: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, source_file, file_path), (repo_id, source_file, dst): the files that each file imports, and where no file
    is meant, the nodes named so (by the full target, else by its stem)."""
    # Each is used several times below and small beside the nodes.
    imports = stage(imports, "imports")
    files = stage(import_files(imports, nodes), "import-files")
    rest = imports.join(files.select("repo_id", "target_module").distinct(), ["repo_id", "target_module"], "left_anti")
    named = nodes.select("repo_id", F.col("name").alias("wanted"), F.col("id").alias("dst"))
    full = stage(rest.join(named, (rest.repo_id == named.repo_id) & (rest.target_module == named.wanted)).select(rest.repo_id, "source_file", "target_module", "dst"), "named-imports")
    left = rest.join(full.select("repo_id", "target_module").distinct(), ["repo_id", "target_module"], "left_anti").withColumn("wanted", L.stem(F.col("target_module")))
    stem = left.join(named, ["repo_id", "wanted"]).select("repo_id", "source_file", "target_module", "dst")
    return files.select("repo_id", "source_file", "file_path").distinct(), full.select("repo_id", "source_file", "dst").union(stem.select("repo_id", "source_file", "dst")).distinct()


def import_hops(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, src, dst: the import edges with vertices for files that import and are imported: as many rows as nodes,
    pairs of files and named nodes, where `import_edges` has the product of two files' nodes for each pair."""
    by_file, by_name = import_goals(imports, nodes)
    own = nodes.select("repo_id", "file_path", "id")
    importing = by_file.select("repo_id", F.col("source_file").alias("file_path")).union(by_name.select("repo_id", "source_file")).distinct()
    out = own.join(importing, ["repo_id", "file_path"], "left_semi").select("repo_id", F.col("id").alias("src"), vertex("from", F.col("file_path")).alias("dst"))
    across = by_file.select("repo_id", vertex("from", F.col("source_file")), vertex("to", F.col("file_path")))
    into = own.join(by_file.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi").select("repo_id", vertex("to", F.col("file_path")), "id")
    return out.union(across).union(into).union(by_name.select("repo_id", vertex("from", F.col("source_file")), "dst"))


def import_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, src, dst: every node of the importing file to every node of the files meant, or to the nodes named so; no
    node to itself. That is a product by definition; what only has to be walked goes by `import_hops`."""
    files, named = import_goals(imports, nodes)
    ids = nodes.select("repo_id", "file_path", F.col("id").alias("dst"))
    targets = files.join(ids, ["repo_id", "file_path"]).select("repo_id", "source_file", "dst").union(named).distinct()
    src = nodes.select("repo_id", F.col("file_path").alias("source_file"), F.col("id").alias("src"))
    return targets.join(src, ["repo_id", "source_file"]).where("src != dst").select("repo_id", "src", "dst").distinct()


def inheritance_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo_id, src (child), dst (parent): by id if it is a node, else the node of that exact name; of several the last
    by (file_path, start_line, id)."""
    ids = nodes.select("repo_id", "id")
    last = nodes.groupBy("repo_id", F.col("name").alias("parent_name")).agg(F.max_by("id", F.struct("file_path", "start_line", "id")).alias("by_name"))
    e = edges.select("repo_id", F.col("child_id").alias("src"), "parent_id", "parent_name").distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi")
    e = e.join(ids.select("repo_id", F.col("id").alias("parent_id"), F.lit(True).alias("there")), ["repo_id", "parent_id"], "left")
    e = e.join(last, ["repo_id", "parent_name"], "left")
    return e.select("repo_id", "src", F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("by_name")).alias("dst")).where(F.col("dst").isNotNull()).distinct()


def defines_edges(nodes: DataFrame) -> DataFrame:
    """repo_id, src (parent), dst (child) for every parent that is a node."""
    ids = nodes.select("repo_id", F.col("id").alias("parent_id"))
    return nodes.select("repo_id", "parent_id", "id").join(ids, ["repo_id", "parent_id"], "left_semi").select("repo_id", F.col("parent_id").alias("src"), F.col("id").alias("dst")).distinct()


def link_children(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """id, children: the ids of a node's children in its own file, in the order they were emitted. A node's children
    come from one file, which bounds the list."""
    kids = nodes.select("repo_id", F.col("parent_id").alias("id"), "file_path", F.struct(order, F.col("id").alias("child")).alias("c")).where(F.col("id").isNotNull())
    own = nodes.select("repo_id", "id", "file_path")
    return kids.join(own, ["repo_id", "id", "file_path"]).groupBy("repo_id", "id").agg(F.array_sort(F.collect_set("c")).alias("cs")).select("repo_id", "id", F.transform("cs", lambda x: x["child"]).alias("children"))


def legacy_edges(nodes: DataFrame) -> DataFrame:
    """repo_id, src, dst, type by the nodes' own lists alone, an older way of reading them: calls as in `listed_calls`,
    imports to the node of exactly the imported name, and the class of that name to its members. Of nodes with one name
    the last by (file_path, start_line, id) is meant."""
    last = nodes.groupBy("repo_id", F.col("name").alias("wanted")).agg(F.max_by("id", F.struct("file_path", "start_line", "id")).alias("found"))
    imports = nodes.select("repo_id", F.col("id").alias("src"), F.explode("imports").alias("wanted")).join(last, ["repo_id", "wanted"]).select("repo_id", "src", F.col("found").alias("dst"))
    members = nodes.select("repo_id", F.col("id").alias("dst"), F.col("parent_class").alias("wanted")).join(last, ["repo_id", "wanted"]).select("repo_id", F.col("found").alias("src"), "dst")
    parts = (("calls", listed_calls(nodes)), ("imports", imports), ("defines", members))
    out = None
    for t, df in parts:
        df = df.distinct().withColumn("type", F.lit(t))
        out = df if out is None else out.unionByName(df)
    return out
