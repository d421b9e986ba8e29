"""Files that nobody of the project wrote by hand: generated, minified, data saved as code, and third-party copies.

Third-party copies show first by Merkle hashes: their directory tree or the file itself has the same hash in an unrelated
repository (one that shares neither source nor any commit with it, directly or through others). Copies that no other
repository holds in the same state can only show by the directory they lie in, kept for such copies, or by a header that
names another owner; `why` tells these signals apart. Generated files show by header, by the marks generators put into
names, or by routines counted through; minified ones and data show by layout. Prose about generating, vendoring or
minifying is no evidence, nor is a word that only begins like a mark, nor an ordinary word like `pack` after an underscore.

Null texts are left out; an empty text is hand-written. Paths are compared in plain spelling. Of several texts of one
path any evidence counts. Rows of `files` with null path or hash don't enter the hashes. A null size is taken from other
rows of the hash, else from a text of the file; a file whose size nothing tells counts as shared whatever its size. Empty
tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.session import plain_hash, plain_path, ship, stage

#: A single file shared between repositories counts from this size on; smaller ones may be alike by chance.
SHARED_BYTES = 200
#: Mean characters a line from which code is minified, and its longest line at least.
MINIFIED_MEAN, MINIFIED_LINE = 160, 400
#: Share of a text's characters, without blanks and punctuation, that literals take in data saved as code, and their
#: least number.
DATA_SHARE, DATA_LITERALS = 0.75, 24

# Directories kept for third-party copies, and for what tools write.
THIRD_PARTY_DIRS = frozenset("vendor _vendor third_party third-party thirdparty node_modules bower_components jspm_packages external externals extern deps godeps upstream site-packages pods carthage".split())
GENERATED_DIRS = frozenset("gen autogen generated auto-generated auto_generated __generated__ generated-sources generated_sources".split())
_GENERATED_NAME = re.compile(r"(?:[._-](?:gen|generated|autogen|autogenerated|pb|pb2|pb2_grpc|designer|g)|[a-z0-9](?:Autogen|Generated)|\.d\.gen|_pb2|zz_generated\..*)$")
_MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|pack|packed|compiled|chunk)$|_(?:min|bundle)$")

# What headers of generated files say.
_GENERATED_HEADER = re.compile(
    r"""(?ix) \bcode\ generated\ (?:by|from)\b | @generated\b | <\s*auto-?generated | \bauto(?:matically)?[- ]?generated\ (?:by|from|using|with|code|file)\b
    | \bthis\ (?:file|code|module|source)\ (?:was|is|has\ been)\ (?:auto\w*[- ]?|automatically\ )?(?:generated|produced|created|written|emitted)\ (?:by|from|with|using)\ (?!hand)
    | \bgenerated\ (?:by|from|with|using)\ (?!hand)[^.;]*[.;,]?\s*(?:please\ )?(?:do\ not|don't|never)\ (?:edit|modify|change)
    | \b(?:changes|edits|modifications)\ (?:made\ here\ |to\ this\ file\ )?(?:will\ be|are|get)\ (?:overwritten|lost)\b (?!\ on\ the\ next\ sync)
    | \boutput\ of\ `[^`]+` | ^\W*[A-Z][A-Z\ ]*\bOUTPUT\ FILE\b | \bmachine[- ](?:written|generated|made)\b | \brun\ the\ (?:compiler|generator)\ again\b
    | \bdo\ not\ (?:edit|modify)(?:\ this\ file|\ by\ hand|\ manually|\s*[.!;]|\s*$)
    | \bautomatisch\ (?:erzeugt|generiert|erstellt)\b | \bnicht\ von\ hand\ (?:bearbeiten|ändern)\b | \bgénéré\ automatiquement\b | \bne\ pas\ (?:modifier|éditer)\ (?:ce|à\ la\ main)
    | \bgenerado\ autom[aá]ticamente\b | \bno\ editar\ (?:este|a\ mano) | \bсгенерирован\w*\ автоматически\b | 自動生成 | 自动生成""",
    re.MULTILINE,
)
# What headers of third-party copies say.
_THIRD_PARTY_HEADER = re.compile(
    r"""(?ix) @licen[sc]e\s+[\w.-]+\s+v?\d | ^\W*[\w.-]+\ v?\d+(?:\.\d+)+\s+[-–—|]+\s+(?:\(c\)|MIT|BSD|ISC|Apache|GPL|MPL|LGPL|licen[sc]ed)
    | \bcopyright\b[^\n]*\bthe\ [\w.-]+\ (?:authors|contributors|developers|project)\b | ^\W*\(c\)\ [\w.-]+\ (?:authors|contributors)\b
    | \bvendored\ (?:copy|from|version|in)\b | \bimported\ from\ upstream\b | \b(?:copied|taken|forked)\ (?:verbatim\ )?from\ (?:upstream|https?://|[\w.-]+\ v?\d+\.\d)
    | \bsee\ licen[sc]e\.\w+ | \bdistributed\ under\ the\ (?:terms\ of\ the\ )?(?:BSD|MIT|ISC|Apache|GPL|GNU|Mozilla)\b | \blocal\ changes\ are\ lost\ on\ the\ next\ sync\b
    | \A\s*(?:/\*!|\#|//!?)\s*[\w.-]+\ v?\d+(?:\.\d+)+\s*(?:\*/)?\s*$""",
    re.MULTILINE,
)
#: Routines with numbers of the same width for names, counted up without a gap: so many are never written by hand.
NUMBERED_ROUTINES = 16
_NUMBERED = re.compile(r"\b(?:def|func|function|const|let|var|void|[\w>\]]+)\s+[A-Za-z_]+?_?(\d{2,})\s*(?:=\s*(?:async\s*)?)?\(|^\s+[A-Za-z_]+?_?(\d{2,})\([^)]*\)[^;\n]*\{", re.MULTILINE)
#: What names a bundle's source map, which may itself stand behind it: in the last line, or as a comment up to a line's end.
_MAP = "sourceMappingURL="
_MAP_COMMENT = re.compile(rf"(?://|/\*)[#@]\s*{_MAP}[^\s'\"`]+\s*(?:\*/)?[^\S\n]*$", re.MULTILINE)
_COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|<!--|\"\"\"|''')")
_LITERAL = re.compile(r"""0x[0-9a-fA-F]+|(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""")
_ROUTINE = re.compile(r"(?m)^\s*(?:def\s|async\s|func\s|function\b|class\s+\w+[^\n]*:\s*$)|=>|\breturn\b|\bfunction\s*\(|\blambda\b")


_LINE = re.compile(r"[^\n]+")


def _header(text: str) -> str:
    """The comment lines before the first line of code."""
    out = []
    inside = ""
    for m in _LINE.finditer(text):
        s = m[0].strip()
        if inside:
            out.append(s)
            if inside in s:
                inside = ""
        elif not s:
            continue
        elif _COMMENT.match(s):
            out.append(s)
            for begin, end in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->")):
                if s.startswith(begin) and end not in s[len(begin) :]:
                    inside = end
        else:
            break
    return "\n".join(out)


def evidence(path: str, text: str) -> str | None:
    """Why a file isn't hand-written, by its name and text alone; None when nothing says so."""
    *dirs, name = path.split("/")
    stem = name.rpartition(".")[0]
    low = {d.lower() for d in dirs}
    if low & THIRD_PARTY_DIRS:
        return "third-party directory"
    head = _header(text)
    if head:
        if _GENERATED_HEADER.search(head):
            return "generated, by header"
        if _THIRD_PARTY_HEADER.search(head):
            return "third party, by header"
    if low & GENERATED_DIRS or _GENERATED_NAME.search(stem):
        return "generated, by name"
    if not text.strip():
        return None
    lines = [x for x in text.split("\n") if x.strip()]
    longest = max(map(len, lines))
    if len(text) > 400 and (literals := _LITERAL.findall(text)) and len(literals) >= DATA_LITERALS:
        visible = len(re.sub(r"[\s,;:\[\](){}]+", "", text))
        if sum(map(len, literals)) >= DATA_SHARE * visible and not _ROUTINE.search(_LITERAL.sub("0", text)):
            return "data"
    if len(text) >= MINIFIED_MEAN * len(lines) and longest >= MINIFIED_LINE:
        return "minified"
    numbers = [a or b for a, b in _NUMBERED.findall(text)]
    for width in {len(n) for n in numbers}:
        seen = {int(n) for n in numbers if len(n) == width}
        if len(seen) >= NUMBERED_ROUTINES and max(seen) - min(seen) + 1 == len(seen):
            return "generated, by layout"
    if _MINIFIED_NAME.search(stem) or longest >= MINIFIED_LINE and _MAP in text and (_MAP in lines[-1] or _MAP_COMMENT.search(text)):
        return "minified"
    return None


_FOUND = "repo_id string, path string, why string, bytes int"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        why = [evidence(p, t.replace("\r\n", "\n")) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(why, pa.string()), b.column(3)], names=["repo_id", "path", "why", "bytes"])


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """repo_id, path, n, h1, h2 of every directory, deepest level first; `leaves` has the same columns for files.

    A directory's hash is made of its children's names and hashes. They are folded with xor of two 64-bit hashes, which
    needs no order, so a directory is aggregated map-side however many children it has."""
    depth = F.size(F.split("path", "/"))
    # Written by depth, so that each level reads its own files only.
    leaves = stage(leaves.withColumn("depth", depth), "leaves-by-depth", ["depth"])
    most = leaves.agg(F.max("depth")).first()[0] or 1
    levels: list[DataFrame] = []
    for level in range(most, 1, -1):
        children = leaves.where(F.col("depth") == level).drop("depth")
        if levels:
            children = children.unionByName(levels[-1])
        name = F.element_at(F.split("path", "/"), -1)
        parent = F.regexp_replace("path", r"/[^/]*$", "")
        dirs = children.groupBy("repo_id", parent.alias("path")).agg(
            F.sum("n").alias("n"),
            F.bit_xor(F.xxhash64(name, "n", "h1", "h2")).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit(7), name, "h2", "h1")).alias("h2"),
        )
        levels.append(stage(dirs, f"merkle-{level}"))
    return levels


def _sizes(versions: DataFrame, unknown: DataFrame, texts: DataFrame | None) -> DataFrame:
    """sha, known of the hashes of `unknown` (repo_id, path, sha): by any version with a size, else by a text."""
    known = versions.where("size_bytes is not null").join(unknown.select("sha").distinct(), "sha", "left_semi").select("sha", "size_bytes", F.lit(None).cast("long").alias("bytes"))
    if texts is not None:
        known = known.unionByName(unknown.join(texts.select("repo_id", "path", F.col("bytes").cast("long").alias("bytes")), ["repo_id", "path"]).select("sha", F.lit(None).cast("long").alias("size_bytes"), "bytes"))
    return known.groupBy("sha").agg(F.coalesce(F.max("size_bytes"), F.max("bytes")).alias("known"))


def repo_families(meta: DataFrame) -> DataFrame:
    """repo_id, family (its smallest repo_id) of the repositories that share a source or commit with another, directly or
    through others; of those that don't there is no row. Null and blank sources and commits link nothing."""
    key = lambda mark, c: F.when(F.trim(c) != "", F.concat(F.lit(mark), F.lower(F.trim(c))))
    keys = meta.where(F.col("repo_id").isNotNull()).select("repo_id", F.explode(F.array(key("s ", "source"), key("c ", "git_commit"))).alias("key")).where(F.col("key").isNotNull()).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("repos")).where("repos > 1").select("key")
    keys = stage(keys.join(shared, "key", "left_semi"), "repo-keys")
    labels = stage(keys.select("repo_id", F.col("repo_id").alias("family")).distinct(), "families-0")
    k = 1
    while True:
        least = keys.join(labels, "repo_id").groupBy("key").agg(F.min("family").alias("least"))
        moved = stage(keys.join(least, "key").groupBy("repo_id").agg(F.min("least").alias("family")), f"families-{k}")
        if moved.join(labels, ["repo_id", "family"], "left_anti").isEmpty():
            return moved
        labels, k = moved, k + 1


def shared_files(files: DataFrame, texts: DataFrame | None = None, meta: DataFrame | None = None, least_bytes: int = SHARED_BYTES) -> DataFrame:
    """repo_id, path of the files that lie in a subtree, or are a file, which an unrelated repository has as well.

    `texts` has repo_id, path, bytes of texts; `meta` tells which repositories are related (none are without it). Of each
    path the latest version counts. A directory of which at least half of the files, and two, are shared is a copy as a
    whole, locally changed files included. A file below `least_bytes` counts in such a directory or subtree only."""
    newest = F.max(F.struct("indexed_at", "sha", "size_bytes")).alias("v")
    versions = files.select("repo_id", plain_path(F.col("path")).alias("path"), plain_hash(F.col("sha256")).alias("sha"), F.col("size_bytes").cast("long").alias("size_bytes"), "indexed_at").where(
        F.col("sha").isNotNull() & (F.col("path") != "") & F.col("repo_id").isNotNull()
    )
    current = stage(versions.groupBy("repo_id", "path").agg(newest).select("repo_id", "path", "v.sha", F.col("v.size_bytes").alias("size")), "current")
    sizes = _sizes(versions, current.where("size is null").select("repo_id", "path", "sha"), texts)
    leaves = stage(
        current.join(sizes, "sha", "left").select("repo_id", "path", F.lit(1).cast("long").alias("n"), F.xxhash64("sha").alias("h1"), F.xxhash64(F.lit(7), "sha").alias("h2"), F.coalesce("size", "known").alias("size")),
        "leaves",
    )
    trees = merkle_levels(leaves.drop("size"))
    every = leaves.select("repo_id", "path", "n", "h1", "h2", "size", F.lit(True).alias("leaf"))
    family = F.col("repo_id")
    for t in trees:
        every = every.unionByName(t.select("*", F.lit(0).cast("long").alias("size"), F.lit(False).alias("leaf")))
    # A hash may be that of a third of all files: it is reduced map-side, and as the shared hashes are staged, the join
    # back has a plain exchange on either side that can be split, or a side small enough to be sent around.
    owned = every
    if meta is not None:
        owned, family = every.join(repo_families(meta), "repo_id", "left"), F.coalesce("family", "repo_id")
    common = stage(
        owned.groupBy("n", "h1", "h2", "leaf")
        .agg(F.min(family).alias("a"), F.max(family).alias("b"))
        .where("a != b")
        .select("n", "h1", "h2", "leaf"),
        "common",
    )
    marked = stage(every.join(common, ["n", "h1", "h2", "leaf"], "left_semi").where(~F.col("leaf") & (F.col("n") > 1) | F.col("leaf") & (F.col("size").isNull() | (F.col("size") >= least_bytes))), "shared")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    per_dir = leaves.groupBy("repo_id", folder.alias("dir")).agg(F.count("*").alias("all"))
    hit = marked.where("leaf").groupBy("repo_id", folder.alias("dir")).agg(F.count("*").alias("hit"))
    mostly = per_dir.join(hit, ["repo_id", "dir"]).where("hit >= 2 and hit * 2 >= all and dir != ''").select("repo_id", "dir")
    whole = stage(marked.where(~F.col("leaf")).select("repo_id", F.col("path").alias("dir")).unionByName(mostly).distinct(), "shared-dirs")
    # Every directory above a file, so that the marked ones meet their files by an equality.
    above = leaves.select("repo_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k - 1), "/"))).alias("dir")).where("dir != ''")
    return above.join(whole, ["repo_id", "dir"], "left_semi").select("repo_id", "path").unionByName(marked.where("leaf").select("repo_id", "path")).distinct()


def not_handwritten(files: DataFrame, sources: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """repo_id, path, why of the files of `sources` that nobody of the project wrote by hand; what is shared between
    repositories is named so, whatever else shows."""
    ship(sources.sparkSession)
    # The verdicts are staged: the text is read and judged once, and what follows works on a few short columns.
    judged = stage(
        sources.select("repo_id", plain_path(F.col("path")).alias("path"), "content", F.octet_length("content").alias("bytes")).where(F.col("content").isNotNull() & (F.col("path") != "")).mapInArrow(_judge, _FOUND),
        "judged",
    )
    shared = shared_files(files, judged, meta).withColumn("shared", F.lit(True))
    why = F.coalesce(F.when(F.col("shared"), "shared between repositories"), "why")
    return (
        judged.join(shared, ["repo_id", "path"], "left")
        .withColumn("why", why)
        .where(F.col("why").isNotNull())
        .groupBy("repo_id", "path")
        .agg(F.min("why").alias("why"))
    )
