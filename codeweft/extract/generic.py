"""Languages without an extractor of their own, by patterns, as SQL expressions: modules, imports, classes, functions.

Where a pattern matches, a mark is put into the text; cut into lines, the marks give
each match's line and column, and stand in the order of the matches themselves. A null text gives a failed result; a
text without matches a module only. Edges aren't read. Lines end at a line feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What functions (name and parameters), classes (name) and imports look like, in the order in which they
# are tried. `.` and `^` know the line feed only, classes of characters are Unicode's.
_FLAGS = "(?mdU)"
FUNCTIONS = (
    r"^[ \t]*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    r"(?:^|\s)function\s+(\w+)\s*\(([^)]*)\)",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>",
)
CLASS = r"^[ \t]*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"
IMPORTS = (
    r"^[ \t]*(?:import|from)\s+\S+",
    r"^[ \t]*import\s+.+\s+from\s+['\"]",
    r"^[ \t]*import\s+[\w.]+;",
    r'^[ \t]*import\s+"[\w./]+"',
)
#: What stands for a match in a text; texts that have it themselves have a blank there instead.
_MARK = r"'\u0001'"
_NONE, _EMPTY = "CAST(NULL AS STRING)", "CAST(array() AS ARRAY<STRING>)"


NOTE = ": read by patterns, structure is only approximate"


def label(path: str) -> str:
    """A file's extension stands for its language."""
    return path.rpartition(".")[2].lower() if "." in path else "unknown"


def _text(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _regex(pattern: str) -> str:
    return _text(_FLAGS + pattern)


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_text(r'(?U)^\s+|\s+$')}, '')"


def _id(name: str, line: str, path: str) -> str:
    return f"substring(concat_ws(':', repo_id, {path}, {name}, CAST({line} AS STRING)), 1, 128)"


def _matches(pattern: str, fields: str) -> str:
    """Array of `fields`, made of `m` (the match) and `s` (line, col, shown: where it begins, and the line that holds that)."""
    r = _regex(pattern)
    spot = f"named_struct('line', k + 1, 'col', length(array_join(slice(split(x, {_MARK}), 1, j), '')), 'shown', regexp_replace(replace(x, {_MARK}, ''), '\\r$', ''))"
    marked = rf"transform(split(regexp_replace(p_text, {r}, concat({_MARK}, '$0')), '\n'), (x, k) -> IF(size(split(x, {_MARK})) > 1, transform(sequence(1, size(split(x, {_MARK})) - 1), j -> {spot}), NULL))"
    return f"zip_with(regexp_extract_all(p_text, {r}, 0), flatten(filter({marked}, x -> x IS NOT NULL)), (m, s) -> named_struct({fields}))"


def _function(pattern: str) -> str:
    r = _regex(pattern)
    return _matches(pattern, f"'name', regexp_extract(m, {r}, 1), 'given', regexp_extract(m, {r}, 2), 'line', s.line, 'col', s.col, 'shown', s.shown")


# An element: named_struct of what differs between elements.
_ELEMENT = "named_struct('id_name', {0}, 'name', {1}, 'kind', {2}, 'line', {3}, 'col', {4}, 'end_col', {5}, 'signature', {6}, 'imports', {7}, 'parameters', {8})".format
_FOUND = "array_distinct(flatten(array(" + ", ".join(f"transform(regexp_extract_all(p_text, {_regex(p)}, 0), x -> {_strip('x')})" for p in IMPORTS) + ")))"
#: The text before an import's first place; one that spans lines is in no line and counts for the first.
_BEFORE = r"IF(contains(x, '\n'), '', substring(p_text, 1, position(x, p_text) - 1))"
_IMPORT_COL = rf"length(substring_index({_BEFORE}, '\n', -1))"
_IMPORT = _ELEMENT("substring(x, 1, 40)", "x", "'import'", rf"size(split({_BEFORE}, '\n'))", _IMPORT_COL, f"{_IMPORT_COL} + length(x)", _NONE, "array(x)", _EMPTY)
_CLASS_NAME = f"regexp_extract(m, {_regex(CLASS)}, 1)"
_CLASS = _ELEMENT(_CLASS_NAME, _CLASS_NAME, "'class'", "s.line", "s.col", "s.col + length(s.shown)", _strip("s.shown"), _EMPTY, _EMPTY).removeprefix("named_struct(").removesuffix(")")
_PARAMETERS = f"transform(filter(transform(split(f.given, ','), p -> {_strip('p')}), p -> p <> ''), p -> {_strip("substring_index(substring_index(p, ':', 1), '=', 1)")})"
_FUNCTION = _ELEMENT("f.name", "f.name", "IF(f.name IN ('__init__', 'constructor'), 'constructor', 'function')", "f.line", "f.col", "f.col + length(f.shown)", _strip("f.shown"), _EMPTY, _PARAMETERS)
_KEY = "concat_ws(':', f.name, CAST(f.line AS STRING))"


def with_pattern_nodes(files: DataFrame, path: str, language: str, on: str) -> DataFrame:
    """`files` (repo_id, `path`, content) with the array `nodes` of each text where `on` holds, null elsewhere: its module
    with all others as children, imports, classes, functions. `language` and `on` are SQL. Built column by column, so
    that each is computed once."""
    module = _id("'__module__'", "1", path)
    lines = r"size(split(p_text, '\n')) - IF(endswith(p_text, '\n') OR p_text = '', 1, 0)"
    first = _ELEMENT("'__module__'", path, "'module'", "1", "0", "0", _NONE, "p_statements", _EMPTY)
    node = {
        "id": _id("x.id_name", "x.line", path), "name": "x.name", "kind": "x.kind", "file_path": path, "start_line": "x.line", "end_line": f"IF(i = 0, {lines}, x.line)", "start_col": "x.col", "end_col": "x.end_col", "language": language,
        "parent_id": f"IF(i = 0, NULL, {module})", "children": f"IF(i = 0, array_distinct(transform(p_rest, y -> {_id('y.id_name', 'y.line', path)})), {_EMPTY})", "value": _NONE,
        "typed_parameters": f"transform(x.parameters, p -> named_struct('name', p, 'type', {_NONE}))", "parent_class": _NONE, "return_type": _NONE, "docstring": _NONE, "signature": "x.signature", "is_exported": "TRUE",
        "parameters": "x.parameters", "calls": _EMPTY, "imports": "x.imports", "bases": _EMPTY, "decorators": _EMPTY, "ref_names": _EMPTY,
    }
    steps = (
        ("p_text", f"IF({on}, translate(content, {_MARK}, ' '), NULL)"),
        ("p_statements", _FOUND),
        ("p_functions", "concat(" + ", ".join(map(_function, FUNCTIONS)) + ")"),
        ("p_keys", f"transform(p_functions, f -> {_KEY})"),
        # Of functions with one name and line the first; only a text that has such is searched for them.
        ("p_functions", f"IF(size(array_distinct(p_keys)) = size(p_keys), p_functions, filter(p_functions, (f, i) -> array_position(p_keys, {_KEY}) = i + 1))"),
        ("p_rest", f"concat(transform(p_statements, x -> {_IMPORT}), {_matches(CLASS, _CLASS)}, transform(p_functions, f -> {_FUNCTION}))"),
        ("nodes", f"transform(concat(array({first}), p_rest), (x, i) -> named_struct({', '.join(f"'{n}', {c}" for n, c in node.items())}))"),
    )
    for name, made in steps:
        files = files.withColumn(name, F.expr(made))
    return files.drop(*{name for name, _ in steps} - {"nodes"})


def by_patterns(files: DataFrame) -> DataFrame:
    """Rows `file` and `node` of `files` (repo_id, path, language, content): repo_id, file_path, language, ord, tag, node,
    success, errors."""
    files = files.select("repo_id", "path", "language", "content", F.expr("IF(contains(path, '.'), lower(substring_index(path, '.', -1)), 'unknown')").alias("label"), F.col("content").isNotNull().alias("read"))
    made = with_pattern_nodes(files, "path", "label", "read")
    kind = made.schema["nodes"].dataType
    # The file's own row stands before its nodes.
    nodes = F.concat(F.array(F.lit(None).cast(kind.elementType)), F.coalesce("nodes", F.array().cast(kind)))
    every = made.select("repo_id", "path", "language", "label", "read", F.posexplode(nodes).alias("ord", "node"))
    return every.selectExpr(
        "repo_id", "path AS file_path", "IF(read, label, coalesce(language, 'unknown')) AS language", "ord", "IF(ord = 0, 'file', 'node') AS tag", "node", "IF(ord = 0, read, NULL) AS success",
        f"IF(ord = 0, array(IF(read, concat(label, {_text(NOTE)}), 'file could not be read')), NULL) AS errors",
    )
