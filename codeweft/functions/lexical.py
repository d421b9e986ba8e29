"""Paths, languages, names and import targets as column expressions.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweft import constants as C


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table; null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Suffix in lower case with its dot; '' for none, for names like `.profile` and names that end in a dot."""
    return F.lower(F.regexp_extract(filename(path), r"^.+(\.[^.]+)$", 1))


def shebang_language(head: Column) -> Column:
    """Language of a `#!` line at the very start of a text: of its last word the base name counts, and the first
    interpreter it begins with."""
    line = F.trim(F.regexp_extract(F.substring(head, 1, 128), r"^([^\n]*)", 1))
    word = F.element_at(F.split(F.regexp_replace(line, r"^#!\s*", ""), r"\s+"), -1)
    base = F.element_at(F.split(word, "/"), -1)
    tests = [(F.startswith(base, F.lit(k)), v) for k, v in C.SHEBANG_LANGUAGE.items()]
    found = reduce(lambda acc, t: acc.when(*t), tests[1:], F.when(*tests[0]))
    return F.when(F.startswith(line, F.lit("#!")) & (F.instr(F.substring(head, 1, 128), "\x00") == 0) & (base != ""), found)


def detect_language(path: Column, head: Column | None = None) -> Column:
    """By extension, else by the `#!` line of `head`, else by name."""
    tests = [lookup(C.EXTENSION_LANGUAGE, extension(path))]
    if head is not None:
        tests.append(shebang_language(head))
    return F.coalesce(*tests, lookup(C.FILENAME_LANGUAGE, filename(path)))


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes; unreadable (null) counts as binary."""
    return F.coalesce(F.instr(F.substring(content, 1, C.SNIFFED_BYTES), "\x00") > 0, F.lit(True))


def is_listed(path: Column, size: Column) -> Column:
    """Would the listing keep a file: no excluded or hidden directory above it, a source extension or none, not too large."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(dirs, lambda d: d.isin(*C.EXCLUDED_DIRS) | F.startswith(d, F.lit(".")))
    ext = extension(path)
    return ~hidden & ((ext == "") | ext.isin(*C.SOURCE_EXTENSIONS)) & (F.coalesce(size, F.lit(0)) <= C.MAX_FILE_BYTES)


def count_lines(content: Column) -> Column:
    """Number of line feeds."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).cast("int")


def status(previous: Column, current: Column) -> Column:
    """new, modified, unchanged or deleted, from the stored and the current hash."""
    return (
        F.when(current.isNull(), "deleted").when(previous.isNull(), "new").when(previous != current, "modified").otherwise("unchanged")
    )


def url_slug(url: Column) -> Column:
    """A repository's address as a name: no scheme, no `.git`, separators as single dashes."""
    s = F.regexp_replace(url, r"\.git$", "")
    s = F.regexp_replace(s, r"^git@([^:]+):", "$1/")
    s = F.regexp_replace(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[/\\:@]+", "-"), r"-+", "-"), r"^-+|-+$", "")


def sanitise_slug(slug: Column) -> Column:
    return F.substring(F.regexp_replace(slug, r"(?U)[^\w\-]", "_"), 1, 128)


def node_id(repo: Column, path: Column, name: Column, line: Column) -> Column:
    return F.substring(F.concat_ws(":", repo, path, name, line.cast("string")), 1, 128)


def leaf(name: Column) -> Column:
    """The last dotted part."""
    return F.element_at(F.split(name, r"\."), -1)


def stem(target: Column) -> Column:
    """The base name of an import target or path, up to its first dot."""
    return F.substring_index(F.substring_index(F.replace(target, F.lit("\\"), F.lit("/")), "/", -1), ".", 1)


def _null_blank(c: Column) -> Column:
    return F.when(c != "", c)


def python_import_target(statement: Column) -> Column:
    """First part of the module a Python import names; null for `from . import x`."""
    source = F.regexp_extract(statement, r"^from\s+(\.*\S+)\s+import", 1)
    plain = F.regexp_extract(statement, r"^import\s+(\S+)", 1)
    module = F.when(source != "", F.regexp_replace(source, r"^\.+", "")).otherwise(plain)
    return _null_blank(F.substring_index(module, ".", 1))


def es_import_target(statement: Column) -> Column:
    """Target of an import with `from`: a relative one loses its extension, a package keeps its first part in lower case."""
    raw = F.regexp_extract(statement, r"""from\s+['"]([^'"]+)['"]""", 1)
    relative = F.regexp_replace(raw, r"(?U)\.\w+$", "")
    return _null_blank(F.when(F.startswith(raw, F.lit(".")) | F.startswith(raw, F.lit("/")), relative).otherwise(F.lower(F.substring_index(raw, "/", 1))))


def go_import_target(statement: Column) -> Column:
    """Last part of a Go import path."""
    return _null_blank(F.substring_index(F.regexp_extract(statement, r"[\"`]([^\"`]+)[\"`]", 1), "/", -1))


def import_target(language: Column, statement: Column) -> Column:
    return (
        F.when(language == "python", python_import_target(statement))
        .when(language.isin("javascript", "typescript"), es_import_target(statement))
        .when(language == "go", go_import_target(statement))
    )


def is_noise(language: Column, callee: Column) -> Column:
    """Is a callee left out of call edges?"""
    last = leaf(callee)
    return (
        (last == "")
        | F.when(language == "python", F.lower(last).isin(*C.PYTHON_NOISE))
        .when(language.isin("javascript", "typescript"), last.isin(*C.JAVASCRIPT_NOISE) | (callee == "require"))
        .when(language == "go", F.lower(last).isin(*C.GO_NOISE))
        .otherwise(False)
    )


def begins_upper(name: Column) -> Column:
    c = F.substring(name, 1, 1)
    return (c == F.upper(c)) & (c != F.lower(c))


def is_entry(kind: Column, name: Column, exported: Column) -> Column:
    """Can a node be reached from outside: exported, a module, `main`, or a function whose name begins with a capital."""
    return F.coalesce(exported, F.lit(True)) | (kind == "module") | (name == "main") | ((kind == "function") & begins_upper(name))


def kind_colour(kind: Column) -> Column:
    return F.coalesce(lookup(C.KIND_COLOURS, kind), F.lit(C.OTHER_COLOUR))
