"""Explicit schemas of every table."""

from __future__ import annotations

NODE = """id string, name string, kind string, file_path string, start_line int, end_line int, start_col int, end_col int, language string, parent_id string,
children array<string>, value string, typed_parameters array<struct<name:string,type:string>>, parent_class string, return_type string, docstring string, signature string,
is_exported boolean, parameters array<string>, calls array<string>, imports array<string>, bases array<string>, decorators array<string>, ref_names array<string>"""
CALL_EDGE = "caller_id string, callee_name string, callee_id string, file_path string, line_number int, col_number int, is_method_call boolean"
IMPORT_EDGE = "source_file string, target_module string, alias string, line_number int, is_default boolean, is_wildcard boolean"
INHERITANCE_EDGE = "child_id string, parent_name string, parent_id string, kind string"
REFERENCE_EDGE = "source_id string, target_name string, target_id string, line_number int"
PARSE_RESULT = "file_path string, language string, success boolean, errors array<string>"
FILE = "repo_id string, path string, language string, sha256 string, size_bytes bigint, last_modified timestamp, status string, line_count int, indexed_at timestamp"
REPO_META = "repo_id string, source string, source_type string, git_branch string, git_commit string, last_indexed_at timestamp"
GRAPH_NODE = "id string, name string, kind string, file_path string, start_line int, end_line int, language string, is_exported boolean, parent_id string, parent_class string"
GRAPH_EDGE = "src string, dst string, type string"
