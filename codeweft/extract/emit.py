"""What extractors emit."""

from __future__ import annotations

from dataclasses import dataclass, field

LIST_FIELDS = ("children", "typed_parameters", "parameters", "calls", "imports", "bases", "decorators", "ref_names")


@dataclass
class Emitted:
    """Elements and edges of one file, in the order they were found."""

    repo_id: str
    file_path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    inherits: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    success: bool = True
    seen: set = field(default_factory=set)
    #: Set when the text is to be read by patterns instead: the note that tells why.
    by_patterns: str | None = None

    def make_id(self, name: str, line: int) -> str:
        return f"{self.repo_id}:{self.file_path}:{name}:{line}"[:128]

    def node(self, id_name: str, name: str, kind: str, span: tuple[int, int, int, int], **more) -> str:
        """Add an element; span: start line, end line, start column, end column. Its id is returned."""
        row = {
            "id": self.make_id(id_name, span[0]), "name": name, "kind": kind, "file_path": self.file_path, "start_line": span[0], "end_line": span[1], "start_col": span[2], "end_col": span[3],
            "language": self.language, "parent_id": None, "value": None, "parent_class": None, "return_type": None, "docstring": None, "signature": None, "is_exported": True,
        } | {k: [] for k in LIST_FIELDS} | more
        row["parameters"] = [p["name"] for p in row["typed_parameters"]]
        self.nodes.append(row)
        return row["id"]

    def call(self, caller: str, name: str, line: int, col: int, method: bool = False) -> None:
        row = {"caller_id": caller, "callee_name": name, "callee_id": None, "file_path": self.file_path, "line_number": line, "col_number": col, "is_method_call": method}
        if (caller, name, line, col) not in self.seen:
            self.seen.add((caller, name, line, col))
            self.calls.append(row)

    def import_(self, target: str | None, line: int, alias: str | None = None) -> None:
        if target:
            self.imports.append({"source_file": self.file_path, "target_module": target, "alias": alias, "line_number": line, "is_default": False, "is_wildcard": False})

    def inherit(self, child: str, parent: str, kind: str = "inherits") -> None:
        self.inherits.append({"child_id": child, "parent_name": parent, "parent_id": None, "kind": kind})

    def link_children(self) -> None:
        """Fill `children` from the parent ids, in order, each once."""
        by_id = {n["id"]: n for n in self.nodes}
        linked = set()
        for n in self.nodes:
            parent, link = by_id.get(n["parent_id"]), (n["parent_id"], n["id"])
            if parent is not None and link not in linked:
                linked.add(link)
                parent["children"].append(n["id"])


def unique(names) -> list[str]:
    return list(dict.fromkeys(names))


def parameter(name: str, type_: str | None = None) -> dict:
    return {"name": name, "type": type_}
