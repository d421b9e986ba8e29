"""Python, by the standard library's syntax trees."""

from __future__ import annotations

import ast
import re

from codeweft.constants import PYTHON_ENUM_BASES, PYTHON_INTERFACE_BASES, PYTHON_NO_REFERENCE, PYTHON_NOISE
from codeweft.extract.emit import Emitted, parameter, unique

#: Definitions are looked for in compound statements down to this depth; a statement and each clause and block count one.
MAX_DEPTH = 4


def import_target(statement: str) -> str | None:
    m = re.match(r"from\s+\.*(\S*)\s+import|import\s+(\S+)", statement)
    return (m[1] or m[2] or "").split(".")[0] or None if m else None


class _Reader:
    def __init__(self, text: str, out: Emitted):
        self.out = out
        self.lines = text.encode("utf-8", "replace").splitlines(keepends=True)

    def text(self, node: ast.AST) -> str:
        return self.between(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)

    def between(self, l1: int, c1: int, l2: int, c2: int) -> str:
        if l1 == l2:
            return self.lines[l1 - 1][c1:c2].decode("utf-8", "replace")
        parts = [self.lines[l1 - 1][c1:], *self.lines[l1 : l2 - 1], self.lines[l2 - 1][:c2]]
        return b"".join(parts).decode("utf-8", "replace")

    def span(self, node: ast.AST) -> tuple[int, int, int, int]:
        return node.lineno, node.end_lineno, node.col_offset, node.end_col_offset

    def first_line(self, node: ast.AST) -> str:
        return self.text(node).split("\n", 1)[0].strip()

    # --- statements

    def body(self, statements: list[ast.stmt], cls: str | None, parent: str, depth: int) -> None:
        for s in statements:
            match s:
                case ast.ClassDef():
                    self.class_(s, parent)
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    self.function(s, cls, parent)
                case ast.Assign() | ast.AnnAssign():
                    self.assignment(s, parent)
                case ast.TypeAlias():
                    value = self.text(s.value)
                    self.out.node(self.text(s.name), self.text(s.name), "type_annotation", self.span(s), parent_id=parent, value=value, signature=f"type {self.text(s.name)} = {value}")
                case _ if depth < MAX_DEPTH:
                    for inner, cost in self.clauses(s):
                        # The block itself is entered only below the limit.
                        if depth + cost - 1 < MAX_DEPTH:
                            self.body(inner, cls, parent, depth + cost)

    @staticmethod
    def clauses(s: ast.stmt) -> list[tuple[list[ast.stmt], int]]:
        """The blocks of a compound statement with what they cost in depth."""
        match s:
            case ast.If():
                out, rest = [(s.body, 2)], s.orelse
                while len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == s.col_offset:
                    out.append((rest[0].body, 3))
                    rest = rest[0].orelse
                return [*out, (rest, 3)]
            case ast.For() | ast.AsyncFor() | ast.While():
                return [(s.body, 2), (s.orelse, 3)]
            case ast.With() | ast.AsyncWith():
                return [(s.body, 2)]
            case ast.Try() | ast.TryStar():
                return [(s.body, 2), *((h.body, 3) for h in s.handlers), (s.orelse, 3), (s.finalbody, 3)]
            case ast.Match():
                return [(c.body, 4) for c in s.cases]
        return []

    def decorators(self, node) -> list[str]:
        return ["@" + self.text(d).strip() for d in node.decorator_list]

    def docstring(self, node) -> str | None:
        for s in node.body:
            if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
                return self.text(s).strip().strip('"').strip("'").strip('"').strip("'").strip()
        return None

    def class_(self, node: ast.ClassDef, parent: str) -> None:
        bases = [self.text(b).strip() for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        last = {b.rpartition(".")[2].lower() for b in bases}
        kind = "enum" if last & set(PYTHON_ENUM_BASES) else "interface" if last & set(PYTHON_INTERFACE_BASES) else "class"
        me = self.out.node(node.name, node.name, kind, self.span(node), parent_id=parent, bases=bases, decorators=self.decorators(node), signature=self.first_line(node), docstring=self.docstring(node))
        for b in bases:
            self.out.inherit(me, b, "implements" if kind == "interface" else "inherits")
        self.body(node.body, node.name, me, 0)

    def function(self, node, cls: str | None, parent: str) -> None:
        kind = "constructor" if node.name == "__init__" else "method" if cls else "function"
        calls = self.kept_calls(node.body)
        me = self.out.node(
            f"{cls}.{node.name}" if cls else node.name, node.name, kind, self.span(node), parent_id=parent, parent_class=cls, typed_parameters=self.parameters(node.args),
            return_type=self.text(node.returns).strip() if node.returns else None, docstring=self.docstring(node), signature=self.first_line(node),
            calls=unique(name for name, _ in calls), ref_names=self.references(node.body), decorators=self.decorators(node), is_exported=not node.name.startswith("_"),
        )
        for name, c in calls:
            self.out.call(me, name, c.lineno, c.col_offset)
        for s in node.body:
            for x in ast.walk(s):
                if isinstance(x, ast.Lambda):
                    args = [parameter(a.arg) for a in self.plain(x.args)]
                    self.out.node("__lambda__", "<lambda>", "lambda", self.span(x), parent_id=me, typed_parameters=args, signature=self.text(x)[:80].strip(), calls=unique(n for n, _ in self.kept_calls([x.body])))
        self.body(node.body, cls, me, 0)

    @staticmethod
    def plain(args: ast.arguments) -> list[ast.arg]:
        """Parameters without default, star or annotation."""
        both = [*args.posonlyargs, *args.args]
        return [*both[: len(both) - len(args.defaults)], *(a for a, d in zip(args.kwonlyargs, args.kw_defaults) if d is None)]

    def parameters(self, args: ast.arguments) -> list[dict]:
        every = [(a, False) for a in (*args.posonlyargs, *args.args)]
        every += [(args.vararg, True)] if args.vararg else []
        every += [(a, False) for a in args.kwonlyargs]
        every += [(args.kwarg, True)] if args.kwarg else []
        return [parameter(a.arg, self.text(a.annotation).strip() if a.annotation else None) for a, star in every if star or a.arg not in ("self", "cls")]

    def kept_calls(self, roots: list[ast.AST]) -> list[tuple[str, ast.Call]]:
        """Calls below, nested definitions included, without those that only make noise; in order of their place."""
        found = [x for r in roots for x in ast.walk(r) if isinstance(x, ast.Call)]
        found.sort(key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset))
        named = [(self.text(c.func).strip(), c) for c in found]
        return [(n, c) for n, c in named if (last := n.rpartition(".")[2].lower()) and last not in PYTHON_NOISE]

    def assignment(self, s: ast.Assign | ast.AnnAssign, parent: str) -> None:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target]
        name = self.text(targets[0]).strip()
        first = targets[1] if len(targets) > 1 else s.value
        value = self.between(first.lineno, first.col_offset, s.end_lineno, s.end_col_offset).strip() if first else None
        type_ = self.text(s.annotation).strip() if isinstance(s, ast.AnnAssign) else None
        self.out.node(f"assign:{name}", name, "assignment", self.span(s), parent_id=parent, value=value, return_type=type_, signature=self.text(s)[:120].strip())

    def references(self, body: list[ast.stmt]) -> list[str]:
        """Bare names that are returned, chosen, listed, mapped to or assigned, outside of calls."""
        found: set[str] = set()

        def names(*nodes) -> None:
            found.update(n.id for n in nodes if isinstance(n, ast.Name))

        def visit(n: ast.AST) -> None:
            match n:
                case ast.Call():
                    return
                case ast.Return():
                    names(n.value)
                case ast.IfExp():
                    names(n.test, n.body, n.orelse)
                case ast.List() | ast.Set():
                    names(*n.elts)
                case ast.Tuple() if self.text(n).startswith("("):
                    names(*n.elts)
                case ast.Dict():
                    names(*n.values)
                case ast.Assign() | ast.AnnAssign():
                    names(n.value)
                case ast.ClassDef():
                    names(*n.bases, *(k.value for k in n.keywords))
            for c in ast.iter_child_nodes(n):
                visit(c)

        for s in body:
            visit(s)
        return sorted(n for n in found if len(n) > 1 and n not in PYTHON_NO_REFERENCE)


def extract(text: str, path: str, repo: str) -> Emitted:
    out = Emitted(repo, path, "python")
    try:
        tree = ast.parse(text.replace("\x00", ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out.by_patterns = "syntax errors: partial parse by patterns"
        return out
    r = _Reader(text.replace("\x00", ""), out)
    module = out.make_id("__module__", 1)
    statements = []
    for s in tree.body:
        if isinstance(s, (ast.Import, ast.ImportFrom)) and not (isinstance(s, ast.ImportFrom) and s.module == "__future__" and not s.level):
            shown = r.text(s).strip()
            statements.append(shown)
            out.node(shown[:40], shown, "import", r.span(s), parent_id=module, imports=[shown])
            out.import_(import_target(shown), s.lineno)
    out.node("__module__", path, "module", (1, text.count("\n") + 1, 0, 0), imports=statements)
    r.body(tree.body, None, module, 0)
    out.link_children()
    return out
