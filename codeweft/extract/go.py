"""Go."""

from __future__ import annotations

from codeweft.constants import GO_NOISE
from codeweft.extract.emit import Emitted, parameter, unique
from codeweft.extract.scan import Scan



def _parameters(s: Scan, i: int, j: int) -> list[dict]:
    """Parameters between brackets: with names all have one, and names may share a type; without, each is `_`."""
    parts = [p for p in s.split(i, j) if p[0] < p[1]]
    named = any(b - a > 1 and s.tokens[a].kind == "name" and s.at(a + 1) not in (".",) and s.at(a) not in ("func", "map", "chan", "struct", "interface") for a, b in parts)
    if not named:
        return [parameter("...", "..." + s.slice(a + 1, b)) if s.at(a) == "..." else parameter("_", s.slice(a, b)) for a, b in parts]
    out: list[dict] = []
    waiting: list[str] = []
    for a, b in parts:
        waiting.append(s.at(a))
        if b - a > 1:
            out += [parameter(n, s.slice(a + 1, b)) for n in waiting]
            waiting = []
    return out + [parameter(n) for n in waiting]


def _shown(params: list[dict]) -> str:
    return ", ".join(f"{p['name']} {p['type']}" if p["type"] else p["name"] for p in params)


class _Reader:
    def __init__(self, s: Scan, out: Emitted, module: str):
        self.s, self.out, self.module = s, out, module
        self.types: dict[str, str] = {}

    def statement_end(self, i: int) -> int:
        """First token of the next line outside of brackets."""
        s, k = self.s, i
        while k < len(s.tokens):
            if k > i and (s.tokens[k].fresh or s.at(k) == ";"):
                break
            k = s.close(k) + 1 if s.at(k) in ("(", "[", "{") and s.tokens[k].kind == "op" else k + 1
        return k

    def specs(self, i: int) -> tuple[list[tuple[int, int]], int]:
        """Token ranges of a declaration's specs, one or a group in brackets; and where it ends."""
        s = self.s
        if s.at(i + 1) == "(":
            end, k, out = s.close(i + 1), i + 2, []
            while k < end:
                e = min(self.statement_end(k), end)
                out.append((k, e))
                k = e + (s.at(e) == ";")
            return out, end + 1
        e = self.statement_end(i + 1)
        return [(i + 1, e)], e

    def types_(self, specs: list[tuple[int, int]]) -> None:
        s, out = self.s, self.out
        for a, b in specs:
            name, k = s.at(a), a + 1
            if s.at(k) == "[" and s.tokens[k + 1].kind == "name" and s.close(k) + 1 < b and s.at(k + 2) != "]":
                k = s.close(k) + 1
            k += s.at(k) == "="
            kind = {"struct": "struct", "interface": "interface"}.get(s.at(k))
            exported = name[:1].isupper()
            if kind is None:
                value = s.slice(k, b)
                self.types[name] = out.node(name, name, "type_annotation", s.span(a, b), parent_id=self.module, value=value, signature=f"type {name} = {value}")
                continue
            me = self.types[name] = out.make_id(name, s.span(a, b)[0])
            if kind == "interface" and s.at(k + 1) == "{":
                j, end = k + 2, s.close(k + 1)
                while j < end:
                    e = min(self.statement_end(j), end)
                    if s.at(j + 1) == "(":
                        params = _parameters(s, j + 2, s.close(j + 1))
                        ret = s.slice(s.close(j + 1) + 1, e) or None
                        out.node(f"{name}.{s.at(j)}", s.at(j), "method", s.span(j, e), parent_id=me, parent_class=name, typed_parameters=params, return_type=ret,
                                 signature=f"{s.at(j)}({_shown(params)})" + (f" {ret}" if ret else ""), is_exported=s.at(j)[:1].isupper())
                    j = e + (s.at(e) == ";")
            out.node(name, name, kind, s.span(a, b), parent_id=self.module, signature=f"type {name} {kind}", is_exported=exported)

    def function(self, i: int) -> int:
        s, out, k = self.s, self.out, i + 1
        receiver = receiver_text = None
        if s.at(k) == "(":
            end = s.close(k)
            receiver_text = s.slice(k, end + 1)
            params = _parameters(s, k + 1, end)
            if params and params[0]["type"]:
                receiver = params[0]["type"].lstrip("*").split("[")[0].strip()
            k = end + 1
        name = s.at(k)
        if s.at(k + 1) == "[":
            k = s.close(k + 1)
        if s.at(k + 1) != "(":
            return self.statement_end(i)
        begin, end = k + 2, s.close(k + 1)
        params = _parameters(s, begin, end)
        j = end + 1
        while j < len(s.tokens) and s.at(j) != "{" and not s.tokens[j].fresh:
            if s.at(j) in ("struct", "interface") and s.at(j + 1) == "{":
                j = s.close(j + 1)
            elif s.at(j) in ("(", "["):
                j = s.close(j)
            j += 1
        ret = s.slice(end + 1, j) or None
        stop = s.close(j) + 1 if s.at(j) == "{" else j
        calls = self.calls(j + 1, stop - 1) if s.at(j) == "{" else []
        kind = "method" if receiver_text else "constructor" if name.startswith(("New", "new")) else "function"
        me = out.node(
            f"{receiver}.{name}" if receiver else name, name, kind, s.span(i, stop), parent_id=self.types.get(receiver, self.module) if receiver else self.module, parent_class=receiver,
            typed_parameters=params, return_type=ret, calls=unique(c[0] for c in calls), is_exported=name[:1].isupper(),
            signature="func " + (f"{receiver_text} " if receiver_text else "") + f"{name}({_shown(params)})" + (f" {ret}" if ret else ""),
        )
        for raw, at in calls:
            out.call(me, raw, s.line(at), s.col(at), "." in raw)
        return stop

    def calls(self, i: int, j: int) -> list[tuple[str, int]]:
        s, out = self.s, []
        for k in range(i, j):
            if s.at(k) != "(" or s.tokens[k].kind != "op":
                continue
            b = k - 1
            if s.tokens[b].kind != "name" and s.at(b) not in (")", "]"):
                continue
            if s.at(b) in ("func", "if", "for", "switch", "return", "range", "case", "go", "defer", "select", "else", "chan", "interface", "struct", "map", "type", "import", "var", "const"):
                continue
            a = b
            while True:
                if s.at(a) in (")", "]") and a in s.partner:
                    a = s.partner[a] - 1
                    if a < i or s.tokens[a].kind != "name" and s.at(a) not in (")", "]"):
                        a += 1
                        break
                    continue
                if s.at(a - 1) == "." and a - 2 >= i:
                    a -= 2
                    continue
                break
            if s.at(a - 1) == "func":
                continue
            raw = s.slice(a, k).strip()
            last = raw.split(".")[-1].strip()
            if last and last.lower() not in GO_NOISE:
                out.append((raw, s.tokens[a].start))
        return out

    def variables(self, specs: list[tuple[int, int]]) -> None:
        s = self.s
        for a, b in specs:
            if a >= b:
                continue
            eq = next((k for k in range(a, b) if s.at(k) == "=" and s.tokens[k].kind == "op"), None)
            value = s.slice(eq + 1, b).strip() if eq is not None else None
            self.out.node(f"var:{s.at(a)}", s.at(a), "assignment", s.span(a, b), parent_id=self.module, value=value, signature=s.slice(a, b).split("\n", 1)[0].strip())


def extract(text: str, path: str, repo: str) -> Emitted:
    out = Emitted(repo, path, "go")
    s = Scan(text, go=True)
    module = out.make_id("__module__", 1)
    r = _Reader(s, out, module)
    names: list[str] = []
    rest: list[tuple[str, int]] = []
    i = 0
    while i < len(s.tokens):
        word = s.at(i)
        if word == "import":
            specs, end = r.specs(i)
            for a, b in specs:
                at = next((k for k in range(a, b) if s.tokens[k].kind == "string"), None)
                if at is None:
                    continue
                alias = s.at(a) if at > a and s.at(a) not in (".", "_") else None
                names.append(s.slice(a, b).strip())
                out.import_(s.at(at).strip('"`').split("/")[-1], s.line(s.tokens[i].start), alias)
            i = end
        elif word in ("type", "func", "var", "const"):
            rest.append((word, i))
            i = r.specs(i)[1] if word != "func" else _skip_function(s, r, i)
        else:
            i = max(i + 1, r.statement_end(i))
    out.node("__module__", path, "module", (1, text.count("\n") + 1, 0, 0), imports=names)
    for word, i in rest:
        if word == "type":
            r.types_(r.specs(i)[0])
        elif word == "func":
            r.function(i)
        else:
            r.variables(r.specs(i)[0])
    out.link_children()
    return out


def _skip_function(s: Scan, r: _Reader, i: int) -> int:
    k = i + 1
    while k < len(s.tokens):
        if s.at(k) in ("(", "["):
            k = s.close(k) + 1
        elif s.at(k) in ("struct", "interface") and s.at(k + 1) == "{":
            k = s.close(k + 1) + 1
        elif s.at(k) == "{":
            return s.close(k) + 1
        elif s.tokens[k].fresh:
            return k
        else:
            k += 1
    return k
