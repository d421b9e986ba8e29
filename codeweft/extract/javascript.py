"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from codeweft.constants import JAVASCRIPT_NO_REFERENCE, JAVASCRIPT_NOISE
from codeweft.extract.emit import Emitted, parameter, unique
from codeweft.extract.scan import Scan

_HOOKS = ("useEffect", "useCallback", "useMemo")
_NO_CALLEE = frozenset("if for while switch catch return function typeof new await yield case throw void delete in of do else instanceof with".split())
_OPERATORS_ON = frozenset(". ?. , = => + - * / % && || ?? ? : ( [ { < > & | ^ ! ~ == === != !== <= >= += -= *= /= ...".split())
_MODIFIERS = frozenset("public private protected readonly static async get set override abstract declare accessor".split())


def import_target(statement: str) -> str | None:
    m = re.search(r"""from\s+['"]([^'"]+)['"]""", statement)
    if not m:
        return None
    return (re.sub(r"\.\w+$", "", m[1]) if m[1][0] in "./" else m[1].split("/")[0].lower()) or None


class _Reader:
    def __init__(self, s: Scan, out: Emitted, ts: bool):
        self.s, self.out, self.ts = s, out, ts
        #: Bodies of interfaces: what looks like a call there is a signature.
        self.bodies: list[tuple[int, int]] = []
        for k in range(len(s.tokens)) if ts else ():
            if s.at(k) == "interface" and s.at(k - 1) != "." and k + 1 < len(s.tokens) and s.tokens[k + 1].kind == "name":
                b = next((x for x in range(k, len(s.tokens)) if s.at(x) == "{"), len(s.tokens))
                self.bodies.append((b, s.close(b)))

    # --- ranges

    def end(self, i: int, stop: int) -> int:
        """Where the statement that begins at i ends: behind its semicolon, or at a line that can't continue it."""
        s, k = self.s, i
        while k < stop:
            t = s.tokens[k]
            if k > i and t.fresh and s.at(k - 1) not in _OPERATORS_ON and t.text not in _OPERATORS_ON - {"{", "!", "~", "..."} and t.text not in ("instanceof", "in", "of", "as", "extends"):
                return k
            if t.kind == "op" and t.text in ("(", "[", "{"):
                k = s.close(k) + 1
                continue
            if t.text == ";" and t.kind == "op":
                return k + 1
            k += 1
        return stop

    def arrow(self, i: int, j: int) -> tuple[int, int] | None:
        """(first token of the parameters, place of =>) when tokens i to j are an arrow function."""
        s = self.s
        k = i + (s.at(i) == "async" and s.at(i + 1) != "=>")
        if s.at(k) == "<":
            k = next((x for x in range(k, j) if s.at(x) == "("), j)
        if k < j and s.tokens[k].kind == "name" and s.at(k + 1) == "=>":
            return k, k + 1
        if s.at(k) != "(" or s.close(k) >= j:
            return None
        e = s.close(k) + 1
        if s.at(e) == ":":
            depth = 0
            while e < j and not (s.at(e) == "=>" and not depth):
                if s.at(e) in ("(", "[", "{"):
                    e = s.close(e)
                elif s.at(e) in (";", ","):
                    depth += s.at(e) == ";"
                e += 1
        return (k, e) if e < j and s.at(e) == "=>" else None

    def is_function(self, i: int) -> bool:
        return self.s.at(i) == "function" or self.s.at(i) == "async" and self.s.at(i + 1) == "function"

    # --- parameters, types

    def parameters(self, i: int, j: int) -> list[dict]:
        s, out = self.s, []
        for a, b in s.split(i, j):
            while a < b and (s.at(a) in ("public", "private", "protected", "readonly", "override") and a + 1 < b and s.tokens[a + 1].kind == "name" or s.at(a).startswith("@")):
                a = s.close(a + 1) + 1 if s.at(a).startswith("@") and s.at(a + 1) == "(" else a + 1
            if a >= b:
                continue
            if s.at(a) in ("{", "["):
                e = s.close(a) + 1
                out.append(parameter(s.slice(a, e), "object" if s.at(a) == "{" else "array"))
                continue
            a += s.at(a) == "..."
            eq = next((k for k in self.flat(a, b) if s.at(k) == "="), b)
            colon = next((k for k in range(a, eq) if s.at(k) == ":"), None) if self.ts else None
            out.append(parameter(s.at(a), s.slice(colon + 1, eq).strip() if colon is not None else None))
        return out

    def flat(self, i: int, j: int):
        k = i
        while k < j:
            yield k
            if self.s.tokens[k].kind == "op" and self.s.at(k) in ("(", "[", "{"):
                k = self.s.close(k)
            k += 1

    def skip_type(self, i: int, stop: int) -> int:
        """Behind the type that begins at i: at a `{` that opens a body, `=>`, `=` or `;`."""
        s, k, first = self.s, i, True
        while k < stop:
            t = s.at(k)
            if t == "{" and not first and s.at(k - 1) not in ("|", "&", "=>", "<", ",", ":"):
                return k
            if t in ("=>", "=", ";"):
                return k
            if t in ("(", "[", "{"):
                k = s.close(k)
            first = False
            k += 1
        return k

    # --- calls and references

    def calls_in(self, i: int, j: int, nested: bool) -> list[tuple[str, int]]:
        """(callee, offset) of the calls among tokens i to j; without `nested`, not those inside of inner functions,
        but for the functions given to hooks."""
        s, out, k = self.s, [], i
        hidden = self.bodies if nested else self.bodies + self.inner_functions(i, j)
        for k in range(i, j):
            if s.at(k) != "(" or s.tokens[k].kind != "op":
                continue
            raw, at = self.callee(i, k)
            if raw is None:
                continue
            if any(a <= k < b for a, b in hidden):
                continue
            out.append((raw, at))
            if not nested and raw in _HOOKS:
                out += self.calls_in(k + 1, min(s.close(k), j), True)
        return out

    def callee(self, low: int, k: int) -> tuple[str | None, int]:
        """The text before an opening bracket that is called, if it is one that counts."""
        s, b = self.s, k - 1
        if b < low:
            return None, 0
        t = s.tokens[b]
        if t.kind == "name" and (t.text in _NO_CALLEE or s.at(b - 1) in ("function", "new") or s.at(b - 1) == "*" and s.at(b - 2) == "function"):
            return None, 0
        if t.kind != "name" and t.text not in (")", "]"):
            return None, 0
        after = s.close(k) + 1
        if s.at(after) == "{" and not s.tokens[after].fresh or s.at(after) == "=>" or self.ts and s.at(after) == ":" and self.typed_head(after):
            return None, 0  # the head of a method or arrow function
        a = b
        while a >= low:
            if s.at(a) in (")", "]") and a in s.partner:
                a = s.partner[a]
                if a > low and (s.tokens[a - 1].kind == "name" and s.at(a - 1) not in _NO_CALLEE or s.at(a - 1) in (")", "]")):
                    a -= 1
                    continue
            if a > low and s.at(a - 1) in (".", "?."):
                a -= 2
                continue
            break
        a = max(a, low)
        if s.at(a - 1) == "new":
            return None, 0
        raw = s.text[s.tokens[a].start : s.tokens[b].end].strip()
        last = raw.split(".")[-1].strip()
        if raw == "require" or not last or last in JAVASCRIPT_NOISE:
            return None, 0
        return raw, s.tokens[a].start

    def typed_head(self, colon: int) -> bool:
        e = self.skip_type(colon + 1, min(colon + 60, len(self.s.tokens)))
        return self.s.at(e) in ("{", "=>") and self.s.at(e - 1) != ","

    def inner_functions(self, i: int, j: int) -> list[tuple[int, int]]:
        s, out, k = self.s, [], i
        while k < j:
            if s.at(k) == "function":
                e = next((x for x in range(k, j) if s.at(x) == "("), j)
                body = s.close(e) + 1 if e < j else j
                body = self.skip_type(body + 1, j) if s.at(body) == ":" else body
                stop = s.close(body) + 1 if s.at(body) == "{" else body
                out.append((k, stop))
                k = stop
                continue
            if s.at(k) == "=>":
                begin = s.partner.get(k - 1, k - 1)
                stop = s.close(k + 1) + 1 if s.at(k + 1) == "{" else self.expression_end(k + 1, j)
                out.append((begin, stop))
                k = stop
                continue
            k += 1
        return out

    def expression_end(self, i: int, stop: int) -> int:
        k = i
        while k < stop and self.s.at(k) not in (",", ";", ")", "]", "}"):
            if k > i and self.s.tokens[k].fresh and self.s.at(k - 1) not in _OPERATORS_ON and self.s.at(k) not in _OPERATORS_ON:
                break
            k = self.s.close(k) + 1 if self.s.at(k) in ("(", "[", "{") and self.s.tokens[k].kind == "op" else k + 1
        return k

    def references(self, i: int, j: int) -> list[str]:
        """Names in arguments, lists, object values, returned values, choices and initial values; not in inner functions."""
        s, found = self.s, set()
        hidden = self.inner_functions(i, j)

        def names(a: int, b: int) -> None:
            for k in range(a, min(b, j)):
                t = s.tokens[k]
                if t.kind == "name" and s.at(k - 1) not in (".", "?.") and not any(x <= k < y for x, y in hidden):
                    if not (s.at(k + 1) == ":" and s.at(k - 1) in ("{", ",")):
                        found.add(t.text)

        for k in range(i, j):
            if any(a <= k < b for a, b in hidden):
                continue
            t = s.tokens[k]
            if t.text == "(" and t.kind == "op" and k > i and (s.tokens[k - 1].kind == "name" and s.at(k - 1) not in _NO_CALLEE or s.at(k - 1) in (")", "]")):
                names(k + 1, s.close(k))
            elif t.text == "[" and t.kind == "op":
                names(k + 1, s.close(k))
            elif t.text == "return":
                names(k + 1, self.end(k + 1, j))
            elif t.text in ("const", "let", "var"):
                names(k + 1, self.end(k, j))
            elif t.text == "?" and t.kind == "op":
                names(k - 1, self.end(k, j))
            elif t.text == ":" and s.tokens[k - 1].kind in ("name", "string") and s.at(k - 2) in ("{", ","):
                names(k + 1, self.expression_end(k + 1, j))
        return sorted(n for n in found if len(n) > 1 and n not in JAVASCRIPT_NO_REFERENCE)

    # --- elements

    def function(self, i: int, stop: int, parent: str, cls: str | None, exported: bool = False, name: str | None = None) -> int:
        """`function name(...) {...}` from i on; the place behind it."""
        s, k = self.s, i + (self.s.at(i) == "async")
        k += 1
        k += s.at(k) == "*"
        own = s.at(k) if s.tokens[k].kind == "name" else None
        k += own is not None
        if s.at(k) == "<":
            k = next((x for x in range(k, stop) if s.at(x) == "("), k)
        if s.at(k) != "(":
            return self.end(i, stop)
        body = s.close(k) + 1
        ret = None
        if s.at(body) == ":":
            e = self.skip_type(body + 1, stop)
            ret, body = s.slice(body + 1, e).strip(), e
        last = s.close(body) + 1 if s.at(body) == "{" else body
        self.callable_(name or own or "<anonymous>", "method" if cls else "function", i, last, (k + 1, s.close(k)), (body + 1, last - 1), ret, parent, cls, exported, s.span(i, last))
        return last

    def callable_(self, name, kind, i, last, args, body, ret, parent, cls, exported, span, method_edges=False, refs=True, walk=True) -> str:
        s, out = self.s, self.out
        me = out.node(
            f"{cls}.{name}" if cls else name, name, kind, span, parent_id=parent, parent_class=cls, typed_parameters=self.parameters(*args), return_type=ret, signature=s.slice(i, last).split("\n", 1)[0].strip(),
            calls=unique(c for c, _ in self.calls_in(*body, nested=False)), ref_names=self.references(*body) if refs else [], is_exported=exported,
        )
        for raw, at in self.calls_in(*body, nested=True):
            out.call(me, raw, s.line(at), s.col(at), method_edges)
        if walk:
            self.statements(*body, parent=me, cls=None if method_edges else cls)
        return me

    def arrow_function(self, i: int, last: int, found: tuple[int, int], name: str, parent: str, cls: str | None, exported: bool, decl: int) -> None:
        s = self.s
        first, mark = found
        args = (first + 1, s.close(first)) if s.at(first) == "(" else (first, first + 1)
        ret = None
        if s.at(first) == "(" and s.at(s.close(first) + 1) == ":":
            ret = s.slice(s.close(first) + 2, mark).strip()
        block = s.at(mark + 1) == "{"
        body = (mark + 2, s.close(mark + 1)) if block else (mark + 1, last)
        line = s.line(s.tokens[decl].start)
        span = s.span(i, last)
        self.callable_(name, "lambda" if cls else "function", i, last, args, body, ret, parent, cls, exported, (line, *span[1:]), walk=block)

    def class_(self, i: int, stop: int, parent: str, exported: bool = False) -> int:
        s, out, k = self.s, self.out, i + 1
        name = s.at(k) if s.tokens[k].kind == "name" and s.at(k) not in ("extends", "implements") else "<anonymous>"
        k += name != "<anonymous>"
        types = ""
        if s.at(k) == "<":
            e = k
            depth = 0
            while e < stop:
                depth += (s.at(e) == "<") - (s.at(e) == ">")
                e += 1
                if not depth:
                    break
            types, k = s.slice(k, e), e
        bases = []
        while k < stop and s.at(k) != "{":
            if s.at(k) == "extends":
                e = k + 2
                while s.at(e) == ".":
                    e += 2
                bases.append(s.slice(k + 1, e).strip())
                k = e - 1
            elif s.at(k) == "(":
                k = s.close(k)
            k += 1
        last = s.close(k) + 1
        decorators = []
        d = i - 1
        while d >= 0 and (s.at(d).startswith("@") or s.at(d) == ")" and s.at(s.partner.get(d, 0) - 1).startswith("@")):
            a = d if s.at(d).startswith("@") else s.partner[d] - 1
            decorators.insert(0, s.slice(a, d + 1))
            d = a - 1
        me = out.node(name, name, "class", s.span(i, last), parent_id=parent, bases=bases, decorators=decorators, signature=f"class {name}{types}" + (f" extends {bases[0]}" if bases else ""), is_exported=exported)
        for b in bases:
            out.inherit(me, b)
        k += 1
        while k < last - 1:
            k = self.member(k, last - 1, me, name)
        return last

    def member(self, i: int, stop: int, parent: str, cls: str) -> int:
        s, k = self.s, i
        while s.at(k) in _MODIFIERS and s.at(k + 1) not in ("(", "=", ";", ":"):
            k += 1
        k += s.at(k) == "*"
        name_at = k
        if s.at(k) == "[":
            k = s.close(k)
        k += 1
        k += s.at(k) in ("?", "!")
        if s.at(k) == "<":
            k = next((x for x in range(k, stop) if s.at(x) == "("), stop)
        if s.at(k) != "(" or s.tokens[name_at].kind not in ("name", "string", "number") and s.at(name_at) != "[":
            return max(i + 1, self.end(i, stop))
        body, ret = s.close(k) + 1, None
        if s.at(body) == ":":
            e = self.skip_type(body + 1, stop)
            ret, body = s.slice(body + 1, e).strip(), e
        if s.at(body) != "{":
            return max(i + 1, self.end(i, stop))
        last = s.close(body) + 1
        name = s.slice(name_at, name_at + 1) if s.at(name_at) != "[" else s.slice(name_at, s.close(name_at) + 1)
        kind = "constructor" if name == "constructor" else "method"
        self.callable_(name, kind, i, last, (k + 1, s.close(k)), (body + 1, last - 1), ret, parent, cls, True, s.span(i, last), method_edges=True, refs=False, walk=False)
        return last

    def interface(self, i: int, stop: int, parent: str) -> int:
        s, out = self.s, self.out
        name, k = s.at(i + 1), i + 2
        while k < stop and s.at(k) not in ("extends", "{"):
            k += 1
        types, bases = s.slice(i + 2, k), []
        if s.at(k) == "extends":
            e = next((x for x in range(k, stop) if s.at(x) == "{"), stop)
            bases = [re.sub(r"<.*", "", s.slice(a, b), flags=re.S).strip() for a, b in s.split(k + 1, e)]
            k = e
        last = s.close(k) + 1
        me = out.node(name, name, "interface", s.span(i, last), parent_id=parent, bases=bases, signature=f"interface {name}{types}" + (f" extends {', '.join(bases)}" if bases else ""))
        for b in bases:
            out.inherit(me, b)
        return last

    def variables(self, i: int, stop: int, parent: str, cls: str | None, exported: bool = False) -> int:
        s, out = self.s, self.out
        last = self.end(i, stop)
        tail = last - (s.at(last - 1) == ";")
        for a, b in s.split(i + 1, tail):
            eq = next((k for k in self.flat(a, b) if s.at(k) == "=" and s.tokens[k].kind == "op"), None)
            if eq is None or eq + 1 >= b or s.at(eq + 1) == "require" and s.at(eq + 2) == "(":
                continue
            name = s.slice(a, a + 1) if s.at(a) not in ("{", "[") else s.slice(a, s.close(a) + 1)
            v = eq + 1
            if found := self.arrow(v, b):
                self.arrow_function(v, b, found, name, parent, cls, exported, i)
            elif self.is_function(v):
                self.function(v, b, parent, cls, exported, name)
            elif s.at(v) == "[" and not exported:
                items = [s.at(x) for x, y in s.split(v + 1, s.close(v)) if y - x == 1 and s.tokens[x].kind == "name"]
                out.node(name, name, "assignment", s.span(i, last), parent_id=parent, signature=s.slice(i, last).split("\n", 1)[0].strip(), ref_names=[x for x in items if x not in ("true", "false", "null", "undefined", "this", "const", "let", "var")], is_exported=exported)
            elif exported and b > v and s.at(b - 1) == ")" and s.tokens[v].kind == "name":
                self.wrapped(v, b, name, parent, True, i)
        return last

    def wrapped(self, i: int, j: int, name: str, parent: str, stub: bool, decl: int) -> None:
        """A call around a function, as components are wrapped: the innermost function takes the name."""
        s = self.s
        k = next((x for x in range(i, j) if s.at(x) == "("), None)
        while k is not None:
            args = s.split(k + 1, s.close(k))
            if not args:
                break
            a, b = args[0]
            if found := self.arrow(a, b):
                self.arrow_function(a, b, found, name, parent, None, True, decl)
                return
            if self.is_function(a):
                own = s.at(a + 1 + (s.at(a) == "async"))
                self.function(a, b, parent, None, True, name if name != "<default>" or own == "(" else own)
                return
            if b - a == 1 and s.tokens[a].kind == "name":
                if stub:
                    break
                self.mark([s.at(a)])
                return
            k = next((x for x in range(a, b) if s.at(x) == "("), None) if s.tokens[a].kind == "name" else None
        if stub:
            self.out.node(name, name, "function", s.span(decl, j), parent_id=parent, signature=s.slice(decl, j)[:120].split("\n")[0], is_exported=True)

    def mark(self, names: list[str]) -> None:
        for n in self.out.nodes:
            if n["name"] in names:
                n["is_exported"] = True

    def export(self, i: int, stop: int, parent: str) -> int:
        s, k = self.s, i + 1
        default = s.at(k) == "default"
        k += default
        k += s.at(k) in ("abstract", "declare") and s.tokens[k + 1].kind == "name"
        if s.at(k) == "class":
            return self.class_(k, stop, parent, True)
        if self.is_function(k):
            return self.function(k, stop, parent, None, True)
        if s.at(k) in ("const", "let", "var") and not (s.at(k + 1) == "enum"):
            return self.variables(k, stop, parent, None, True)
        if s.at(k) == "interface":
            return self.interface(k, stop, parent)
        if s.at(k) == "enum" or s.at(k) == "const" and s.at(k + 1) == "enum":
            return self.enum(k, stop, parent)
        if s.at(k) == "type" and s.tokens[k + 1].kind == "name":
            return self.alias(k, stop, parent)
        last = self.end(i, stop)
        tail = last - (s.at(last - 1) == ";")
        if default and found_name(s, k, tail):
            self.mark([s.at(k)])
        elif default and (found := self.arrow(k, tail)):
            self.arrow_function(k, tail, found, "<default>", parent, None, True, i)
        elif default and s.at(tail - 1) == ")":
            self.wrapped(k, tail, "<default>", parent, False, k)
        return last

    def enum(self, i: int, stop: int, parent: str) -> int:
        s = self.s
        k = i + (s.at(i) == "const")
        b = next((x for x in range(k, stop) if s.at(x) == "{"), stop)
        last = s.close(b) + 1
        self.out.node(s.at(k + 1), s.at(k + 1), "enum", s.span(i, last), parent_id=parent, signature=s.slice(i, last).split("\n", 1)[0].strip())
        return last

    def alias(self, i: int, stop: int, parent: str) -> int:
        s = self.s
        last = self.end(i, stop)
        eq = next((k for k in range(i, last) if s.at(k) == "="), last)
        value = s.slice(eq + 1, last - (s.at(last - 1) == ";")).strip()
        self.out.node(s.at(i + 1), s.at(i + 1), "type_annotation", s.span(i, last), parent_id=parent, value=value, signature=f"type {s.slice(i + 1, eq).strip()} = {value}")
        return last

    def expression(self, i: int, stop: int, parent: str) -> int:
        s, out = self.s, self.out
        last = self.end(i, stop)
        tail = last - (s.at(last - 1) == ";")
        eq = next((k for k in self.flat(i, tail) if s.at(k) == "=" and s.tokens[k].kind == "op"), None)
        if eq is not None and eq + 1 < tail:
            left = s.slice(i, eq)
            v = eq + 1 + (s.at(eq + 1) == "await")
            name = None
            if left.startswith("exports.") and left.count(".") >= 1:
                name = left.split(".", 1)[1].strip() or None
            elif "module.exports" in left:
                name = (left.rsplit(".", 1)[-1].strip() if left.count(".") >= 2 else None) or "<anonymous>"
                if found_name(s, v, tail):
                    self.mark([s.at(v)])
                if s.at(v) == "class":
                    self.class_(v, tail, parent, True)
            if name:
                if found := self.arrow(v, tail):
                    self.arrow_function(v, tail, found, name, parent, None, True, i)
                elif self.is_function(v):
                    self.function(v, tail, parent, None, True, None if name == "<anonymous>" else name)
        for raw, at in self.calls_in(i, tail, True):
            out.call(parent, raw, s.line(at), s.col(at))
        return last

    def statements(self, i: int, stop: int, parent: str, cls: str | None) -> None:
        """Definitions, exports, declarations and expressions directly in a block."""
        s, k = self.s, i
        while k < min(stop, len(s.tokens)):
            t = s.at(k)
            if t == "class" or t == "abstract" and s.at(k + 1) == "class":
                k = self.class_(k + (t == "abstract"), stop, parent)
            elif self.is_function(k):
                k = self.function(k, stop, parent, cls)
            elif t == "export":
                k = self.export(k, stop, parent)
            elif t in ("const", "let", "var") and s.at(k + 1) != "enum":
                k = self.variables(k, stop, parent, cls)
            elif self.ts and t == "interface" and s.tokens[k + 1].kind == "name":
                k = self.interface(k, stop, parent)
            elif self.ts and (t == "enum" or t == "const" and s.at(k + 1) == "enum"):
                k = self.enum(k, stop, parent)
            elif self.ts and t == "type" and s.tokens[k + 1].kind == "name" and s.at(k + 2) in ("=", "<"):
                k = self.alias(k, stop, parent)
            elif t in ("if", "for", "while", "switch", "with", "catch"):
                # Only what stands directly in a block counts: what they control is passed over.
                k = s.close(k + 1 + (s.at(k + 1) == "await")) + 1
                k = s.close(k) + 1 if s.at(k) == "{" else k if s.at(k) in ("if", "for", "while") else self.end(k, stop)
            elif t in ("else", "try", "do", "finally"):
                k = s.close(k + 1) + 1 if s.at(k + 1) == "{" else k + 1
            elif t == "{":
                k = s.close(k) + 1
            elif t in ("import", "return", "throw", "break", "continue") or t.startswith("@"):
                k = s.close(k + 1) + 1 if t.startswith("@") and s.at(k + 1) == "(" else k + 1 if t.startswith("@") else self.end(k, stop)
            elif t in (";", "}", ")", "]"):
                k += 1
            else:
                k = max(k + 1, self.expression(k, stop, parent))


def found_name(s: Scan, i: int, j: int) -> bool:
    return j - i == 1 and s.tokens[i].kind == "name"


def extract(text: str, path: str, repo: str) -> Emitted:
    ts = path.rpartition(".")[2].lower() in ("ts", "tsx", "mts", "cts")
    out = Emitted(repo, path, "typescript" if ts else "javascript")
    s = Scan(text)
    r = _Reader(s, out, ts)
    module = out.make_id("__module__", 1)
    n = len(s.tokens)
    imports: list[str] = []
    later: list[tuple] = []
    for k in range(n):
        # require calls anywhere: their targets are imports of the module.
        if s.at(k) == "require" and s.tokens[k].kind == "name" and s.at(k + 1) == "(" and s.at(k - 1) not in (".", "?."):
            target = next((s.at(x).strip("'\"`") for x in range(k + 2, s.close(k + 1)) if s.tokens[x].kind in ("string", "template")), None)
            if target:
                imports.append(target)
            later.append((k, target))
    k = 0
    tops = []
    while k < n:
        if s.at(k) == "import" and s.at(k + 1) not in ("(", "."):
            e = r.end(k, n)
            shown = s.slice(k, e).strip()
            imports.append(shown)
            tops.append(("import", k, e, shown))
            k = e
        elif s.at(k) in ("const", "let", "var"):
            e = r.end(k, n)
            tops.append(("var", k, e, s.slice(k, e).strip()))
            k = e
        else:
            k = s.close(k) + 1 if s.at(k) in ("(", "[", "{") and s.tokens[k].kind == "op" else k + 1
    calls = [c for c, _ in r.calls_in(0, n, True)]
    out.node("__module__", path, "module", (1, text.count("\n") + 1, 0, 0), imports=imports, calls=unique(calls), ref_names=r.references(0, n))
    for kind, a, b, shown in tops:
        if kind == "import":
            out.node(shown[:40], shown, "import", s.span(a, b), parent_id=module, imports=[shown])
            out.import_(import_target(shown), s.line(s.tokens[a].start))
    declared = set()
    for kind, a, b, shown in tops:
        if kind != "var":
            continue
        for x, y in s.split(a + 1, b - (s.at(b - 1) == ";")):
            hit = next((t for t in later if x < t[0] < y and s.at(t[0] - 1) == "=" and s.close(t[0] + 1) == y - 1), None)
            if hit:
                declared.add(hit[0])
                name = (hit[1] or s.slice(x, s.close(x) + 1)) if s.at(x) == "{" else s.at(x)
                out.node(name[:40], name, "require", s.span(a, b), parent_id=module, imports=[shown])
                out.import_(hit[1], s.line(s.tokens[a].start))
    for at, target in later:
        if at in declared:
            continue
        end = s.close(at + 1) + 1
        if s.at(end) == "." and s.at(end + 2) == "(" and (at == 0 or s.tokens[at].fresh):
            raw, stop = s.slice(at, s.close(end + 2) + 1), s.close(end + 2) + 1
        elif s.at(at - 1) in ("(", ",") and s.at(end) in (")", ","):
            raw, stop = s.slice(at, end), end
        else:
            continue
        out.node(raw[:40], raw, "require", s.span(at, stop), parent_id=module, imports=[raw])
        out.import_(target, s.line(s.tokens[at].start))
    r.statements(0, n, module, None)
    out.link_children()
    return out
