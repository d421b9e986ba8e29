"""JavaScript with JSX, and TypeScript."""

from __future__ import annotations

import re

from codeweft.llm.parsing.base import BAD, INNER, Parser, Shaper, Stmt, SyntaxFault, ident_pattern, inner, levels, words

KEYWORDS = words(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false"
)
#: Words with a meaning in some places and names elsewhere.
CONTEXTUAL = words(
    "let static async await yield of get set as from type interface enum namespace module declare abstract public private protected readonly override implements is keyof infer satisfies asserts global accessor constructor unique require out"
)
_NAMES = CONTEXTUAL | {"n"}
_WORDS = KEYWORDS | _NAMES

#: Stands for `${` in a template: a dollar would read as a name.
HOLE = "\x03"
_IDENT = ident_pattern(KEYWORDS | CONTEXTUAL, dollar=True)
_NUMBER = re.compile(r"(?<![\w$.])(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$])")
_BAD_NUMBER = re.compile(r"(?<![\w$])\d[\w$]*")
_SCAN = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|["'`/\x01\x02]|[{}]""", re.DOTALL)
_SCAN_JSX = re.compile(_SCAN.pattern + "|<(?=[A-Za-z>])", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TOKEN = re.compile(r"=>|\.\.\.|===|!==|==|!=|\*\*=|\*\*|\+\+|--|\+=|-=|\*=|/=|%=|&&=|\|\|=|\?\?=|<<=|<<|<=|&&|\|\||\?\?|\?\.(?!\d)|&=|\|=|\^=|[A-Za-z]+|\S")
#: After these an expression begins, so `/` opens a regular expression and `<` an element.
_BEFORE_VALUE = re.compile(r"(?:^|[(\[{,;=:?!&|+\-*%^~<>]|(?<![\w$.])(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await|default))$")


def shape(text: str, jsx: bool) -> str:
    out: list[str] = []
    _scan(text, 0, jsx, out, False)
    s = _IDENT.sub("n", "".join(out))
    s = _NUMBER.sub("0", s)
    return _BAD_NUMBER.sub(lambda m: "0" if m[0] == "0" else BAD, s)


def _value_next(text: str, at: int) -> bool:
    """Does an expression begin at `at`, judged by what stands before it?"""
    before = text[max(0, at - 80) : at].rstrip()
    return bool(_BEFORE_VALUE.search(before)) and not before.endswith(("++", "--"))


def _scan(text: str, pos: int, jsx: bool, out: list[str], inside: bool) -> int:
    """Replace comments, strings, templates and elements; with `inside` up to the brace that closes an expression."""
    find = (_SCAN_JSX if jsx else _SCAN).search
    depth = 0
    while m := find(text, pos):
        at, s = m.start(), m[0]
        out.append(text[pos:at])
        pos, c = m.end(), s[0]
        if c == "/":
            if len(s) > 1:
                out.append(" " + "\n" * s.count("\n"))
            elif (r := _REGEX.match(text, at)) and _value_next(text, at):
                out.append('"')
                pos = r.end()
            else:
                out.append("/" if text[at : at + 2] != "/*" else BAD)
        elif len(s) > 1:
            out.append('"' + inner(s))
        elif c == "{":
            depth += 1
            out.append(c)
        elif c == "}":
            if inside and not depth:
                return at
            depth -= 1
            out.append(c)
        elif c == "`":
            pos = _template(text, pos, jsx, out)
        elif c == "<":
            if _value_next(text, at) and (end := _element(text, at, out)) is not None:
                pos = end
            else:
                out.append(c)
        else:
            out.append(BAD)
    out.append(text[pos:])
    return len(text)


_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)


def _template(text: str, pos: int, jsx: bool, out: list[str]) -> int:
    out.append("`")
    while True:
        m = _TEXT.match(text, pos)
        out.append(inner(m[0]))
        pos = m.end()
        if text[pos : pos + 1] == "`":
            out.append("`")
            return pos + 1
        if text[pos : pos + 2] != "${":
            out.append(BAD)
            return pos + 1
        out.append(HOLE)
        part: list[str] = []
        end = _scan(text, pos + 2, jsx, part, True)
        out.append("".join(part).replace("\n", INNER))
        out.append("}")
        pos = end + 1


_TAG = re.compile(r"<\s*([A-Za-z_$][\w$.:-]*)?")
_ATTR = re.compile(r"""\s*(?:[A-Za-z_$][\w$:-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?=\{)))?|(?=\{))""")


def _element(text: str, at: int, out: list[str]) -> int | None:
    """Read an element from `<` on; a value in its place is written to `out`. None when it isn't one."""
    holes: list[str] = []

    def braces(pos: int) -> int:
        part: list[str] = []
        end = _scan(text, pos + 1, True, part, True)
        if "".join(part).strip() not in ("", BAD):
            holes.append("".join(part).strip().removeprefix("...").replace("\n", INNER))
        return end + 1

    def element(pos: int) -> int | None:
        m = _TAG.match(text, pos)
        name, pos = m[1], m.end()
        while True:
            m = _ATTR.match(text, pos)
            if not m:
                break
            pos = m.end()
            if text[pos : pos + 1] == "{":
                pos = braces(pos)
            elif m.end() == m.start():
                break
        end = re.compile(r"\s*(/?)>").match(text, pos)
        if not end:
            return None
        pos = end.end()
        if end[1]:
            return pos
        while pos < len(text):
            c = text[pos]
            if c == "{":
                pos = braces(pos)
            elif c == "<":
                close = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, pos)
                if close:
                    return close.end() if close[1] == name else None
                pos = element(pos)
                if pos is None:
                    return None
            elif c in "}>":
                return None
            else:
                pos += 1
        return None

    end = element(at)
    if end is None:
        return None
    out.append('"' if not holes else "[" + ",".join(f"({h})" for h in holes) + "]")
    out.append(INNER * text.count("\n", at, end))
    return end


_BINARY = {
    "??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, "instanceof": 7, "in": 7,
    "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11,
}
_ASSIGN = words("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=")
_PREFIX = words("! ~ + - typeof void delete ++ --")
#: A line beginning with one of these goes on with the expression before.
_GOES_ON = frozenset(_BINARY) | _ASSIGN | words(". ?. ( [ ` ? : => , ) ]")


class Script(Parser):
    name = "javascript"
    ts = False
    sync = words("; } function class const let var if for while do switch try return throw import export interface type enum")

    def k(self) -> str:
        t = self.t[self.i]
        while t == "\n" or t.__class__ is Stmt:
            if t == "\n":
                self.i += 1
            else:
                self.t[self.i : self.i + 1] = t.raw
            t = self.t[self.i]
        return t

    def at(self, n: int) -> str:
        """The n-th token after the current one."""
        j = self.i + 1
        while True:
            t = self.t[j] if j < len(self.t) else ""
            if t == "\n":
                j += 1
                continue
            if t.__class__ is Stmt:
                self.t[j : j + 1] = t.raw
                continue
            n -= 1
            if n <= 0 or t == "":
                return t
            j += 1

    def newline(self) -> bool:
        return self.t[self.i] == "\n"

    def end(self) -> None:
        """The end of a statement, written or implied."""
        t = self.t[self.i]
        if t == "\n":
            if self.k() == ";":
                self.i += 1
            return
        t = self.k()
        if t == ";":
            self.i += 1
        elif t not in ("}", "") and self.t[self.i - 1] not in ("}", "\n"):
            self.fail("expected ';'")

    def ident(self) -> None:
        if self.k() not in _NAMES:
            self.fail("expected a name")
        self.i += 1

    # --- file and statements

    def file(self) -> None:
        while self.k0() != "":
            self.guarded(self.statement)

    def k0(self):
        t = self.t[self.i]
        while t == "\n":
            self.i += 1
            t = self.t[self.i]
        return t

    def simple_only(self) -> None:
        """For pieces: nothing but whole simple statements."""
        while self.k() != "":
            if self.k() in ("if", "for", "while", "do", "switch", "try", "else", "case", "default", "{", "function", "class", "static", "get", "set", "async", "public", "private", "protected", "readonly", "abstract", "declare", "type", "interface", "enum"):
                self.fail("not simple")
            self.statement()
            if self.t[self.i - 1] != ";":
                self.fail("not simple")

    def block(self) -> None:
        self.need("{")
        while (t := self.k0()) != "}":
            if t == "":
                self.fail("expected '}'")
            self.guarded(self.statement)
        self.i += 1

    def statement(self) -> None:
        t = self.k0()
        if t.__class__ is Stmt:
            self.i += 1
            return
        rule = _STATEMENTS.get(t)
        if rule:
            rule(self)
        elif t in _NAMES:
            self.named_statement(t)
        else:
            self.expression()
            self.end()

    def named_statement(self, t: str) -> None:
        n = self.at(1)
        if n == ":" :
            self.i += 1
            self.need(":")
            self.statement()
        elif t == "let" and (n in _NAMES or n in "[{" and n) and n not in ("in", "instanceof", "of"):
            self.declaration()
        elif t == "async" and n == "function":
            self.i += 1
            self.function()
        elif self.ts and self.ts_statement(t, n):
            pass
        else:
            self.expression()
            self.end()

    def ts_statement(self, t: str, n: str) -> bool:
        if t == "type" and n in _NAMES:
            self.i += 1
            self.ident()
            self.type_params()
            self.need("=")
            self.type_()
            self.end()
        elif t == "interface" and n in _NAMES:
            self.i += 1
            self.ident()
            self.type_params()
            if self.take("extends"):
                self.type_()
                while self.take(","):
                    self.type_()
            self.object_type()
        elif t == "enum" and n in _NAMES:
            self.i += 1
            self.enum()
        elif t in ("namespace", "module") and (n in _NAMES or n == '"'):
            self.i += 2
            while self.take("."):
                self.ident()
            self.block()
        elif t == "global" and n == "{":
            self.i += 1
            self.block()
        elif t == "declare" and (n in KEYWORDS or n in _NAMES):
            self.i += 1
            self.statement()
        elif t == "abstract" and n == "class":
            self.i += 1
            self.class_()
        else:
            return False
        return True

    def enum(self) -> None:
        self.ident()
        self.need("{")
        while self.k() != "}":
            if self.k() == '"' or self.k() in _WORDS:
                self.i += 1
            else:
                self.fail("expected a name")
            if self.take("="):
                self.assign()
            if not self.take(","):
                break
        self.need("}")

    def declaration(self, in_for: bool = False) -> None:
        const = self.k() == "const"
        self.i += 1
        if const and self.ts and self.k() == "enum":
            self.i += 1
            self.enum()
            return
        while True:
            pattern = self.k() in ("[", "{")
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                self.assign(no_in=in_for)
            elif (pattern or const and not self.ts) and not (in_for and self.k() in ("of", "in")):
                self.fail("expected a value")
            if not self.take(","):
                break
        if not in_for:
            self.end()

    def binding(self) -> None:
        t = self.k()
        if t == "[":
            self.i += 1
            while self.k() != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assign()
                if self.k() != "]":
                    self.need(",")
            self.i += 1
        elif t == "{":
            self.i += 1
            while self.k() != "}":
                if self.take("..."):
                    self.binding()
                else:
                    t = self.k()
                    self.key()
                    if self.take(":"):
                        self.binding()
                    elif t not in _NAMES:
                        self.fail("expected ':'")
                    if self.take("="):
                        self.assign()
                if self.k() != "}":
                    self.need(",")
            self.i += 1
        else:
            self.ident()

    def key(self) -> None:
        t = self.k()
        if t == "[":
            self.i += 1
            self.assign()
            self.need("]")
        elif t in _WORDS or t in ('"', "0"):
            self.i += 1
        elif t == "#":
            self.i += 1
            self.ident()
        else:
            self.fail("expected a property name")

    def s_var(self) -> None:
        self.declaration()

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.k0() == "else":
            self.i += 1
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        t = self.k()
        if t in ("const", "var") or t == "let" and (self.at(1) in _NAMES or self.at(1) in ("[", "{")):
            self.declaration(True)
        elif t != ";":
            self.expression(True)
        if self.take("of"):
            self.assign()
        elif self.take("in"):
            self.expression()
        else:
            self.need(";")
            if self.k() != ";":
                self.expression()
            self.need(";")
            if self.k() != ")":
                self.expression()
        self.need(")")
        self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        if self.k0() == ";":
            self.fail("expected 'while'")
        self.need("while")
        self.condition()
        self.take(";")

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while self.k() != "}":
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.k0() not in ("case", "default", "}", ""):
                self.guarded(self.statement)
        self.i += 1

    def s_try(self) -> None:
        self.i += 1
        self.block()
        if self.k() == "catch":
            self.i += 1
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type_()
                self.need(")")
            self.block()
            if self.take("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def s_jump(self) -> None:
        """return, break, continue: what follows on the same line."""
        self.i += 1
        if self.t[self.i] not in (";", "\n", "}", ""):
            self.expression()
        self.end()

    def s_throw(self) -> None:
        self.i += 1
        if self.newline():
            self.fail("expected a value on the same line")
        self.expression()
        self.end()

    def s_empty(self) -> None:
        self.i += 1

    def s_debugger(self) -> None:
        self.i += 1
        self.end()

    def s_function(self) -> None:
        self.function()

    def s_class(self) -> None:
        self.class_()

    def s_decorated(self) -> None:
        while self.take("@"):
            self.postfix()
        if self.k() == "export":
            self.i += 1
            self.take("default")
        self.take("abstract")
        if self.k() != "class":
            self.fail("expected a class")
        self.class_()

    def s_import(self) -> None:
        if self.at(1) in ("(", "."):
            self.expression()
            self.end()
            return
        self.i += 1
        if self.take('"'):
            self.attributes()
            return
        if self.k() == "type" and self.at(1) not in ("from", ",") and (self.at(1) in _NAMES or self.at(1) in ("{", "*")):
            if not self.ts:
                self.fail("types can't be imported")
            self.i += 1
        if self.k() in _NAMES:
            self.i += 1
            if self.ts and self.take("="):
                self.expression()
                self.end()
                return
            if self.k() == ",":
                self.i += 1
                self.imported()
        else:
            self.imported()
        self.need("from")
        self.need('"')
        self.attributes()

    def attributes(self) -> None:
        if self.t[self.i] == "with":
            self.i += 1
            self.primary()
        self.end()

    def imported(self) -> None:
        if self.take("*"):
            self.need("as")
            self.ident()
        else:
            self.specifiers()

    def specifiers(self) -> None:
        self.need("{")
        while self.k() != "}":
            if self.ts and self.k() == "type" and self.at(1) in _WORDS and self.at(1) != "as":
                self.i += 1
            if self.k() not in _WORDS and self.k() != '"':
                self.fail("expected a name")
            self.i += 1
            if self.take("as"):
                if self.k() not in _WORDS and self.k() != '"':
                    self.fail("expected a name")
                self.i += 1
            if not self.take(","):
                break
        self.need("}")

    def s_export(self) -> None:
        self.i += 1
        t = self.k()
        if t == "default":
            self.i += 1
            t = self.k()
            if t == "function" or t == "async" and self.at(1) == "function":
                self.take("async")
                self.function(False)
            elif t == "class" or t == "abstract" and self.at(1) == "class":
                self.take("abstract")
                self.class_(False)
            elif self.ts and t == "interface":
                self.statement()
            else:
                self.assign()
                self.end()
        elif t == "*":
            self.i += 1
            if self.take("as"):
                self.i += 1
            self.need("from")
            self.need('"')
            self.attributes()
        elif t == "{" or self.ts and t == "type" and self.at(1) in ("{", "*"):
            self.take("type")
            if self.take("*"):
                pass
            else:
                self.specifiers()
            if self.take("from"):
                self.need('"')
                self.attributes()
            else:
                self.end()
        elif self.ts and t == "=":
            self.i += 1
            self.expression()
            self.end()
        elif t in ("const", "var", "let", "function", "class", "async", "@") or self.ts and t in ("type", "interface", "enum", "namespace", "module", "declare", "abstract", "import"):
            self.statement()
        else:
            self.fail("expected a declaration")

    # --- functions and classes

    def function(self, named: bool = True) -> None:
        self.need("function")
        self.take("*")
        if named or self.k() != "(":
            self.ident()
        self.signature()
        self.body()

    def body(self) -> None:
        """A block; in TypeScript also none, for overloads and declarations."""
        if self.ts and self.t[self.i] in (";", "\n"):
            self.i += 1
            if self.t[self.i - 1] == "\n" and self.k0() == "{":
                self.block()
            return
        self.block()

    def signature(self) -> None:
        if self.ts:
            self.type_params()
        self.params()
        if self.ts and self.take(":"):
            self.return_type()

    def params(self) -> None:
        self.need("(")
        while self.k() != ")":
            while self.take("@"):
                self.postfix()
            if self.ts:
                while self.k() in ("public", "private", "protected", "readonly", "override") and (self.at(1) in _NAMES or self.at(1) in "[{"):
                    self.i += 1
            rest = self.take("...")
            if self.ts and self.k() == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                if rest:
                    self.fail("a rest parameter has no default")
                self.assign()
            if rest and self.k() != ")":
                self.fail("a rest parameter must be last")
            if not self.take(","):
                break
        self.need(")")

    def class_(self, named: bool = True) -> None:
        self.need("class")
        if self.k() in _NAMES and self.k() != "implements":
            self.i += 1
        elif named:
            self.fail("expected a name")
        if self.ts:
            self.type_params()
        if self.take("extends"):
            self.postfix()
            if self.ts and self.k() == "<":
                self.type_args()
        if self.ts and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        while (t := self.k()) != "}":
            if t == "":
                self.fail("expected '}'")
            self.guarded(self.member)
        self.i += 1

    def member(self) -> None:
        if self.take(";"):
            return
        while self.take("@"):
            self.postfix()
        mods = words("static async get set accessor") | (words("public private protected readonly abstract override declare") if self.ts else frozenset())
        while (t := self.k()) in mods and self.at(1) not in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
            if t == "static" and self.at(1) == "{":
                self.i += 1
                self.block()
                return
            if self.t[self.i + 1] == "\n":
                break
            self.i += 1
        self.take("*")
        if self.ts and self.k() == "[" and self.at(1) in _NAMES and self.at(2) == ":":
            self.i += 2
            self.need(":")
            self.type_()
            self.need("]")
            self.need(":")
            self.type_()
            self.end()
            return
        self.key()
        if self.ts and self.k() in ("?", "!"):
            self.i += 1
        if self.k() == "(" or self.ts and self.k() == "<":
            self.signature()
            self.body()
            return
        if self.ts and self.take(":"):
            self.type_()
        if self.take("="):
            self.assign()
        self.end()

    # --- expressions

    def expression(self, no_in: bool = False) -> None:
        self.assign(no_in)
        while self.more(","):
            self.i += 1
            self.assign(no_in)

    def more(self, t: str) -> bool:
        if self.t[self.i] == "\n":
            if self.peek_line() != t:
                return False
            self.k()
            return True
        return self.k() == t

    def peek_line(self) -> str:
        """The first token of the lines to come."""
        j = self.i
        while self.t[j] == "\n":
            j += 1
        t = self.t[j]
        return t.raw[0] if t.__class__ is Stmt else t

    def on(self) -> str:
        """The current token if the expression can go on with it, else ''."""
        if self.t[self.i] == "\n":
            t = self.peek_line()
            if t in _GOES_ON:
                return self.k()
            return ""
        return self.k()

    def assign(self, no_in: bool = False) -> None:
        t = self.k()
        if t in _NAMES and self.arrow_name(t):
            pass
        elif t == "(" and self.arrow_ahead() or self.ts and t == "<" and self.generic_arrow():
            pass
        elif t == "yield" and self.at(1) not in _ASSIGN:
            self.i += 1
            if self.t[self.i] not in (")", "]", "}", ",", ";", "\n", ""):
                self.take("*")
                self.assign(no_in)
        else:
            target = self.ternary(no_in)
            op = self.on()
            if op in _ASSIGN:
                if not target:
                    self.fail("can't assign to this")
                self.i += 1
                self.assign(no_in)
            elif op == ">" and self.t[self.i + 1] == ">" and self.shift_assign():
                self.assign(no_in)

    def shift_assign(self) -> bool:
        j = self.i
        while self.t[j] == ">":
            j += 1
        if self.t[j] == "=" and j - self.i <= 3:
            self.i = j + 1
            return True
        return False

    def arrow_name(self, t: str) -> bool:
        n = self.t[self.i + 1]
        if n == "=>":
            self.i += 2
        elif t == "async" and n in _NAMES and self.t[self.i + 2] == "=>":
            self.i += 3
        elif t == "async" and (n == "(" or self.ts and n == "<"):
            at = self.i
            self.i += 1
            if n == "(" and self.arrow_ahead() or n == "<" and self.generic_arrow():
                return True
            self.i = at
            return False
        else:
            return False
        self.arrow_body()
        return True

    def arrow_body(self) -> None:
        if self.k() == "{":
            self.block()
        else:
            self.assign()

    def arrow_ahead(self) -> bool:
        """Read an arrow function from `(` on, if it is one."""
        if self.at(1) == "(":
            return False
        j, depth, t = self.i, 0, self.t
        while True:
            x = t[j]
            if x == "(" or x == "[" or x == "{":
                depth += 1
            elif x == ")" or x == "]" or x == "}":
                depth -= 1
                if not depth:
                    break
            elif x == "":
                return False
            elif x.__class__ is Stmt and not depth:
                return False
            j += 1
        n = t[j + 1]
        if n == "=>":
            self.params()
            self.need("=>")
            self.arrow_body()
            return True
        if self.ts and n == ":":
            at = self.i
            try:
                self.params()
                self.need(":")
                self.return_type()
                if self.k() != "=>":
                    raise SyntaxFault("")
            except SyntaxFault:
                self.i = at
                return False
            self.i += 1
            self.arrow_body()
            return True
        return False

    def generic_arrow(self) -> bool:
        at = self.i
        try:
            self.signature()
            self.need("=>")
        except SyntaxFault:
            self.i = at
            return False
        self.arrow_body()
        return True

    def ternary(self, no_in: bool) -> bool:
        target = self.binary(1, no_in)
        if self.on() == "?":
            self.i += 1
            self.assign()
            self.need(":")
            self.assign(no_in)
            return False
        return target

    def binary(self, least: int, no_in: bool) -> bool:
        target = self.unary()
        while True:
            op = self.on()
            p = _BINARY.get(op, 0)
            if self.ts and op in ("as", "satisfies") and least <= 7 and not self.newline():
                self.i += 1
                if not self.take("const"):
                    self.type_()
                continue
            if p < least or op == "in" and no_in:
                return target
            if op == ">" and self.t[self.i + 1] == ">":
                j = self.i
                while self.t[j] == ">":
                    j += 1
                if self.t[j] == "=" and j - self.i <= 3:
                    return target
                if least > 8 or j - self.i > 3:
                    if j - self.i > 3:
                        self.fail("unknown operator")
                    return target
                self.i, p = j, 8
            elif op == ">" and self.t[self.i + 1] == "=":
                self.i += 2
            else:
                self.i += 1
            self.binary(p if op == "**" else p + 1, no_in)
            target = False

    def unary(self) -> bool:
        t = self.k()
        if t in _PREFIX or t == "await" and self.t[self.i + 1] not in (")", ";", ",", "=", ".", "]", "\n", "}"):
            self.i += 1
            target = self.unary()
            if t in ("++", "--") and not target:
                self.fail("can't count this up or down")
            return False
        target = self.postfix()
        if self.t[self.i] in ("++", "--"):
            if not target:
                self.fail("can't count this up or down")
            self.i += 1
            return False
        return target

    def postfix(self) -> bool:
        """A primary with calls, members and indexes; is it something one can assign to?"""
        target = self.primary()
        while True:
            t = self.on()
            if t == ".":
                self.i += 1
                self.take("#")
                if self.k() not in _WORDS:
                    self.fail("expected a property name")
                self.i += 1
                target = True
            elif t == "?.":
                self.i += 1
                if self.k() == "(":
                    self.arguments()
                elif self.k() == "[":
                    self.i += 1
                    self.expression()
                    self.need("]")
                else:
                    self.take("#")
                    if self.k() not in _WORDS:
                        self.fail("expected a property name")
                    self.i += 1
                target = False
            elif t == "(":
                self.arguments()
                target = False
            elif t == "[":
                self.i += 1
                self.expression()
                self.need("]")
                target = True
            elif t == "`":
                self.template()
                target = False
            elif self.ts and t == "!" and not self.newline() and self.t[self.i + 1] != "=":
                self.i += 1
            elif self.ts and t == "<" and self.call_types():
                pass
            else:
                return target

    def call_types(self) -> bool:
        at = self.i
        try:
            self.type_args()
            if self.k() in ("(", "`"):
                return True
        except SyntaxFault:
            pass
        self.i = at
        return False

    def arguments(self) -> None:
        self.need("(")
        while self.k() != ")":
            self.take("...")
            self.assign()
            if not self.take(","):
                break
        self.need(")")

    def template(self) -> None:
        self.need("`")
        while not self.take("`"):
            self.need(HOLE)
            self.expression()
            self.need("}")

    def primary(self) -> bool:
        t = self.k()
        if t in _NAMES:
            if t == "async" and self.t[self.i + 1] == "function":
                self.i += 1
                self.function(False)
                return False
            self.i += 1
            return True
        if t in ('"', "0", "this", "null", "true", "false", "super"):
            self.i += 1
            return False
        if t == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return True
        if t == "[":
            self.i += 1
            while self.k() != "]":
                if self.take(","):
                    continue
                self.take("...")
                self.assign()
                if self.k() != "]":
                    self.need(",")
            self.i += 1
            return True
        if t == "{":
            self.object()
            return True
        if t == "function":
            self.function(False)
            return False
        if t == "class":
            self.class_(False)
            return False
        if t == "`":
            self.template()
            return False
        if t == "new":
            self.i += 1
            if self.take("."):
                self.ident()
                return False
            self.new_target()
            return False
        if t == "import":
            self.i += 1
            if self.take("."):
                self.ident()
            elif self.k() != "(":
                self.fail("expected '('")
            return False
        if t == "#":
            self.i += 1
            self.ident()
            return False
        self.fail("expected an expression")

    def new_target(self) -> None:
        self.primary()
        while self.k() in (".", "["):
            if self.take("."):
                self.take("#")
                if self.k() not in _WORDS:
                    self.fail("expected a property name")
                self.i += 1
            else:
                self.i += 1
                self.expression()
                self.need("]")
        if self.ts and self.k() == "<":
            self.type_args()
        if self.t[self.i] == "(":
            self.arguments()

    def object(self) -> None:
        self.need("{")
        while self.k() != "}":
            if self.take("..."):
                self.assign()
            else:
                while (t := self.k()) in ("get", "set", "async") and self.at(1) not in (",", ":", "(", "}", "=", "<"):
                    self.i += 1
                star = self.take("*")
                t = self.k()
                self.key()
                if self.k() == "(" or self.ts and self.k() == "<":
                    self.signature()
                    self.block()
                elif star:
                    self.fail("expected '('")
                elif self.take(":"):
                    self.assign()
                elif t not in _NAMES:
                    self.fail("expected ':'")
                elif self.take("="):
                    self.assign()
            if not self.take(","):
                break
        self.need("}")

    # --- types

    def type_params(self) -> None:
        if not self.take("<"):
            return
        while True:
            while self.k() in ("const", "in", "out") and self.at(1) in _NAMES:
                self.i += 1
            self.ident()
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            if not self.take(",") or self.k() == ">":
                break
        self.need(">")

    def type_args(self) -> None:
        self.need("<")
        while True:
            self.type_()
            if not self.take(","):
                break
        self.need(">")

    def return_type(self) -> None:
        if self.k() == "asserts" and self.at(1) in _NAMES | {"this"}:
            self.i += 2
            if self.take("is"):
                self.type_()
        elif (self.k() in _NAMES or self.k() == "this") and self.at(1) == "is":
            self.i += 2
            self.type_()
        else:
            self.type_()

    def type_(self) -> None:
        t = self.k()
        if t in ("new", "abstract") and self.at(1) in ("new", "(", "<"):
            self.take("abstract")
            self.take("new")
            t = self.k()
        if t == "<" or t == "(" and self.function_type():
            self.type_params()
            self.params()
            self.need("=>")
            self.return_type()
        else:
            self.union()
            if self.t[self.i] == "extends":
                self.i += 1
                self.type_()
                self.need("?")
                self.type_()
                self.need(":")
                self.type_()

    def function_type(self) -> bool:
        n = self.at(1)
        if n in (")", "..."):
            return True
        if n in _NAMES or n == "this":
            return self.at(2) in (":", ",", "?", "=") or self.at(2) == ")" and self.at(3) == "=>"
        return n in ("[", "{") and self.ahead_arrow()

    def ahead_arrow(self) -> bool:
        j, depth = self.i, 0
        while self.t[j] != "":
            if self.t[j] in ("(", "[", "{"):
                depth += 1
            elif self.t[j] in (")", "]", "}"):
                depth -= 1
                if not depth:
                    return self.t[j + 1] == "=>"
            j += 1
        return False

    def union(self) -> None:
        if self.k() in ("|", "&"):
            self.i += 1
        self.type_unary()
        while self.type_on() in ("|", "&"):
            self.k()
            self.i += 1
            self.type_unary()

    def type_on(self) -> str:
        return self.peek_line() if self.t[self.i] == "\n" else self.k()

    def type_unary(self) -> None:
        while self.k() in ("keyof", "unique", "readonly", "infer", "typeof") and (self.at(1) in _WORDS or self.at(1) in ("(", "[", "{", '"')):
            self.i += 1
        self.type_primary()
        while True:
            if self.t[self.i] == "[":
                self.i += 1
                if not self.take("]"):
                    self.type_()
                    self.need("]")
            else:
                return

    def type_primary(self) -> None:
        t = self.k()
        if t in _NAMES or t in ("this", "void", "null", "true", "false", "import"):
            self.i += 1
            if t == "import":
                self.arguments()
            while self.t[self.i] == ".":
                self.i += 1
                if self.k() not in _WORDS:
                    self.fail("expected a name")
                self.i += 1
            if self.t[self.i] == "<":
                self.type_args()
        elif t in ('"', "0"):
            self.i += 1
        elif t == "-" and self.at(1) == "0":
            self.i += 2
        elif t == "`":
            self.need("`")
            while not self.take("`"):
                self.need(HOLE)
                self.type_()
                self.need("}")
        elif t == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif t == "[":
            self.i += 1
            while self.k() != "]":
                self.take("...")
                if self.k() in _NAMES and (self.at(1) == ":" or self.at(1) == "?" and self.at(2) == ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type_()
                self.take("?")
                if not self.take(","):
                    break
            self.need("]")
        elif t == "{":
            self.object_type()
        else:
            self.fail("expected a type")

    def object_type(self) -> None:
        self.need("{")
        while self.k() != "}":
            if self.k() in ("+", "-") and self.at(1) == "readonly":
                self.i += 1
            while self.k() in ("readonly", "get", "set") and self.at(1) not in (":", "?", "(", ";", ",", "}", "<"):
                self.i += 1
            if self.k() == "new" and self.at(1) in ("(", "<"):
                self.i += 1
            if self.k() in ("(", "<"):
                self.signature()
            elif self.k() == "[" and self.at(1) in _NAMES and self.at(2) in (":", "in"):
                self.i += 2
                self.k()
                self.i += 1
                self.type_()
                if self.take("as"):
                    self.type_()
                self.need("]")
                if self.k() in ("+", "-"):
                    self.i += 1
                self.take("?")
                if self.take(":"):
                    self.type_()
            else:
                self.key()
                self.take("?")
                if self.k() in ("(", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type_()
            if self.t[self.i] == "\n":
                self.k()
                if self.k() in (";", ","):
                    self.i += 1
            elif self.k() in (";", ","):
                self.i += 1
            elif self.k() != "}":
                self.fail("expected ';'")
        self.i += 1


class TypeScript(Script):
    name = "typescript"
    ts = True


_STATEMENTS = {
    "{": Script.block, "var": Script.s_var, "const": Script.s_var, "if": Script.s_if, "for": Script.s_for, "while": Script.s_while, "do": Script.s_do, "switch": Script.s_switch,
    "try": Script.s_try, "return": Script.s_jump, "break": Script.s_jump, "continue": Script.s_jump, "throw": Script.s_throw, ";": Script.s_empty, "debugger": Script.s_debugger,
    "function": Script.s_function, "class": Script.s_class, "@": Script.s_decorated, "import": Script.s_import, "export": Script.s_export,
}


def _starts(t: str) -> bool:
    return t in _WORDS and t not in ("else", "case", "default", "catch", "finally", "in", "instanceof", "extends")


def _line_end(toks: list) -> list:
    return ["\n"] if toks[-1] in _WORDS or toks[-1] in ('"', "0", ")", "]", "++", "--", "`", ">") else []


#: Brackets within brackets that a JavaScript text may have; the language sets no such bound, the tests do.
MOST_BRACKETS = 2_999
_BRACKET = re.compile(r"[()\[\]{}]")
_JS = Shaper(_TOKEN, Script, _starts, _line_end)
_TS = Shaper(_TOKEN, TypeScript, _starts, _line_end)


def check_js(text: str) -> list[str]:
    s = shape(text.removeprefix("#!").partition("\n")[2] if text.startswith("#!") else text, True)
    if levels(_BRACKET.findall(s.replace(HOLE, "{")), MOST_BRACKETS):
        return [f"line 0: more than {MOST_BRACKETS} brackets within brackets"]
    return _JS.check(s)


def check_ts(text: str) -> list[str]:
    return _TS.check(shape(text, False))


def check_tsx(text: str) -> list[str]:
    return _TS.check(shape(text, True))
