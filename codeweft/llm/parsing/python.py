"""Python: logical lines, blocks by indentation, statements and expressions."""

from __future__ import annotations

import re

from codeweft.llm.parsing.base import BAD, INNER, MEMO, Parser, SyntaxFault, ident_pattern, inner, levels, words

KEYWORDS = words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
)
#: Words that are keywords only where a statement begins so.
SOFT = words("match case type")
#: Brackets within brackets that Python itself takes.
MOST_BRACKETS = 200

_SCAN = re.compile(
    r'''#[^\n]*|(?<![^\W])(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?!"")(?:[^"\\\n]|\\.)*"|'(?!'')(?:[^'\\\n]|\\.)*'|""(?!")|\'\'(?!'))|\\\n|["'\x01-\x06]''',
    re.DOTALL,
)
_IDENT = ident_pattern(KEYWORDS | SOFT)
_NUMBER = re.compile(
    r"(?<![\w.])(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?![\d.eEjJ_])|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.(?![\w.])|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))(?![\w])"
)
_BAD_NUMBER = re.compile(r"(?<!\w)\d\w*")
_TOKEN = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|:=|[^\W\d]\w*|\S")


_OPENING = re.compile(r"""(?<![^\W])(?:[fFtT][rR]?|[rR][fFtT])(?:\"{3}|\'{3}|"|')""")
_STEP = re.compile(_OPENING.pattern + "|" + _SCAN.pattern, re.DOTALL)
_FIELD_STEP = re.compile(_STEP.pattern + r"|[=!<>]=|=(?=\s*[!:}])|[()\[\]{}:!\n]", re.DOTALL)
#: Begin and end of a replacement field in a formatted string.
FIELD, FIELD_END = "\x05", "\x06"
_CLOSING = {")": "(", "]": "[", "}": "{"}


def _string(m: re.Match) -> str:
    s = m[0]
    c = s[0]
    if c == "#":
        return ""
    if c == "\\":
        return " " + INNER
    if len(s) == 1:
        return BAD
    head = re.match(r"[A-Za-z]*", s)[0].lower()
    return ('\x04' if "b" in head else '"') + inner(s)


def _formatted(text: str, m: re.Match, out: list[str]) -> int:
    """Read a formatted string: a string and its fields are written to `out`. If it isn't whole, a bad token in the place of what a plain string would take."""
    part = ['"']
    quote = m[0].lstrip("fFtTrR")
    end = _parts(text, m.end(), quote, "r" in m[0].lower(), part, False)
    if end is None:
        plain = _SCAN.match(text, m.start())
        out.append(BAD + inner(plain[0] if plain else ""))
        return plain.end() if plain else m.end()
    out += part
    return end


def _parts(text: str, pos: int, quote: str, raw: bool, out: list[str], spec: bool) -> int | None:
    """Literal text and fields up to past the quote, or in a format specification up to its brace; None when that is missing."""
    while pos < len(text):
        c = text[pos]
        if text.startswith(quote, pos):
            return None if spec else pos + len(quote)
        if c == "\\":
            if not raw and text.startswith("N{", pos + 1):
                pos = text.find("}", pos) + 1
                if not pos:
                    return None
            else:
                pos += 1
                if text[pos : pos + 1] == "\n":
                    out.append(INNER)
                pos += text[pos : pos + 1] not in ("{", "}")
        elif c == "\n":
            if len(quote) == 1:
                return None
            out.append(INNER)
            pos += 1
        elif c == "}":
            if spec:
                return pos
            if text[pos + 1 : pos + 2] != "}":
                return None
            pos += 2
        elif c == "{":
            if not spec and text[pos + 1 : pos + 2] == "{":
                pos += 2
                continue
            pos = _field(text, pos + 1, quote, raw, out)
            if pos is None:
                return None
        else:
            pos = _LITERAL.match(text, pos).end()
    return None


_LITERAL = re.compile(r"""[^\\\n{}"']+|["']""")
_CONVERSION = re.compile(r"![rsa]\s*(?=[:}])")


def _field(text: str, pos: int, quote: str, raw: bool, out: list[str]) -> int | None:
    """A replacement field from behind its brace to past the closing one."""
    opened: list[str] = []
    out.append(FIELD)
    while m := _FIELD_STEP.search(text, pos):
        s = m[0]
        out.append(text[pos : m.start()])
        pos = m.end()
        if s in ("(", "[", "{"):
            opened.append(s)
            out.append(s)
        elif s in _CLOSING and opened:
            if opened.pop() != _CLOSING[s]:
                return None
            out.append(s)
        elif s == "\n":
            out.append(INNER)
        elif opened and s in (":", "!", "=") or len(s) == 2 and s[1] == "=":
            out.append(s)
        elif s in ("}", ":", "!", "="):
            out.append(FIELD_END)
            if s == "=":
                pos += len(re.compile(r"\s*").match(text, pos)[0])
                s = text[pos]
                pos += 1
            if s == "!":
                m = _CONVERSION.match(text, pos - 1)
                if not m:
                    return None
                pos = m.end() + 1
                s = text[m.end()]
            if s == ":":
                pos = _parts(text, pos, quote, raw, out, True)
                return pos if pos is None else pos + 1
            return pos
        elif s in (")", "]"):
            return None
        elif _OPENING.match(text, m.start()):
            pos = _formatted(text, m, out)
        elif s in ('"', "'"):
            return None
        else:
            out.append(_string(m).replace("\n", INNER))
    return None


def shape(text: str) -> str:
    out: list[str] = []
    pos = 0
    while m := _STEP.search(text, pos):
        out.append(text[pos : m.start()])
        if m[0][0] in "fFtTrR" and _OPENING.match(text, m.start()):
            pos = _formatted(text, m, out)
        else:
            out.append(_string(m))
            pos = m.end()
    out.append(text[pos:])
    s = _IDENT.sub("n", "".join(out))
    s = _NUMBER.sub("0", s)
    return _BAD_NUMBER.sub(lambda m: "0" if m[0] == "0" else BAD, s)


#: What an expression turned out to be: fit as a target, a chain of targets, a call or await, or nothing one can assign to.
NAME, REF, SEQ, CALL, OTHER = "name", "ref", "seq", "call", "other"
_BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
_COMPARE = words("< > == >= <= != in not is")
_AUGMENTED = words("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=")
_STARTS = words('n 0 " ( [ { - + ~ not lambda await None True False ... match case type') | {"\x04"}
_NAMES = words("n match case type")


class Line(Parser):
    """One logical line."""

    def name(self) -> None:
        if self.k() not in _NAMES:
            self.fail("expected a name")
        self.i += 1

    # --- expressions

    def test(self) -> str:
        if self.k() == "lambda":
            self.i += 1
            self.params(":", False)
            self.need(":")
            self.test()
            kind = OTHER
        else:
            kind = self.or_test()
            if self.k() == "if":
                self.i += 1
                self.or_test()
                self.need("else")
                self.test()
                kind = OTHER
        return kind

    def or_test(self) -> str:
        kind = self.not_test()
        while self.k() in ("and", "or"):
            self.i += 1
            self.not_test()
            kind = OTHER
        return kind

    def not_test(self) -> str:
        if self.k() == "not":
            while self.take("not"):
                pass
            self.not_test()
            return OTHER
        kind = self.binary(1)
        while self.k() in _COMPARE:
            op = self.k()
            self.i += 1
            if op == "not":
                self.need("in")
            elif op == "is":
                self.take("not")
            self.binary(1)
            kind = OTHER
        return kind

    def binary(self, least: int) -> str:
        kind = self.unary()
        while (p := _BINARY.get(self.k(), 0)) >= least:
            self.i += 1
            self.binary(p + 1)
            kind = OTHER
        return kind

    def unary(self) -> str:
        if self.k() in ("-", "+", "~"):
            while self.k() in ("-", "+", "~"):
                self.i += 1
            self.unary()
            return OTHER
        kind = self.primary()
        if self.k() == "**":
            self.i += 1
            self.unary()
            return OTHER
        return kind

    def primary(self) -> str:
        waits = self.take("await")
        kind = self.atom()
        while True:
            t = self.k()
            if t == ".":
                self.i += 1
                self.name()
                kind = REF
            elif t == "(":
                self.i += 1
                self.arguments()
                kind = CALL
            elif t == "[":
                self.i += 1
                self.subscript()
                kind = REF
            else:
                break
        return OTHER if waits else kind

    def atom(self) -> str:
        t = self.k()
        if t in _NAMES:
            self.i += 1
            return NAME
        if t in ("0", "None", "True", "False", "..."):
            self.i += 1
            return OTHER
        if t in ('"', "\x04"):
            while self.take(t):
                while self.take(FIELD):
                    self.value()
                    self.need(FIELD_END)
            if self.k() in ('"', "\x04"):
                self.fail("bytes and text can't be joined")
            return OTHER
        if t == "(":
            self.i += 1
            if self.take(")"):
                return SEQ
            if self.k() == "yield":
                self.yields()
                self.need(")")
                return OTHER
            return self.items(")", True)
        if t == "[":
            self.i += 1
            return SEQ if self.take("]") else self.items("]", False)
        if t == "{":
            self.i += 1
            self.braces()
            return OTHER
        return self.fail("expected an expression")

    def items(self, end: str, group: bool) -> str:
        """The inside of ( ) or [ ]."""
        star = self.k() == "*"
        kind = self.named(True)
        if self.k() in ("for", "async"):
            if star:
                self.fail("a star can't be used in a comprehension")
            self.comprehension()
            self.need(end)
            return OTHER
        if group and self.k() == ")":
            if star:
                self.fail("a star needs a list or tuple")
            self.i += 1
            return kind
        fine = kind in (NAME, REF, SEQ)
        while self.take(","):
            if self.k() == end:
                break
            fine &= self.named(True) in (NAME, REF, SEQ)
        self.need(end)
        return SEQ if fine else OTHER

    def named(self, star: bool) -> str:
        """An expression, a star before it, or one with := behind a name."""
        if star and self.take("*"):
            return self.binary(1)
        kind = self.test()
        if self.k() == ":=":
            if kind != NAME:
                self.fail("only a name can stand before ':='")
            self.i += 1
            self.test()
            return OTHER
        return kind

    def comprehension(self) -> None:
        while self.k() in ("for", "async"):
            if self.take("async") and self.k() != "for":
                self.fail("expected 'for'")
            self.i += 1
            self.targets()
            self.need("in")
            self.or_test()
            while self.take("if"):
                self.or_test_nocond()

    def or_test_nocond(self) -> None:
        if self.k() == "lambda":
            self.test()
        elif self.or_test() == NAME and self.take(":="):
            self.or_test()

    def targets(self) -> str:
        """What `for` assigns to."""
        while True:
            self.take("*")
            if self.primary() not in (NAME, REF, SEQ):
                self.fail("can't assign to this")
            if not self.take(","):
                return SEQ
            if self.k() in ("in", "="):
                return SEQ

    def braces(self) -> None:
        if self.take("}"):
            return
        first = True
        mapping = None
        while True:
            if self.take("**"):
                self.binary(1)
                pair = True
            elif self.take("*"):
                self.binary(1)
                pair = False
            else:
                self.named(False)
                pair = self.take(":")
                if pair:
                    self.test()
            if mapping is None:
                mapping = pair
            elif mapping != pair:
                self.fail("a dict entry needs a key and a value")
            if first and self.k() in ("for", "async"):
                self.comprehension()
                break
            first = False
            if not self.take(",") or self.k() == "}":
                break
        self.need("}")

    def subscript(self) -> None:
        while True:
            if not self.take(":"):
                self.named(True)
                colon = self.take(":")
            else:
                colon = True
            if colon:
                for _ in range(2):
                    if self.k() not in (",", "]", ":"):
                        self.test()
                    if not self.take(":"):
                        break
            if not self.take(",") or self.k() == "]":
                break
        self.need("]")

    def arguments(self) -> None:
        named = False
        n = 0
        while self.k() != ")":
            n += 1
            if self.take("**"):
                self.test()
                named = True
            elif self.take("*"):
                self.test()
            else:
                kind = self.named(False)
                if self.k() == "=":
                    if kind != NAME:
                        self.fail("a keyword must be a name")
                    self.i += 1
                    self.test()
                    named = True
                elif self.k() in ("for", "async"):
                    self.comprehension()
                    if n > 1 or self.k() != ")":
                        self.fail("a generator among arguments needs brackets")
                elif named:
                    raise SyntaxFault("positional argument after a keyword argument")
            if not self.take(","):
                break
        self.need(")")

    def params(self, end: str, typed: bool) -> None:
        star = slash = default = False
        while self.k() != end:
            if self.take("**"):
                self.name()
                if typed and self.take(":"):
                    self.test()
                self.take(",")
                if self.k() != end:
                    self.fail("nothing can follow **")
                return
            if self.take("*"):
                if star:
                    self.fail("a second star")
                star = True
                if self.k() in _NAMES:
                    self.i += 1
                    if typed and self.take(":"):
                        self.named(True)
                elif self.k() != ",":
                    self.fail("expected a name")
                elif self.t[self.i + 1] in (end, "**"):
                    self.fail("a name must follow a bare star")
            elif self.k() == "/":
                if star or slash:
                    self.fail("'/' out of place")
                slash = True
                self.i += 1
            else:
                self.name()
                if typed and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("a parameter without default after one with")
            if not self.take(","):
                break

    def star_list(self) -> str:
        """Expressions and starred ones between commas."""
        kind = self.named(True)
        fine = kind in (NAME, REF, SEQ)
        if self.k() != ",":
            return kind
        while self.take(","):
            if self.k() not in _STARTS and self.k() != "*":
                break
            fine &= self.named(True) in (NAME, REF, SEQ)
        return SEQ if fine else OTHER

    def yields(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.test()
        elif self.k() in _STARTS or self.k() == "*":
            self.star_list()

    # --- statements

    def simple(self) -> None:
        """simple_stmt (';' simple_stmt)* up to the end of the line."""
        while True:
            self.small()
            if not self.take(";"):
                break
            if self.k() == "":
                return
        if self.k() != "":
            self.fail("expected the end of the statement")

    def small(self) -> None:
        t = self.k()
        rule = _SMALL.get(t)
        if rule:
            self.i += 1
            rule(self)
        elif t == "type" and self.t[self.i + 1] in _NAMES and self.t[self.i + 2] in ("=", "["):
            self.i += 2
            if self.take("["):
                self.type_params()
            self.need("=")
            self.test()
        else:
            self.expression()

    def expression(self) -> None:
        if self.k() == "yield":
            self.yields()
            return
        kind = self.star_list()
        t = self.k()
        if t == ":":
            if kind not in (NAME, REF):
                self.fail("only a name can be annotated")
            self.i += 1
            self.test()
            if self.take("="):
                self.value()
        elif t in _AUGMENTED:
            if kind not in (NAME, REF):
                self.fail("can't assign to this")
            self.i += 1
            self.value()
        else:
            while self.k() == "=":
                if kind not in (NAME, REF, SEQ):
                    self.fail("can't assign to this")
                self.i += 1
                kind = self.value()

    def value(self) -> str:
        if self.k() == "yield":
            self.yields()
            return OTHER
        return self.star_list()

    def after_return(self) -> None:
        if self.k() not in ("", ";"):
            self.star_list()

    def after_raise(self) -> None:
        if self.k() not in ("", ";"):
            self.test()
            if self.take("from"):
                self.test()

    def after_assert(self) -> None:
        self.test()
        if self.take(","):
            self.test()

    def after_del(self) -> None:
        self.targets()

    def after_global(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def after_import(self) -> None:
        while True:
            self.dotted()
            if self.take("as"):
                self.name()
            if not self.take(","):
                return

    def after_from(self) -> None:
        dots = False
        while self.k() in (".", "..."):
            self.i += 1
            dots = True
        if not dots or self.k() != "import":
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        group = self.take("(")
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(",") or group and self.k() == ")":
                break
        if group:
            self.need(")")

    def nothing(self) -> None:
        pass

    def type_params(self) -> None:
        while True:
            if self.k() in ("*", "**"):
                self.i += 1
            self.name()
            if self.take(":"):
                self.test()
            if self.take("="):
                self.test()
            if not self.take(",") or self.k() == "]":
                break
        self.need("]")

    # --- headers

    def header(self) -> tuple[str, bool]:
        """(kind of line, does it open a block)."""
        t = self.k()
        kind = t
        if t == "async" and self.t[self.i + 1] in ("def", "for", "with"):
            self.i += 1
            t = kind = self.k()
        if t == "@":
            self.i += 1
            self.named(False)
            if self.k() != "":
                self.fail("expected the end of the line")
            return "@", False
        if t in ("match", "case") and self.soft(t):
            return t, self.body()
        rule = _HEADS.get(t)
        if rule is None:
            self.simple()
            return "", False
        self.i += 1
        if t == "except" and self.k() == "*":
            self.i += 1
        rule(self)
        return kind, self.body()

    def body(self) -> bool:
        self.need(":")
        if self.k() == "":
            return True
        self.simple()
        return False

    def soft(self, t: str) -> bool:
        """A match or case header up to its colon, if this is one."""
        if self.t[-4] != ":" or self.t[self.i + 1] in ("=", ".", ":", ")", ",", "", "in", "is", "and", "or", "if"):
            return False
        at = self.i
        try:
            self.i += 1
            if t == "match":
                self.star_list()
            else:
                self.patterns()
                if self.take("if"):
                    self.named(False)
            if self.k() == ":" and self.t[self.i + 1] == "":
                return True
        except SyntaxFault:
            pass
        self.i = at
        return False

    def patterns(self) -> None:
        while True:
            self.pattern()
            if not self.take(",") or self.k() in (":", "if"):
                return

    def pattern(self) -> None:
        self.take("*")
        self.closed()
        while self.take("|"):
            self.closed()
        if self.take("as"):
            self.name()

    def closed(self) -> None:
        t = self.k()
        if t in ("(", "["):
            end = ")" if t == "(" else "]"
            self.i += 1
            while self.k() != end:
                self.pattern()
                if not self.take(","):
                    break
            self.need(end)
        elif t == "{":
            self.i += 1
            while self.k() != "}":
                if self.take("**"):
                    self.name()
                else:
                    self.binary(4)
                    self.need(":")
                    self.pattern()
                if not self.take(","):
                    break
            self.need("}")
        elif t in _NAMES:
            self.dotted()
            if self.take("("):
                while self.k() != ")":
                    if self.k() in _NAMES and self.t[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")
        else:
            self.binary(4)

    def head_if(self) -> None:
        self.named(False)

    def head_for(self) -> None:
        self.targets()
        self.need("in")
        self.star_list()

    def head_with(self) -> None:
        at = self.i
        if self.k() == "(":
            try:
                self.i += 1
                self.with_items(True)
                self.need(")")
                if self.k() == ":":
                    return
            except SyntaxFault:
                pass
            self.i = at
        self.with_items(False)

    def with_items(self, group: bool) -> None:
        while True:
            self.test()
            if self.take("as") and self.primary() not in (NAME, REF, SEQ):
                self.fail("can't assign to this")
            if not self.take(",") or group and self.k() == ")":
                return

    def head_except(self) -> None:
        if self.k() != ":":
            self.test()
            while self.take(","):
                self.test()
            if self.take("as"):
                self.name()

    def head_def(self) -> None:
        self.name()
        if self.take("["):
            self.type_params()
        self.need("(")
        self.params(")", True)
        self.need(")")
        if self.take("->"):
            self.star_list()

    def head_class(self) -> None:
        self.name()
        if self.take("["):
            self.type_params()
        if self.take("("):
            self.arguments()


_SMALL = {
    "return": Line.after_return, "raise": Line.after_raise, "assert": Line.after_assert, "del": Line.after_del, "global": Line.after_global,
    "nonlocal": Line.after_global, "import": Line.after_import, "from": Line.after_from, "pass": Line.nothing, "break": Line.nothing, "continue": Line.nothing,
}
_HEADS = {
    "if": Line.head_if, "elif": Line.head_if, "while": Line.head_if, "for": Line.head_for, "else": Line.nothing, "try": Line.nothing, "finally": Line.nothing,
    "with": Line.head_with, "except": Line.head_except, "def": Line.head_def, "class": Line.head_class,
}
#: Which lines at the same depth must stand just before these.
_AFTER = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else-try"}}

_PIECES: dict[str, tuple] = {}
_DEPTHS: dict[str, int] = {}


def _read(text: str) -> tuple[str, bool, str | None]:
    """(kind, opens a block, error) of a logical line, remembered by shape; minified lines by each of their statements."""
    got = _PIECES.get(text)
    if got is None:
        if len(_PIECES) > MEMO:
            _PIECES.clear()
        if len(text) > 400 and (parts := _split(text)):
            bad = next((e for _, _, e in map(_read, parts) if e), None)
            return "", False, bad
        line = Line([*_TOKEN.findall(text), "", "", ""])
        try:
            if levels(line.t, MOST_BRACKETS):
                raise SyntaxFault("too many nested brackets")
            got = (*line.header(), None)
        except SyntaxFault as e:
            opens = text.endswith(":")
            first = line.t[0]
            got = (first if first in _HEADS and opens else "", opens and first in _HEADS, str(e))
        _PIECES[text] = got
    return got


_HEADER = re.compile(r"(?:if|elif|else|for|while|try|except|finally|with|def|class|async|match|case)(?!\w)|@")


def _split(text: str) -> list[str]:
    """The statements of a long line of simple statements; none when one may be a header or there is only one."""
    parts, depth, begin = [], 0, 0
    for m in re.finditer(r"[()\[\]{};]", text):
        c = m[0]
        if c == ";":
            if not depth:
                parts.append(text[begin : m.start()].strip())
                begin = m.end()
        else:
            depth += 1 if c in "([{" else -1
    rest = text[begin:].strip()
    if rest:
        parts.append(rest)
    return parts if len(parts) > 1 and all(p and not _HEADER.match(p) for p in parts) else []


_BRACKET = re.compile(r"[()\[\]{}]")


def _delta(line: str) -> int:
    got = _DEPTHS.get(line)
    if got is None:
        if len(_DEPTHS) > MEMO:
            _DEPTHS.clear()
        got = _DEPTHS[line] = sum(1 if c in "([{" else -1 for c in _BRACKET.findall(line))
    return got


def check(text: str) -> list[str]:
    """All errors of a Python text."""
    errors: list[str] = []
    # A block level: its column, the kind of its last line, whether that line opened a block, pending decorator.
    cols, kinds = [0], [""]
    opened = False  # the last line waits for its block
    pending, depth, began, number = "", 0, 1, 0

    def note(line: int, why: str) -> None:
        errors.append(f"line {line}: {why}")

    def close(kind: str, line: int) -> None:
        if kind == "try":
            note(line, "expected 'except' or 'finally' after a try block")
        elif kind == "@":
            note(line, "expected a function or class after a decorator")

    for raw in shape(text).split("\n"):
        number += 1 + raw.count(INNER)
        line = raw.replace(INNER, " ").rstrip()
        body = line.lstrip(" \t\f")
        if not body:
            continue
        change = _delta(body)
        if depth:
            pending += " " + body
            depth += change
            if depth > 0:
                continue
            body, at = pending, began
        else:
            at, lead = number - raw.count(INNER), line[: len(line) - len(body)]
            if change > 0:
                pending, depth, began = body, change, at
                column = len(lead.expandtabs(8))
                continue
            column = len(lead.expandtabs(8))
        depth = 0
        kind, opens, bad = _read(body)
        if bad:
            note(at, bad)
        if opened:
            opened = False
            if column > cols[-1]:
                cols.append(column)
                kinds.append("")
            else:
                note(at, "expected an indented block")
        elif column > cols[-1]:
            note(at, "unexpected indent")
            column = cols[-1]
        while column < cols[-1]:
            close(kinds.pop(), at)
            cols.pop()
        if column != cols[-1]:
            note(at, "unindent does not match any outer level")
        last = kinds[-1]
        if kind in _AFTER:
            if last not in _AFTER[kind] and not bad:
                note(at, f"{kind!r} without what it belongs to")
            if kind == "else" and last == "except":
                kind = "else-try"
        elif last in ("try", "@") and not (last == "@" and kind in ("@", "def", "class")):
            close(last, at)
        if last == "match-block" and kind != "case" and not bad:
            note(at, "expected a case")
        kinds[-1] = kind
        opened = opens
        if kind == "match" and opens:
            pass
    if depth:
        note(began, "bracket was never closed")
    if opened:
        note(number, "expected an indented block at the end of input")
    for kind in reversed(kinds):
        close(kind, number)
    return errors
