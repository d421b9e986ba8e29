"""Go."""

from __future__ import annotations

import re

from codeweft.llm.parsing.base import BAD, Parser, Shaper, Stmt, SyntaxFault, ident_pattern, inner, words

KEYWORDS = words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")

_IDENT = ident_pattern(KEYWORDS)
_NUMBER = re.compile(
    r"(?<![\w.])(?:0[xX](?:_?[0-9a-fA-F])+(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d+)?i?|0[bB](?:_?[01])+i?|0[oO](?:_?[0-7])+i?|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?i?)(?!\w)"
)
_BAD_NUMBER = re.compile(r"(?<!\w)[1-9]\w*|(?<!\w)0\w+")
_SCAN = re.compile(r"""//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'|/\*|["'`\x01\x02]""", re.DOTALL)
_TOKEN = re.compile(r"<-|:=|\.\.\.|&\^=|&\^|<<=|>>=|<<|>>|<=|>=|==|!=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[A-Za-z]+|\S")


def _replace(m: re.Match) -> str:
    s = m[0]
    if len(s) == 1 or s == "/*":
        return BAD
    if s[0] == "/":
        return "\n" * s.count("\n") or " "
    return ('"' if s[0] != "'" else "0") + inner(s)


def shape(text: str) -> str:
    s = _IDENT.sub("n", _SCAN.sub(_replace, text))
    return _BAD_NUMBER.sub(BAD, _NUMBER.sub("0", s))


_BINARY = {
    "||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5,
}
_ASSIGN = words("= += -= *= /= %= &= |= ^= <<= >>= &^=")
_ENDS = words('n 0 " break continue fallthrough return ++ -- ) ] }')
#: What an expression is: a name, something to assign to, a call or receive, a type, or another value.
NAME, TARGET, CALL, TYPE, VALUE = range(5)


class Go(Parser):
    name = "go"
    sync = words("; } func type var const import if for switch return go defer")

    def __init__(self, toks, starts=None):
        super().__init__(toks, starts)
        self.level = 0  # below 0: composite literals need brackets (headers of if, for, switch)

    def at(self, n: int) -> str:
        j = self.i + n
        for x in range(self.i, min(j, len(self.t) - 1) + 1):
            if self.t[x].__class__ is Stmt:
                self.t[x : x + 1] = self.t[x].raw
        return self.t[j] if j < len(self.t) else ""

    def ident(self) -> None:
        self.need("n")

    def end(self) -> None:
        """A semicolon, which may be left out before a closing bracket."""
        if self.k() not in (")", "}", ""):
            self.need(";")

    def file(self) -> None:
        while self.take(";"):
            pass
        self.guarded(self.package)
        while self.k() == "import" or self.k() == ";":
            if not self.take(";"):
                self.guarded(self.import_)
        while self.k() != "":
            if not self.take(";"):
                self.guarded(self.top)

    def package(self) -> None:
        self.need("package")
        self.ident()
        self.end()

    def group(self, rule) -> None:
        if self.take("("):
            while self.k() != ")":
                rule()
                self.end()
            self.i += 1
        else:
            rule()

    def import_(self) -> None:
        self.need("import")
        self.group(self.import_spec)
        self.end()

    def import_spec(self) -> None:
        if self.k() in (".", "n"):
            self.i += 1
        self.need('"')

    def top(self) -> None:
        t = self.k()
        if t == "func":
            self.i += 1
            if self.k() == "(":
                self.params()
            self.ident()
            if self.k() == "[":
                self.type_params()
            self.signature()
            if self.k() == "{":
                self.body()
        elif t in ("var", "const", "type"):
            self.declaration()
        else:
            self.fail("expected a declaration")
        self.end()

    def declaration(self) -> None:
        t = self.k()
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[t])

    def names(self) -> None:
        self.ident()
        while self.take(","):
            self.ident()

    def var_spec(self) -> None:
        self.names()
        if self.k() != "=":
            self.type_()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.k() not in ("=", ";", ")"):
            self.type_()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.ident()
        if self.k() == "[" and self.at(1) == "n" and self.at(2) != "]":
            self.type_params()
        self.take("=")
        self.type_()

    def type_params(self) -> None:
        self.need("[")
        while self.k() != "]":
            self.names()
            self.constraint()
            if not self.take(","):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    # --- types

    def type_(self) -> None:
        if not self.type_maybe():
            self.fail("expected a type")

    def type_maybe(self) -> bool:
        t = self.k()
        found = True
        if t == "n":
            self.i += 1
            if self.take("."):
                self.ident()
            if self.k() == "[" and self.at(1) != "]":
                self.i += 1
                self.type_()
                while self.take(","):
                    if self.k() == "]":
                        break
                    self.type_()
                self.need("]")
        elif t == "*":
            self.i += 1
            self.type_()
        elif t == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif t == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.inner_expression()
                self.need("]")
            self.type_()
        elif t == "map":
            self.i += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif t == "chan" or t == "<-" and self.at(1) == "chan":
            if t == "<-":
                self.i += 1
            self.i += 1
            if t == "chan":
                self.take("<-")
            self.type_()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.need("{")
            while self.k() != "}":
                self.field()
                self.end()
            self.i += 1
        elif t == "interface":
            self.i += 1
            self.need("{")
            while self.k() != "}":
                if self.k() == "n" and self.at(1) == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
            self.i += 1
        else:
            found = False
        return found

    def field(self) -> None:
        if self.k() == "*" or self.k() == "n" and self.at(1) in (";", "}", '"', "."):
            self.take("*")
            self.type_()
        else:
            self.names()
            self.type_()
        self.take('"')

    def signature(self) -> None:
        self.params()
        if self.k() == "(":
            self.params()
        else:
            self.type_maybe()

    def params(self) -> None:
        """Names with types, or types only: one or the other for all."""
        self.need("(")
        level, self.level = self.level, 0
        named = plain = 0
        waiting = 0
        while self.k() != ")":
            if self.take("..."):
                self.type_()
                plain += 1
            else:
                single = self.k() == "n" and self.at(1) in (",", ")")
                if self.k() == "n" and (self.at(1) == "..." or self.at(1) not in (",", ")", ".", "[")) or self.k() == "n" and self.at(1) == "[" and self.name_before_type():
                    self.i += 1
                    self.take("...")
                    self.type_()
                    named += 1
                    waiting = 0
                else:
                    self.type_()
                    if single:
                        waiting += 1
                    else:
                        plain += 1
            if not self.take(","):
                break
        self.level = level
        self.need(")")
        if named and (plain or waiting):
            raise SyntaxFault("mixed named and unnamed parameters")

    def name_before_type(self) -> bool:
        """`n []T`, `n [3]T` but not `n[T]`."""
        if self.at(2) == "]":
            return True
        at = self.i
        try:
            self.i += 1
            return self.type_maybe()
        except SyntaxFault:
            return False
        finally:
            self.i = at

    # --- statements

    def simple_only(self) -> None:
        while self.k() != "":
            if self.k() not in ("n", "return", "go", "defer", "*", "("):
                self.fail("not simple")
            self.statement()
            self.need(";")

    def body(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while (t := self.t[self.i]) not in ("}", "case", "default"):
            if t == "":
                self.fail("expected '}'")
            if t.__class__ is Stmt or t == ";":
                self.i += 1
            else:
                self.guarded(self.one)

    def one(self) -> None:
        self.statement()
        self.end()

    def statement(self) -> None:
        t = self.k()
        rule = _STATEMENTS.get(t)
        if rule:
            self.i += 1
            rule(self)
        elif t in ("var", "const", "type"):
            self.declaration()
        elif t == "{":
            self.block()
        elif t == ";":
            pass
        elif t == "n" and self.at(1) == ":":
            self.i += 2
            if self.k() != "}":
                self.statement()
        else:
            self.simple()

    def simple(self, ranged: bool = False) -> bool:
        """An expression, assignment, send or count; true when it was a range clause."""
        if ranged and self.k() == "range":
            self.i += 1
            self.expression()
            return True
        fine, names, n = self.list()
        kind = self.last
        t = self.k()
        if t in (":=", "="):
            if t == ":=" and not names or not fine:
                self.fail("can't assign to this")
            self.i += 1
            if ranged and self.take("range"):
                self.expression()
                return True
            self.expressions()
        elif n > 1:
            self.fail("expected an assignment")
        elif t in _ASSIGN:
            if not fine:
                self.fail("can't assign to this")
            self.i += 1
            self.expression()
        elif t in ("++", "--"):
            if not fine:
                self.fail("can't count this up or down")
            self.i += 1
        elif t == "<-":
            self.i += 1
            self.expression()
        self.was = kind
        return False

    def list(self) -> tuple[bool, bool, int]:
        fine = names = True
        n = 0
        while True:
            kind = self.expression()
            self.last = kind
            fine &= kind in (NAME, TARGET)
            names &= kind == NAME
            n += 1
            if not self.take(","):
                return fine, names, n

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def s_return(self) -> None:
        if self.k() not in (";", "}"):
            self.expressions()

    def s_label(self) -> None:
        self.take("n")

    def s_goto(self) -> None:
        self.ident()

    def s_nothing(self) -> None:
        pass

    def s_call(self) -> None:
        if self.expression() != CALL:
            self.fail("expected a call")

    def s_if(self) -> None:
        level, self.level = self.level, -1
        if self.k() == "{":
            self.fail("expected a condition")
        if self.k() != ";":
            self.simple()
        if self.take(";"):
            self.simple()
        self.level = level
        self.block()
        if self.take("else"):
            if self.take("if"):
                self.s_if()
            else:
                self.block()

    def s_for(self) -> None:
        level, self.level = self.level, -1
        if self.k() != "{":
            ranged = False
            if self.k() != ";":
                ranged = self.simple(True)
            if not ranged and self.take(";"):
                if self.k() != ";":
                    self.simple()
                self.need(";")
                if self.k() != "{":
                    self.simple()
        self.level = level
        self.block()

    def s_switch(self) -> None:
        level, self.level = self.level, -1
        if self.k() != "{":
            if self.k() != ";":
                self.simple()
            if self.take(";") and self.k() != "{":
                self.simple()
        self.level = level
        self.clauses(self.case_expressions)

    def case_expressions(self) -> None:
        while True:
            if self.expression_or_type() is None:
                self.fail("expected an expression")
            if not self.take(","):
                return

    def expression_or_type(self):
        return self.expression()

    def s_select(self) -> None:
        self.clauses(self.simple)

    def clauses(self, rule) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                level, self.level = self.level, 0
                rule()
                self.level = level
            elif not self.take("default"):
                self.fail("expected 'case'")
            self.need(":")
            self.statements()

    # --- expressions

    def inner_expression(self) -> int:
        level, self.level = self.level, 0
        kind = self.expression()
        self.level = level
        return kind

    def expression(self) -> int:
        return self.binary(1)

    def binary(self, least: int) -> int:
        kind = self.unary()
        while (p := _BINARY.get(self.k(), 0)) >= least:
            self.i += 1
            self.binary(p + 1)
            kind = VALUE
        return kind

    def unary(self) -> int:
        t = self.k()
        if t in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            if t == "<-" and self.at(1) == "chan":
                self.type_()
                return self.operand_rest(TYPE)
            self.i += 1
            self.unary()
            return TARGET if t == "*" else CALL if t == "<-" else VALUE
        return self.operand_rest(self.operand())

    def operand(self) -> int:
        t = self.k()
        if t == "n":
            self.i += 1
            return NAME
        if t in ("0", '"'):
            self.i += 1
            return VALUE
        if t == "(":
            self.i += 1
            kind = self.inner_expression()
            self.need(")")
            return kind if kind in (TARGET, CALL) else TARGET if kind == NAME else VALUE
        if t == "func":
            self.i += 1
            self.signature()
            if self.k() == "{":
                self.body()
                return VALUE
            return TYPE
        if t in ("[", "map", "chan", "struct", "interface"):
            self.type_()
            return TYPE
        self.fail("expected an expression")

    def operand_rest(self, kind: int) -> int:
        while True:
            t = self.k()
            if t == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                    kind = VALUE
                else:
                    self.ident()
                    kind = TARGET
            elif t == "(":
                self.arguments()
                kind = CALL
            elif t == "[":
                self.i += 1
                self.index()
                kind = TARGET
            elif t == "{" and (kind == TYPE or kind in (NAME, TARGET) and self.level >= 0 and self.t[self.i - 1] in ("n", "]")):
                self.composite()
                kind = VALUE
            else:
                return kind

    def index(self) -> None:
        level, self.level = self.level, 0
        if self.k() != ":":
            self.expression()
        if self.k() == ":":
            for _ in range(2):
                if not self.take(":"):
                    break
                if self.k() not in (":", "]"):
                    self.expression()
        else:
            while self.take(","):
                if self.k() == "]":
                    break
                self.type_()
        self.level = level
        self.need("]")

    def arguments(self) -> None:
        level, self.level = self.level, 0
        self.need("(")
        while self.k() != ")":
            self.expression()
            self.take("...")
            if not self.take(","):
                break
        self.level = level
        self.need(")")

    def composite(self) -> None:
        level, self.level = self.level, 0
        self.need("{")
        while self.k() != "}":
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                break
        self.level = level
        self.need("}")

    def element(self) -> None:
        if self.k() == "{":
            self.composite()
        else:
            self.expression()


_STATEMENTS = {
    "return": Go.s_return, "break": Go.s_label, "continue": Go.s_label, "goto": Go.s_goto, "fallthrough": Go.s_nothing, "go": Go.s_call, "defer": Go.s_call,
    "if": Go.s_if, "for": Go.s_for, "switch": Go.s_switch, "select": Go.s_select,
}


class GoShaper(Shaper):
    """Line ends after some tokens are semicolons, so most lines are whole statements."""

    def piece(self, s: str) -> list:
        toks = self.token.findall(s)
        if toks and s[-1:] == "\n" and toks[-1] in _ENDS:
            toks.append(";")
        if len(toks) > 2 and toks[-1] == ";" and toks[0] in ("n", "return", "go", "defer"):
            p = self.parser([*toks, ""])
            try:
                p.simple_only()
                return [Stmt(toks)]
            except SyntaxFault:
                pass
        return toks


_GO = GoShaper(_TOKEN, Go, None, lambda toks: [";"] if toks[-1] in _ENDS else [])


def check(text: str) -> list[str]:
    return _GO.check(shape(text) + "\n")
