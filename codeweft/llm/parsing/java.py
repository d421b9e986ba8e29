"""Java."""

from __future__ import annotations

import re

from codeweft.llm.parsing.base import BAD, Parser, Shaper, Stmt, SyntaxFault, ident_pattern, inner, words

PRIMITIVES = words("boolean byte char double float int long short")
MODIFIERS = words("abstract final native private protected public static strictfp synchronized transient volatile default")
KEYWORDS = PRIMITIVES | MODIFIERS | words(
    "assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try void while null true false"
)
#: Words with a meaning in some places and names elsewhere.
CONTEXTUAL = words("var record sealed permits yield when non")
_NAMES = CONTEXTUAL | {"n"}

_IDENT = ident_pattern(KEYWORDS | CONTEXTUAL, dollar=True)
_NUMBER = re.compile(
    r"(?<![\w$.])(?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+[fFdD]?|[lL])?|0[bB][01](?:_*[01])*[lL]?|(?:\d(?:_*\d)*(?:\.(?:\d(?:_*\d)*)?)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?[lLfFdD]?)(?![\w$])"
)
_BAD_NUMBER = re.compile(r"(?<![\w$])[1-9][\w$]*|(?<![\w$])0[\w$]+")
_SCAN = re.compile(r'''//[^\n]*|/\*.*?\*/|"""[ \t]*\n(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'|/\*|["'\x01\x02]''', re.DOTALL)
_TOKEN = re.compile(r"->|::|\.\.\.|==|!=|<=|\+\+|--|\+=|-=|\*=|/=|%=|&&|\|\||&=|\|=|\^=|<<=|<<|[A-Za-z]+|\S")


def _replace(m: re.Match) -> str:
    s = m[0]
    if len(s) == 1 or s == "/*":
        return BAD
    return " " + inner(s) if s[0] == "/" else '"' + inner(s)


def shape(text: str) -> str:
    s = _IDENT.sub("n", _SCAN.sub(_replace, text))
    s = _NUMBER.sub("0", s)
    return _BAD_NUMBER.sub(BAD, s)


_BINARY = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
}
_ASSIGN = words("= += -= *= /= %= &= |= ^= <<=")
#: What an expression is: a target, something that may stand as a statement, or neither.
TARGET, ACTION, VALUE = 1, 2, 0
_AFTER_CAST = words("n 0 \" ( ! ~ this super new null true false switch") | CONTEXTUAL | PRIMITIVES | {"void"}


class Java(Parser):
    name = "java"
    sync = words("; } { class interface enum if for while do switch try return throw public private protected static import")

    def at(self, n: int) -> str:
        j = self.i
        while n:
            j += 1
            if j >= len(self.t):
                return ""
            if self.t[j].__class__ is Stmt:
                self.t[j : j + 1] = self.t[j].raw
            n -= 1
        return self.t[j] if j < len(self.t) else ""

    def ident(self) -> None:
        if self.k() not in _NAMES:
            self.fail("expected a name")
        self.i += 1

    def file(self) -> None:
        at = self.i
        self.annotations()
        if self.k() == "package":
            self.i += 1
            self.guarded(self.package)
        else:
            self.i = at
        while self.k() == "import" or self.k() == ";":
            self.guarded(self.import_)
        while self.k() != "":
            self.guarded(self.top)

    def package(self) -> None:
        self.qualified()
        self.need(";")

    def qualified(self) -> None:
        self.ident()
        while self.take("."):
            self.ident()

    def import_(self) -> None:
        if self.take(";"):
            return
        self.need("import")
        self.take("static")
        self.ident()
        while self.take("."):
            if self.take("*"):
                break
            self.ident()
        self.need(";")

    def top(self) -> None:
        if self.take(";"):
            return
        self.modifiers()
        if not self.type_declaration():
            self.fail("expected a class, interface, enum or record")

    def modifiers(self) -> None:
        while True:
            t = self.k()
            if t == "@" and self.at(1) != "interface":
                self.annotation()
            elif t in MODIFIERS and not (t == "default" and self.at(1) in (":", "->")) and not (t == "synchronized" and self.at(1) == "("):
                self.i += 1
            elif t == "sealed" and (self.at(1) in MODIFIERS or self.at(1) in ("class", "interface")):
                self.i += 1
            elif t == "non" and self.at(1) == "-" and self.at(2) == "sealed":
                self.i += 3
            else:
                return

    def annotations(self) -> None:
        while self.k() == "@" and self.at(1) != "interface":
            self.annotation()

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("("):
            while self.k() != ")":
                if self.k() in _NAMES and self.at(1) == "=":
                    self.i += 2
                self.element()
                if not self.take(","):
                    break
            self.need(")")

    def element(self) -> None:
        if self.k() == "@":
            self.annotation()
        elif self.k() == "{":
            self.array()
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        t = self.k()
        if t == "class":
            self.i += 1
            self.ident()
            self.type_params()
            if self.take("extends"):
                self.type_()
            self.type_list("implements")
            self.type_list("permits")
            self.class_body()
        elif t == "interface":
            self.i += 1
            self.ident()
            self.type_params()
            self.type_list("extends")
            self.type_list("permits")
            self.class_body()
        elif t == "@" and self.at(1) == "interface":
            self.i += 2
            self.ident()
            self.class_body()
        elif t == "enum":
            self.i += 1
            self.ident()
            self.type_list("implements")
            self.enum_body()
        elif t == "record" and self.at(1) in _NAMES and self.at(2) in ("(", "<"):
            self.i += 2
            self.type_params()
            self.params()
            self.type_list("implements")
            self.class_body()
        else:
            return False
        return True

    def type_list(self, word: str) -> None:
        if self.take(word):
            self.type_()
            while self.take(","):
                self.type_()

    def enum_body(self) -> None:
        self.need("{")
        while self.k() not in (";", "}"):
            self.annotations()
            self.ident()
            if self.k() == "(":
                self.arguments()
            if self.k() == "{":
                self.class_body()
            if not self.take(","):
                break
        if self.take(";"):
            self.members()
        self.need("}")

    def class_body(self) -> None:
        self.need("{")
        self.members()
        self.i += 1

    def members(self) -> None:
        while (t := self.k()) != "}":
            if t == "":
                self.fail("expected '}'")
            self.guarded(self.member)

    def member(self) -> None:
        if self.take(";"):
            return
        if self.k() == "{":
            self.block()
            return
        if self.k() == "static" and self.at(1) == "{":
            self.i += 1
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_params()
        self.annotations()
        if self.k() in _NAMES and self.at(1) in ("(", "{"):
            self.i += 1
            if self.k() == "(":
                self.rest_of_method()
            else:
                self.block()
            return
        if self.k() == "void":
            self.i += 1
            self.ident()
            self.rest_of_method()
            return
        self.type_()
        self.ident()
        if self.k() == "(":
            self.rest_of_method()
        else:
            self.declarators()
            self.need(";")

    def rest_of_method(self) -> None:
        self.params()
        self.dims()
        self.type_list("throws")
        if self.take("default"):
            self.element()
        if not self.take(";"):
            self.block()

    def dims(self) -> None:
        self.annotations()
        while self.k() == "[":
            self.i += 1
            self.need("]")

    def params(self) -> None:
        self.need("(")
        while self.k() != ")":
            self.modifiers()
            self.type_()
            self.annotations()
            rest = self.take("...")
            if self.k() in _NAMES and self.at(1) == ".":
                self.i += 2
            if not self.take("this"):
                self.ident()
            self.dims()
            if rest and self.k() != ")":
                self.fail("a variable number of arguments must come last")
            if not self.take(","):
                break
            if self.k() == ")":
                self.fail("expected a parameter")
        self.need(")")

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initial()
            if not self.take(","):
                return
            self.ident()

    def initial(self) -> None:
        if self.k() == "{":
            self.array()
        else:
            self.expression()

    def array(self) -> None:
        self.need("{")
        while self.k() != "}":
            if self.k() == "@":
                self.annotation()
            else:
                self.initial()
            if not self.take(","):
                break
        self.need("}")

    # --- types

    def type_params(self) -> None:
        if not self.take("<"):
            return
        while True:
            self.annotations()
            self.ident()
            if self.take("extends"):
                self.type_()
                while self.take("&"):
                    self.type_()
            if not self.take(","):
                break
        self.need(">")

    def type_(self) -> None:
        self.annotations()
        if self.k() in PRIMITIVES:
            self.i += 1
        else:
            while True:
                self.annotations()
                self.ident()
                if self.k() == "<":
                    self.type_args()
                if self.k() != "." or self.at(1) not in _NAMES and self.at(1) != "@":
                    break
                self.i += 1
        self.array_dims()

    def array_dims(self) -> None:
        while self.k() == "[" and self.at(1) == "]":
            self.i += 2

    def type_args(self) -> None:
        self.need("<")
        if not self.take(">"):
            while True:
                self.annotations()
                if self.take("?"):
                    if self.k() in ("extends", "super"):
                        self.i += 1
                        self.type_()
                else:
                    self.type_()
                    while self.take("&"):
                        self.type_()
                if not self.take(","):
                    break
            self.need(">")

    # --- statements

    def simple_only(self) -> None:
        while self.k() != "":
            if self.k() not in _NAMES and self.k() not in PRIMITIVES and self.k() not in ("return", "throw", "this", "super", "new", "final", "assert"):
                self.fail("not simple")
            self.statement()
            if self.t[self.i - 1] != ";":
                self.fail("not simple")

    def block(self) -> None:
        self.need("{")
        while (t := self.t[self.i]) != "}":
            if t == "":
                self.fail("expected '}'")
            self.guarded(self.statement)
        self.i += 1

    def statement(self, alone: bool = False) -> None:
        t = self.t[self.i]
        if t.__class__ is Stmt:
            self.i += 1
            return
        rule = _STATEMENTS.get(t)
        if rule:
            self.i += 1
            rule(self)
        elif t == "{":
            self.block()
        elif t == ";":
            self.i += 1
        elif t in _NAMES and self.at(1) == ":":
            self.i += 2
            self.statement()
        elif t == "yield" and self.at(1) not in _ASSIGN and self.at(1) not in (".", "(", "[", "++", "--"):
            self.i += 1
            self.expression()
            self.need(";")
        elif t == "switch":
            self.switch()
        else:
            self.local_or_expression()

    def local_or_expression(self) -> None:
        at = self.i
        self.modifiers()
        if self.k() in ("class", "interface", "enum") or self.k() == "record" and self.at(2) in ("(", "<"):
            self.type_declaration()
            return
        if self.i > at or self.local_ahead():
            self.type_()
            self.ident()
            self.declarators()
        elif self.expression() == VALUE:
            self.fail("this can't stand as a statement")
        self.need(";")

    def local_ahead(self) -> bool:
        """Does a type and a name follow?"""
        t = self.k()
        if t in PRIMITIVES:
            return self.at(1) not in (".", "::") and not (self.at(1) == "[" and self.at(3) in (".", "::"))
        if t not in _NAMES:
            return False
        n = self.at(1)
        if n in _NAMES:
            return True
        if n not in ("<", ".", "["):
            return False
        at = self.i
        try:
            self.type_()
            return self.k() in _NAMES
        except SyntaxFault:
            return False
        finally:
            self.i = at

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.condition()
        self.statement()
        if self.k() == "else":
            self.i += 1
            self.statement()

    def s_while(self) -> None:
        self.condition()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self) -> None:
        self.need("(")
        if self.k() != ";":
            at = self.i
            self.modifiers()
            if self.i > at or self.local_ahead():
                self.type_()
                self.ident()
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
                self.declarators()
            else:
                self.expressions()
        self.need(";")
        if self.k() != ";":
            self.expression()
        self.need(";")
        if self.k() != ")":
            self.expressions()
        self.need(")")
        self.statement()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def s_jump(self) -> None:
        if self.k() in _NAMES:
            self.i += 1
        self.need(";")

    def s_return(self) -> None:
        if self.k() != ";":
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.expression()
        self.need(";")

    def s_assert(self) -> None:
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def s_synchronized(self) -> None:
        self.condition()
        self.block()

    def s_try(self) -> None:
        resources = self.k() == "("
        if resources:
            self.i += 1
            while self.k() != ")":
                at = self.i
                self.modifiers()
                if self.i > at or self.local_ahead():
                    self.type_()
                    self.ident()
                    self.need("=")
                self.expression()
                if not self.take(";"):
                    break
            self.need(")")
        self.block()
        caught = False
        while self.k() == "catch":
            self.i += 1
            caught = True
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.ident()
            self.need(")")
            self.block()
        if self.k() == "finally":
            self.i += 1
            self.block()
        elif not caught and not resources:
            self.fail("expected 'catch' or 'finally'")

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        while self.k() != "}":
            if self.take("case"):
                while True:
                    if not self.take("default"):
                        self.case_label()
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if self.k() == "{":
                    self.block()
                elif self.k() == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.t[self.i] not in ("case", "default", "}", ""):
                    self.guarded(self.statement)
        self.i += 1

    def case_label(self) -> None:
        if self.k() == "final" or self.k() in _NAMES and (self.at(1) in _NAMES or self.at(1) == "("):
            self.pattern()
        else:
            self.ternary()

    def pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.take("("):
            while self.k() != ")":
                self.pattern()
                if not self.take(","):
                    break
            self.need(")")
            if self.k() in _NAMES and self.k() != "when":
                self.i += 1
        else:
            self.ident()

    # --- expressions

    def expression(self) -> int:
        kind = self.ternary()
        t = self.k()
        if t in _ASSIGN or t == ">" and self.shift_assign():
            if kind != TARGET:
                self.fail("can't assign to this")
            if t != ">":
                self.i += 1
            self.expression()
            kind = ACTION
        elif kind == TARGET:
            kind = VALUE
        return kind

    def shift_assign(self) -> bool:
        j = self.i
        while self.t[j] == ">":
            j += 1
        if self.t[j] == "=" and 2 <= j - self.i <= 3:
            self.i = j + 1
            return True
        return False

    def ternary(self) -> int:
        if self.lambda_ahead():
            return VALUE
        kind = self.binary(1)
        if self.take("?"):
            self.expression()
            self.need(":")
            if not self.lambda_ahead():
                self.ternary()
            return VALUE
        return kind

    def lambda_ahead(self) -> bool:
        t = self.k()
        if t in _NAMES and self.at(1) == "->":
            self.i += 2
        elif t == "(":
            if self.at(1) == "(":
                return False
            j, depth = self.i, 0
            while True:
                x = self.t[j]
                if x == "(":
                    depth += 1
                elif x == ")":
                    depth -= 1
                    if not depth:
                        break
                elif x == "" or x.__class__ is Stmt:
                    return False
                j += 1
            if self.t[j + 1] != "->":
                return False
            if self.at(1) in _NAMES and self.at(2) in (",", ")"):
                self.i += 1
                self.ident()
                while self.take(","):
                    self.ident()
                self.need(")")
            else:
                self.params()
            self.need("->")
        else:
            return False
        if self.k() == "{":
            self.block()
        else:
            self.expression()
        return True

    def binary(self, least: int) -> int:
        kind = self.unary()
        while True:
            op = self.k()
            p = _BINARY.get(op, 0)
            if op == ">":
                j = self.i
                while self.t[j] == ">":
                    j += 1
                n = j - self.i
                if self.t[j] == "=" and n > 1:
                    return kind
                if n > 1:
                    if n > 3 or least > 8:
                        return kind
                    self.i, p = j - 1, 8
                elif self.t[j] == "=":
                    self.i += 1
            if p < least or not p:
                return kind
            self.i += 1
            if op == "instanceof":
                if self.k() == "final" or self.k() in _NAMES or self.k() in PRIMITIVES or self.k() == "@":
                    self.modifiers()
                    self.type_()
                    if self.k() == "(":
                        while self.k() != ")":
                            self.i += 1
                            self.pattern()
                        self.i += 1
                    elif self.k() in _NAMES:
                        self.i += 1
                else:
                    self.fail("expected a type")
            elif not self.lambda_ahead():
                self.binary(p + 1)
            kind = VALUE

    def unary(self) -> int:
        t = self.k()
        if t in ("++", "--"):
            self.i += 1
            if self.unary() != TARGET:
                self.fail("can't count this up or down")
            return ACTION
        if t in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return VALUE
        if t == "(" and self.cast():
            return VALUE
        kind = self.postfix()
        if self.k() in ("++", "--"):
            if kind != TARGET:
                self.fail("can't count this up or down")
            self.i += 1
            return ACTION
        return kind

    def cast(self) -> bool:
        n = self.at(1)
        if n not in PRIMITIVES and n not in _NAMES and n != "@":
            return False
        at = self.i
        self.i += 1
        try:
            self.type_()
            while self.take("&"):
                self.type_()
            self.need(")")
            plain = n in PRIMITIVES and self.t[self.i - 2] in PRIMITIVES
            if self.k() in _AFTER_CAST or plain and self.k() in ("+", "-", "++", "--"):
                if not self.lambda_ahead():
                    self.unary()
                return True
        except SyntaxFault:
            if self.k() == "":
                raise
        self.i = at
        return False

    def arguments(self) -> None:
        self.need("(")
        if not self.take(")"):
            self.expressions()
            self.need(")")

    def postfix(self) -> int:
        kind = self.primary()
        while True:
            t = self.k()
            if t == ".":
                self.i += 1
                if self.k() == "<":
                    self.type_args()
                t = self.k()
                if t == "new":
                    self.i += 1
                    self.creator()
                    kind = ACTION
                elif t in ("this", "class", "super"):
                    self.i += 1
                    kind = VALUE
                else:
                    self.ident()
                    kind = TARGET
            elif t == "(" and kind == TARGET and self.t[self.i - 1] in _NAMES:
                self.arguments()
                kind = ACTION
            elif t == "(" and self.t[self.i - 1] in ("this", "super"):
                self.arguments()
                kind = ACTION
            elif t == "[":
                if self.at(1) == "]":
                    self.array_dims()
                    if self.k() not in (".", "::"):
                        self.fail("expected an index")
                    continue
                self.i += 1
                self.expression()
                self.need("]")
                kind = TARGET
            elif t == "::":
                self.i += 1
                if self.k() == "<":
                    self.type_args()
                if not self.take("new"):
                    self.ident()
                kind = VALUE
            else:
                return kind

    def primary(self) -> int:
        t = self.k()
        if t in _NAMES:
            if self.at(1) == "<":
                at = self.i
                try:
                    self.type_()
                    if self.k() == "::":
                        return VALUE
                except SyntaxFault:
                    pass
                self.i = at
            self.i += 1
            return TARGET
        if t in ('"', "0", "this", "super", "null", "true", "false"):
            self.i += 1
            return VALUE
        if t == "(":
            self.i += 1
            kind = self.ternary_or_assign()
            self.need(")")
            return TARGET if kind == TARGET else VALUE
        if t == "new":
            self.i += 1
            self.creator()
            return ACTION
        if t == "switch":
            self.switch()
            return VALUE
        if t in PRIMITIVES or t == "void":
            self.i += 1
            self.array_dims()
            if self.k() not in (".", "::"):
                self.fail("expected an expression")
            return VALUE
        self.fail("expected an expression")

    def ternary_or_assign(self) -> int:
        at = self.i
        kind = self.expression()
        return TARGET if kind == VALUE and self.i == at + 1 and self.t[at] in _NAMES else kind

    def creator(self) -> None:
        self.annotations()
        if self.k() == "<":
            self.type_args()
        if self.k() in PRIMITIVES:
            self.i += 1
        else:
            while True:
                self.ident()
                if self.k() == "<":
                    self.type_args()
                if not self.take("."):
                    break
        if self.k() == "[":
            sized = False
            while self.k() == "[":
                self.i += 1
                if not self.take("]"):
                    sized = True
                    self.expression()
                    self.need("]")
                elif not sized:
                    pass
            if not sized:
                self.array()
            return
        self.arguments()
        if self.k() == "{":
            self.class_body()


_STATEMENTS = {
    "if": Java.s_if, "while": Java.s_while, "do": Java.s_do, "for": Java.s_for, "break": Java.s_jump, "continue": Java.s_jump, "return": Java.s_return,
    "throw": Java.s_throw, "assert": Java.s_assert, "synchronized": Java.s_synchronized, "try": Java.s_try,
}

_JAVA = Shaper(_TOKEN, Java, lambda t: t in _NAMES or t in PRIMITIVES or t in ("return", "throw", "this", "super", "new", "final", "assert"), None)


def check(text: str) -> list[str]:
    return _JAVA.check(shape(text))
