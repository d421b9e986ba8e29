"""A tokenizer for languages with braces, and bracket matching; what the JavaScript and Go extractors stand on."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex, op
    text: str
    start: int
    end: int
    fresh: bool  # first of its line


_JS = re.compile(
    r"""(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<tick>`)|(?P<number>\.?\d[\w.]*)|(?P<name>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<op>=>|\.\.\.|\?\.(?!\d)|[-+*/%&|^!=<>?]=+|\+\+|--|&&|\|\||\?\?|.)""",
    re.S,
)
_GO = re.compile(
    r"""(?P<space>[^\S\n]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*`?)|(?P<number>\.?\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<op>\.\.\.|:=|<-|[-+*/%&|^!=<>]=|\+\+|--|&&|\|\||.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_OPEN = {"(": ")", "[": "]", "{": "}"}


class Scan:
    """Tokens of a text, the partner of every bracket, and lines."""

    def __init__(self, text: str, go: bool = False):
        self.text = text
        self.tokens: list[Token] = []
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        pos, fresh, pattern = 0, True, _GO if go else _JS
        while pos < len(text):
            m = pattern.match(text, pos)
            kind, s = m.lastgroup, m[0]
            pos = m.end()
            if kind == "line":
                fresh = True
            elif kind == "comment":
                fresh |= "\n" in s
            elif kind != "space":
                if kind == "tick":
                    pos = self._template(pos)
                    kind = "template"
                elif s == "/" and not go and self._value_next() and (r := _REGEX.match(text, m.start())):
                    kind, pos = "regex", r.end()
                self.tokens.append(Token(kind, text[m.start() : pos], m.start(), pos, fresh))
                fresh = False
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op":
                if t.text in _OPEN:
                    stack.append(i)
                elif t.text in ")]}":
                    while stack:
                        j = stack.pop()
                        if _OPEN[self.tokens[j].text] == t.text:
                            self.partner[i], self.partner[j] = j, i
                            break
        for j in stack:
            self.partner[j] = len(self.tokens)

    def _template(self, pos: int) -> int:
        depth = 0
        while pos < len(self.text):
            c = self.text[pos]
            if c == "\\":
                pos += 1
            elif c == "`" and not depth:
                return pos + 1
            elif self.text.startswith("${", pos):
                depth += 1
                pos += 1
            elif c == "}" and depth:
                depth -= 1
            pos += 1
        return pos

    def _value_next(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.kind == "op" and t.text not in (")", "]", "}") or t.text in ("return", "typeof", "case", "in", "of")

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def close(self, i: int) -> int:
        """The partner of an opening bracket."""
        return self.partner.get(i, len(self.tokens))

    def slice(self, i: int, j: int) -> str:
        """The text of tokens i to j, j excluded."""
        if i >= j or i >= len(self.tokens):
            return ""
        return self.text[self.tokens[i].start : self.tokens[min(j, len(self.tokens)) - 1].end]

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def col(self, offset: int) -> int:
        return len(self.text[self.text.rfind("\n", 0, offset) + 1 : offset].encode())

    def span(self, i: int, j: int) -> tuple[int, int, int, int]:
        """Lines and columns of tokens i to j, j excluded."""
        a, b = self.tokens[i].start, self.tokens[max(i, min(j, len(self.tokens)) - 1)].end
        return self.line(a), self.line(b), self.col(a), self.col(b)

    def split(self, i: int, j: int, by: str = ",") -> list[tuple[int, int]]:
        """Token ranges between separators outside of brackets and, in types, angle brackets."""
        out, begin, k, angle = [], i, i, 0
        while k < j:
            t = self.tokens[k]
            if t.kind == "op" and t.text in _OPEN:
                k = self.close(k)
            elif t.text == "<":
                angle += 1
            elif t.text == ">" and angle:
                angle -= 1
            elif t.text == by and t.kind == "op" and not angle:
                out.append((begin, k))
                begin = k + 1
            k += 1
        if begin < j:
            out.append((begin, j))
        return out
