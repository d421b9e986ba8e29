"""What the parsers share: shapes, tokens, errors and recovery.

A source text is first reduced to its shape: comments vanish, strings become `"`, numbers `0`, identifiers `n`; what no
rule of the language reads becomes BAD. The grammar only needs the shape, and shapes repeat: a piece up to `;` or a line
end that is a whole simple statement by itself is parsed once and remembered as one `Stmt` token, which is opened again
wherever the grammar wants something else there. Memory of pieces is bounded and holds no state of a file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: A character that no rule reads, and a line end inside a string or comment that doesn't end a line of code.
BAD, INNER = "\x02", "\x01"
#: Pieces remembered per language and worker.
MEMO = 100_000


class SyntaxFault(Exception):
    """An error at the current token."""


class Stmt:
    """A whole simple statement whose tokens were parsed before."""

    __slots__ = ("raw",)

    def __init__(self, raw: list):
        self.raw = raw


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def ident_pattern(keep: frozenset[str], dollar: bool = False) -> re.Pattern:
    """Identifiers other than the words to keep; in some languages `$` is a letter."""
    letters, first = (r"\w$", r"(?:[^\W\d]|\$)") if dollar else (r"\w", r"[^\W\d]")
    return re.compile(rf"(?<![{letters}])(?!(?:{'|'.join(sorted(keep))})(?![{letters}])){first}[{letters}]*")


def levels(toks: list, most: int) -> bool:
    """Are brackets nested deeper than `most`?"""
    if len(toks) <= most:
        return False
    depth = 0
    for t in toks:
        if t in ("(", "[", "{"):
            depth += 1
            if depth > most:
                return True
        elif t in (")", "]", "}"):
            depth -= 1
    return False


def inner(text: str) -> str:
    return INNER * text.count("\n")


class Parser:
    """Token access and error handling; languages add `statement`."""

    name = ""
    #: Tokens that begin a statement or end a block: where panic mode stops.
    sync: frozenset[str] = frozenset()

    def __init__(self, toks: list, starts: list[int] | None = None):
        self.t, self.i = toks, 0
        self.starts, self.errors = starts, []

    # --- tokens

    def k(self) -> str:
        """The current token; a remembered statement is opened."""
        t = self.t[self.i]
        if t.__class__ is Stmt:
            self.t[self.i : self.i + 1] = t.raw
            return self.k()
        return t

    def take(self, what: str) -> bool:
        if self.k() == what:
            self.i += 1
            return True
        return False

    def need(self, what: str) -> None:
        if self.k() != what:
            self.fail(f"expected {what!r}")
        self.i += 1

    def fail(self, why: str):
        t = self.k()
        shown = {"": "end of input", BAD: "a character or token the language doesn't have", "n": "a name", "0": "a number", '"': "a string", "\n": "end of line"}.get(t, repr(t))
        raise SyntaxFault(f"{why}, found {shown}")

    # --- errors

    def line(self) -> int:
        return bisect_right(self.starts, self.i) if self.starts else 0

    def note(self, why: str) -> None:
        self.errors.append(f"line {self.line()}: {why}")

    def recover(self, at: int) -> None:
        """Panic mode: skip to the next token that can begin a statement or ends a block, but past where the error arose."""
        if self.i <= at:
            self.i = at + 1 if self.t[at] != "" else at
        while (t := self.t[self.i]) != "" and t not in self.sync:
            self.i += 1
            if t == ";":
                break

    def guarded(self, rule) -> None:
        """Run a statement rule; without line starts (the quick pass) the first error ends the parse."""
        at = self.i
        try:
            rule()
        except SyntaxFault as e:
            if self.starts is None:
                raise
            self.note(str(e))
            self.recover(at)


class Shaper:
    """Texts to tokens of a brace language."""

    def __init__(self, token: re.Pattern, parser: type[Parser], starts_statement, line_end):
        self.token, self.parser, self.ok_start, self.line_end = token, parser, starts_statement, line_end
        self.memo: dict[str, list] = {}

    def piece(self, s: str) -> list:
        toks = self.token.findall(s)
        if toks and self.line_end and s[-1:] == "\n":
            toks += self.line_end(toks)
        if len(toks) > 1 and s.rstrip()[-1:] == ";" and self.ok_start(toks[0]):
            p = self.parser([*toks, ""])
            try:
                p.simple_only()
                if p.i >= len(p.t) - 1:
                    return [Stmt(toks)]
            except SyntaxFault:
                pass
        return toks

    def tokens(self, shape: str) -> list:
        memo, out = self.memo, []
        for s in re.findall(r"[^;\n]*[;\n]|[^;\n]+", shape.replace(INNER, "")):
            s = s.lstrip(" \t\r\f")
            got = memo.get(s)
            if got is None:
                if len(memo) > MEMO:
                    memo.clear()
                got = memo[s] = self.piece(s)
            out += got
        out.append("")
        return out

    def detailed(self, shape: str) -> tuple[list, list[int]]:
        """Plain tokens and the place of each line's first."""
        out, starts = [], []
        for s in shape.replace(INNER, "\n").split("\n") if self.line_end is None else _lines(shape):
            starts.append(len(out))
            toks = self.token.findall(s)
            if toks and self.line_end:
                toks += self.line_end(toks)
            out += toks
        out.append("")
        return out, starts

    def check(self, shape: str) -> list[str]:
        quick = self.parser(self.tokens(shape))
        try:
            quick.file()
            return []
        except SyntaxFault:
            pass
        toks, starts = self.detailed(shape)
        slow = self.parser(toks, starts)
        try:
            slow.file()
        except SyntaxFault as e:
            slow.note(str(e))
        return slow.errors or ["line 0: not a text of this language"]


def _lines(shape: str) -> list[str]:
    """Lines where an inner line end (in a string) doesn't count as an end of the statement; empty ones keep the count."""
    out = []
    for s in shape.split("\n"):
        out.append(s.replace(INNER, ""))
        out += [""] * s.count(INNER)
    return out
