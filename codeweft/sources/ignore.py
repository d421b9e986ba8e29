"""Ignore files: patterns as git reads them, as one predicate over relative paths."""

from __future__ import annotations

import re
from collections.abc import Iterable


def _translate(pattern: str) -> tuple[re.Pattern, bool, bool] | None:
    """(expression, negated, directories only) of a line; None for blank lines and comments."""
    line = pattern.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith("\\") else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out += "/.*"
            i += 3
        elif line.startswith("**", i):
            out += ".*"
            i += 2
        elif line[i] == "*":
            out += "[^/]*"
            i += 1
        elif line[i] == "?":
            out += "[^/]"
            i += 1
        elif line[i] == "[" and (j := line.find("]", i + 2)) > 0:
            body = line[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out += re.escape(line[i])
            i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"(?P<below>/.*)?\Z"), negated, only_dirs


class Ignore:
    """The last pattern that fits decides."""

    def __init__(self, lines: Iterable[str]):
        self.rules = [r for r in map(_translate, lines) if r]

    def __call__(self, path: str, is_dir: bool = False) -> bool:
        ignored = False
        for expression, negated, only_dirs in self.rules:
            m = expression.match(path)
            if m and (not only_dirs or is_dir or m["below"]):
                ignored = not negated
        return ignored
