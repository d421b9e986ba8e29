"""Dispatch by extension."""

from __future__ import annotations

import sys

from codeweft.llm.parsing import go, java, javascript, python

#: Extension -> (language, checker).
EXTENSIONS = {
    "py": ("python", python.check),
    "pyi": ("python", python.check),
    "js": ("javascript", javascript.check_js),
    "jsx": ("javascript", javascript.check_js),
    "mjs": ("javascript", javascript.check_js),
    "cjs": ("javascript", javascript.check_js),
    "ts": ("typescript", javascript.check_ts),
    "mts": ("typescript", javascript.check_ts),
    "cts": ("typescript", javascript.check_ts),
    "tsx": ("typescript", javascript.check_tsx),
    "java": ("java", java.check),
    "go": ("go", go.check),
}


def check(path: str, content: str) -> tuple[str | None, list[str] | None]:
    """The language a path's extension names and all syntax errors, first cause first; (None, None) for other languages."""
    known = EXTENSIONS.get(path.rpartition(".")[2].lower()) if "." in path else None
    if known is None:
        return None, None
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    if text[:1] == "﻿":
        text = text[1:]
    # A rule calls few others before it reads a token, so no text can need more; such calls take no room on the C stack.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000 + 30 * len(text)))
    return known[0], known[1](text)
