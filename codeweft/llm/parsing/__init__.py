"""Syntax checkers: recursive descent for statements, precedence climbing for expressions, panic-mode recovery."""

from codeweft.llm.parsing.check import EXTENSIONS, check

__all__ = ["EXTENSIONS", "check"]
