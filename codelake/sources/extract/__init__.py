"""Parsers from source text to rows, one for each language.

A parser is ``parse(content) -> dict`` with summary, functions, classes, imports and variables;
:data:`PARSERS` is the registry by language. A parser that raises makes a row in diagnostics, and
no other file suffers.
"""

from __future__ import annotations

from collections.abc import Callable

from . import java, python, script

PARSERS: dict[str, Callable[[str], dict]] = {
    "python": python.parse,
    "javascript": script.parse_javascript,
    "typescript": script.parse_typescript,
    "java": java.parse,
}


def register(language: str, parse: Callable[[str], dict]) -> None:
    """Add or replace the parser of a language."""
    PARSERS[language] = parse
