"""Java source to rows, on masked text."""

from __future__ import annotations

import re

from .docs import javadoc
from .masking import Source, split_top
from .records import class_row, document, document_from, param, symbol

_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\s+)*"
_TYPE = re.compile(rf"(?P<mods>{_MODS})\b(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)\s*(?:<[^{{(]*?>)?\s*(?:\([^)]*\)\s*)?(?:extends\s+(?P<base>[\w.]+)[^{{]*?)?(?:implements\s+[^{{]+)?(?:permits\s+[^{{]+)?\{{")
_MEMBER = re.compile(rf"(?P<mods>{_MODS})(?:<[^>]+>\s*)?(?:(?P<type>[\w.]+(?:\s*<[^;(){{}}=]*>)?(?:\s*\[\s*\])*)\s+)?(?P<name>\w+)\s*\(")
_NO_MEMBER = {"if", "for", "while", "switch", "catch", "return", "new", "synchronized", "super", "this", "try", "throw", "assert", "else"}


def _params(src: Source, a: int, b: int) -> list[dict]:
    out = []
    for lo, hi in split_top(src.text[a:b], src.code[a:b]):
        part = re.sub(r"@[\w.]+(?:\([^)]*\))?\s*|\bfinal\s+", "", src.text[a + lo : a + hi].strip())
        m = re.match(r"(.+?)(\.\.\.|\s)\s*(\w+)\s*((?:\[\s*\])*)$", part, re.S)
        if m:
            kind = re.sub(r"\s+", "", m.group(1))
            out.append(param(m.group(3), re.sub(r"<.*>", "", kind.split(".")[-1] if "<" not in kind else kind), rest=m.group(2) == "..."))
    return out


def parse(content: str) -> dict:
    """Rows of a compilation unit: for each type its methods, then its constructors."""
    src = Source(content, templates=False)
    types = [(m, src.match(m.end() - 1)) for m in _TYPE.finditer(src.code)]
    rows, classes = [], []
    for m, end in types:
        name, inner = m.group("name"), [(a.start(), b) for a, b in types if m.end() <= a.start() < end]
        methods, constructors, at = [], [], m.end()
        while at < end:
            f = _MEMBER.search(src.code, at, end)
            if not f:
                break
            nested = next((b for a, b in inner if a <= f.start() < b), None)
            skipped = src.code.find("{", at, f.start())
            if nested or skipped >= 0:
                at = nested or src.match(skipped)
                continue
            close = src.match(f.end() - 1, "()")
            tail = re.compile(r"\s*(?:throws\s+([\w.,\s]+?))?\s*([{;])").match(src.code, close)
            is_constructor = f.group("name") == name and not f.group("type")
            if f.group("name") in _NO_MEMBER or not tail or not (f.group("type") or is_constructor) or f.group("type") in ("new", "return", "else", "throw"):
                at = close
                continue
            stop = src.match(tail.end() - 1) if tail.group(2) == "{" else tail.end()
            params = _params(src, f.end(), close - 1)
            start = f.start() + len(f.group()) - len(f.group().lstrip())
            row = symbol(
                f.group("name"),
                class_name=name,
                kind="method",
                signature=f"({', '.join(f'{p['type']} {p['name']}' for p in params)})",
                parameters=params,
                returns={"type": "" if is_constructor else re.sub(r"\s+", "", f.group("type")), "description": ""},
                throws=[t.strip() for t in (tail.group(1) or "").split(",") if t.strip()],
                modifiers=sorted(f.group("mods").split()),
                lines={"start": src.line(start), "end": None},
                is_constructor=is_constructor,
                is_static="static" in f.group("mods").split(),
                is_public="public" in f.group("mods").split(),
                method_kind="constructor" if is_constructor else "method",
            )
            document([row], javadoc(src.comment_before(start)))
            (constructors if is_constructor else methods).append(row)
            at = stop
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        doc = javadoc(src.comment_before(start))
        rows += methods + constructors
        classes.append(class_row(name, description=doc["description"], extends=m.group("base") or "", n_methods=len(methods) + len(constructors), lines={"start": src.line(start), "end": None}))
    imports = [{"type": "import", "module": m.group(1), "name": None, "alias": None, "level": 0, "line": src.line(m.start())} for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", src.code)]
    return document_from(content, "", rows, classes, imports)
