"""JavaScript and TypeScript source to rows, on masked text (strings, comments and regular
expressions can't mislead it, and brackets are balanced)."""

from __future__ import annotations

import re

from .docs import jsdoc
from .masking import Source, split_top
from .records import class_row, document, document_from, param, symbol

_ID = r"[^\W\d][\w$]*|\$[\w$]*"
_FUNCTION = re.compile(rf"(?P<exp>\bexport\s+(?:default\s+)?)?(?P<async>\basync\s+)?\bfunction\b\s*(?P<star>\*)?\s*(?P<name>{_ID})\s*(?:<[^(]*>)?\s*\(")
_ARROW = re.compile(rf"(?P<exp>\bexport\s+)?\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=]+)?=\s*(?P<async>async\b\s*)?(?:<[^(]*>\s*)?(?P<head>\(|(?P<one>{_ID})\s*=>|function\b\s*(?P<star>\*)?\s*(?:{_ID})?\s*\()")
_CLASS = re.compile(rf"(?P<exp>\bexport\s+(?:default\s+)?)?\b(?:abstract\s+)?(?P<kind>class|interface)\s+(?P<name>{_ID})\s*(?:<[^{{]*?>)?\s*(?:extends\s+(?P<base>[\w$.]+)[^{{]*?)?(?:implements\s+[^{{]+)?\{{")
_METHOD = re.compile(rf"(?P<mods>(?:\b(?:public|private|protected|static|abstract|readonly|override|async|get|set)\s+)*)(?P<star>\*\s*)?(?P<name>#?(?:{_ID}))\s*\??\s*(?:<[^(]*>)?\(")
# Words that look like a call or a method but are none.
_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "return", "new", "typeof", "super", "constructor_", "with", "do", "else", "await", "throw"}


def _params(src: Source, a: int, b: int, typed: bool) -> list[dict]:
    """Parameters between two positions."""
    text, mask, out = src.text[a:b], src.code[a:b], []
    for lo, hi in split_top(text, mask):
        part, seen = text[lo:hi].strip(), mask[lo:hi].strip()
        part = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", part)
        if re.match(r"\{|\[", part):
            eq = _top_index(seen, "=")
            out.append(param("{...}" if part[0] == "{" else "[...]", "Object", part[eq + 1 :].strip() if eq >= 0 else None, optional=eq >= 0))
            continue
        rest = part.startswith("...")
        part = part.removeprefix("...").strip()
        eq = _top_index(part, "=")
        head, default = (part[:eq].strip(), part[eq + 1 :].strip()) if eq >= 0 else (part, None)
        name, colon, kind = head.partition(":")
        name, optional = name.strip().rstrip("?"), name.strip().endswith("?")
        kind = kind.strip() if colon else ("any" if typed else "Array" if rest else "")
        out.append(param(("..." if rest else "") + name, kind, default, optional=optional or default is not None, rest=rest))
    return out


def _top_index(text: str, char: str) -> int:
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == char and not depth and text[i + 1 : i + 2] not in ("=", ">") and (i == 0 or text[i - 1] not in "=!<>"):
            return i
    return -1


def _signature(params: list[dict], typed: bool, returns: str) -> str:
    parts = [p["name"] + ("?" if typed and p["optional"] and p["default"] is None else "") + (f": {p['type']}" if typed else "") + (f" = {p['default']}" if p["default"] is not None else "") for p in params]
    return f"({', '.join(parts)})" + (f": {returns}" if typed and returns else "")


def _after(src: Source, at: int) -> tuple[str, int]:
    """The declared return type after the parameters, and where it ends."""
    m = re.compile(r"\s*:\s*").match(src.code, at)
    if not m:
        return "", at
    depth, k = 0, m.end()
    while k < len(src.code):
        c = src.code[k]
        if c in "([<" or c == "{" and (depth or not src.code[m.end() : k].strip()):
            depth += 1
        elif c in ")]}" or c == ">" and src.code[k - 1] != "=":
            depth -= 1
        elif not depth and (c in "{;\n" or src.code.startswith("=>", k)):
            break
        k += 1
    return re.sub(r"\s+", " ", src.text[m.end() : k]).strip(), k


def _function(src: Source, name: str, start: int, bracket: int, typed: bool, **flags) -> tuple[dict, int]:
    """A row for a callable whose parameters open at ``bracket``, and its end."""
    close = src.match(bracket, "()")
    params = _params(src, bracket + 1, close - 1, typed)
    returns, at = _after(src, close)
    body = re.compile(r"\s*(?:=>\s*)?\{").match(src.code, at)
    if body:
        end = src.match(body.end() - 1)
    else:
        stop = re.compile(r";|\n(?!\s*[.?:&|+])").search(src.code, at)
        end = stop.start() if stop else len(src.code)
    prefix = ("async " if flags.get("async") else "") + ("*" if flags.get("generator") else "")
    sig = prefix + _signature(params, typed, returns) + (" => {}" if flags.get("arrow") else "")
    row = symbol(name, signature=sig, parameters=params, returns={"type": returns, "description": ""}, lines={"start": src.line(start), "end": src.line(max(start, end - 1))}, **flags)
    return document([row], jsdoc(src.comment_before(start))), end


def _first(m: re.Match) -> int:
    return m.start() + len(m.group()) - len(m.group().lstrip())


def _top_level(src: Source, at: int, blocks: list[tuple[int, int]]) -> bool:
    return not any(a < at < b for a, b in blocks)


def _methods(src: Source, name: str, a: int, b: int, typed: bool, interface: bool) -> list[dict]:
    out, at = [], a
    while at < b:
        m = _METHOD.search(src.code, at, b)
        if not m:
            break
        between = src.code[at : m.start()]
        opened = between.find("{")
        if opened >= 0:  # a field's value or a static block: step over it
            at = src.match(at + opened)
            continue
        word = m.group("name")
        before = src.code[a : m.start()].rstrip()[-1:]
        if word in _NO_METHOD or before in ("=", ".", "(", ",", "?", ":", "&", "|", "!", ">"):
            at = src.match(m.end() - 1, "()")
            continue
        mods = m.group("mods").split()
        kind = "constructor" if word == "constructor" else "get" if "get" in mods else "set" if "set" in mods else "method"
        row, end = _function(src, word, m.start(), m.end() - 1, typed, **{"async": "async" in mods, "generator": bool(m.group("star"))})
        row |= {"class_name": name, "kind": "method", "method_kind": kind, "is_static": "static" in mods, "is_constructor": kind == "constructor", "modifiers": mods, "is_protected": "protected" in mods or "private" in mods or word.startswith("#")}
        row["is_public"] = not row["is_protected"]
        if kind == "constructor":
            row["description"] = f"Creates a new instance of {name}." if typed else f"Constructs a {name} instance."
        if not interface or typed:
            out.append(row)
        at = max(end, m.end())
    return out


def _parse(content: str, typed: bool) -> dict:
    src = Source(content)
    functions, classes, blocks = [], [], []
    methods: dict[str, list[dict]] = {}
    for m in _CLASS.finditer(src.code):
        if m.group("kind") == "interface" and not typed or not _top_level(src, m.start(), blocks):
            continue
        end = src.match(m.end() - 1)
        blocks.append((m.start(), end))
        start = _first(m)
        name = m.group("name")
        methods[name] = _methods(src, name, m.end(), end - 1, typed, m.group("kind") == "interface")
        doc = jsdoc(src.comment_before(start))
        classes.append((start, class_row(name, description=doc["description"], extends=m.group("base") or "", exported=bool(m.group("exp")), n_methods=len(methods[name]), lines={"start": src.line(start), "end": src.line(end - 1)})))
    found = []
    for pattern, arrow in ((_FUNCTION, False), (_ARROW, True)):
        for m in pattern.finditer(src.code):
            start, flags = _first(m), {"exported": bool(m.group("exp")), "async": bool(m.group("async")), "generator": bool(m.group("star"))}
            if not arrow or m.group("head").startswith("function"):
                found.append((start, *_function(src, m.group("name"), start, m.end() - 1, typed, **flags)))
            elif m.group("one"):
                stop = re.compile(r"\s*\{").match(src.code, m.end())
                end = src.match(stop.end() - 1) if stop else m.end()
                row = symbol(m.group("name"), signature=("async " if flags["async"] else "") + f"({m.group('one')}) => {{}}", parameters=[param(m.group("one"), "any" if typed else "")], arrow=True, lines={"start": src.line(start), "end": src.line(max(start, end - 1))}, **flags)
                found.append((start, document([row], jsdoc(src.comment_before(start))), end))
            else:
                close = src.match(m.end() - 1, "()")
                _, at = _after(src, close)
                if re.compile(r"\s*=>").match(src.code, at):
                    found.append((start, *_function(src, m.group("name"), start, m.end() - 1, typed, arrow=True, **flags)))
    for start, row, end in sorted(found, key=lambda f: f[0]):
        if _top_level(src, start, blocks):
            blocks.append((start, end))
            functions.append((start, row))
    rows = [r for _, r in functions]
    for _, c in classes:
        rows += methods[c["name"]]
    imports = [{"type": "import", "module": m.group(2) or m.group(3), "name": None, "alias": None, "level": 0, "line": src.line(m.start())} for m in re.finditer(r"\bimport\s+(?:[^'\";]+?\s+from\s+)?(['\"])([^'\"]+)\1|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", content) if src.code[m.start()] != " "]
    head = content[src.comments[0][0] : src.comments[0][1]] if src.comments and not src.code[: src.comments[0][0]].strip() else ""
    summary = "" if typed else re.sub(r"(?m)^\s*\*? ?", "", re.sub(r"^/\*+|\*+/$", "", head)).strip()
    return document_from(content, summary, rows, [c for _, c in classes], imports)


def parse_javascript(content: str) -> dict:
    return _parse(content, False)


def parse_typescript(content: str) -> dict:
    return _parse(content, True)
