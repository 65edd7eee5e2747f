"""Doc comments: Google style, JSDoc and Javadoc, as
``{description, brief, params: [{name, type, description}], returns: {type, description}, throws: [..]}``."""

from __future__ import annotations

import re

_SECTION = re.compile(r"^(Args|Arguments|Parameters|Returns|Return|Yields|Raises|Examples?|Notes?)\s*:\s*$")
_ENTRY = re.compile(r"^\*{0,2}(\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)$")


def brief(text: str) -> str:
    """The first sentence."""
    flat = re.sub(r"\s+", " ", text).strip()
    m = re.match(r"(.+?[.!?])(?=\s|$)", flat)
    return m.group(1) if m else flat


def google(text: str | None) -> dict:
    lines = (text or "").expandtabs().splitlines()
    inner = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
    cut = min(inner, default=0)
    lines = [x.strip() if i == 0 else x[cut:].rstrip() for i, x in enumerate(lines)]
    parts: dict[str, list[str]] = {"": []}
    at = ""
    for x in lines:
        m = _SECTION.match(x)
        if m:
            at = m.group(1)[:3].lower()
            parts.setdefault(at, [])
        else:
            parts[at].append(x)

    def entries(key: str) -> list[tuple[str, str, str]]:
        out: list[list[str]] = []
        for x in parts.get(key, []):
            m = _ENTRY.match(x.strip())
            deep = len(x) - len(x.lstrip())
            if m and (not out or deep <= first):
                first = deep
                out.append([m.group(1), m.group(2) or "", m.group(3)])
            elif out and x.strip():
                out[-1][2] += " " + x.strip()
        return [(a, b.strip(), c.strip()) for a, b, c in out]

    found = " ".join(x.strip() for x in parts.get("ret", parts.get("yie", [])) if x.strip())
    kind, colon, rest = found.partition(":")
    simple = bool(colon) and bool(re.fullmatch(r"[\w.\[\], |]+", kind.strip()))
    description = "\n".join(parts[""]).strip()
    return {
        "description": description,
        "brief": brief(description),
        "params": [{"name": n, "type": t.replace(", optional", ""), "description": d} for key in ("arg", "par") for n, t, d in entries(key)],
        "returns": {"type": kind.strip() if simple else "", "description": rest.strip() if simple else found},
        "throws": [n for n, _, _ in entries("rai")],
    }


def _tags(comment: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Description and (tag, text) of a ``/** */`` comment."""
    body = re.sub(r"^\s*/\*+|\*+/\s*$", "", comment or "")
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in body.splitlines()]
    description, tags = [], []
    for x in lines:
        m = re.match(r"\s*@(\w+)\s*(.*)", x)
        if m:
            tags.append([m.group(1), m.group(2)])
        elif tags:
            tags[-1][1] += " " + x.strip()
        else:
            description.append(x)
    return "\n".join(description).strip(), [(t, v.strip()) for t, v in tags]


def jsdoc(comment: str | None) -> dict:
    description, tags = _tags(comment)
    out: dict = {"description": description, "brief": brief(description), "params": [], "returns": {"type": "", "description": ""}, "throws": []}
    for tag, text in tags:
        m = re.match(r"(?:\{((?:[^{}]|\{[^}]*\})*)\}\s*)?(.*)", text, re.S)
        kind, rest = (m.group(1) or "").strip(), m.group(2).strip()
        if tag in ("param", "arg", "argument"):
            p = re.match(r"(\[[^\]]*\]|[\w$.]+)\s*(?:-\s*)?(.*)", rest, re.S)
            if p:
                out["params"].append({"name": p.group(1).strip("[]").split("=")[0], "type": kind, "description": p.group(2).strip()})
        elif tag in ("returns", "return"):
            out["returns"] = {"type": kind, "description": rest.removeprefix("- ").strip()}
        elif tag in ("throws", "exception"):
            out["throws"].append(kind or rest.split(" ")[0])
        elif tag in ("description", "desc") and not description:
            out["description"], out["brief"] = rest, brief(rest)
    return out


def javadoc(comment: str | None) -> dict:
    description, tags = _tags(comment)
    plain = re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", re.sub(r"</?\w+[^>]*>", "", description))
    out: dict = {"description": plain.strip(), "brief": brief(plain), "params": [], "returns": {"type": "", "description": ""}, "throws": []}
    for tag, text in tags:
        name, _, rest = text.partition(" ")
        if tag == "param":
            out["params"].append({"name": name, "type": "", "description": rest.strip()})
        elif tag == "return":
            out["returns"]["description"] = text
        elif tag in ("throws", "exception"):
            out["throws"].append(name)
    return out
