"""The shape of parsed rows."""

from __future__ import annotations

PARAM = "struct<name:string,type:string,default:string,description:string,optional:boolean,rest:boolean>"
SPAN = "struct<start:int,end:int>"
SYMBOL_FIELDS = (
    "class_name string, name string, ord int, kind string, signature string, description string, returns struct<type:string,description:string>,"
    f" parameters array<{PARAM}>, throws array<string>, decorators array<string>, function_calls array<string>, modifiers array<string>,"
    " complexity struct<cyclomatic:int,nesting_depth:int,num_branches:int,num_loops:int>,"
    f" lines {SPAN}, async boolean, generator boolean, arrow boolean, exported boolean, method_kind string, is_constructor boolean,"
    " is_magic boolean, is_protected boolean, is_public boolean, is_static boolean, is_classmethod boolean, is_property boolean"
)
CLASS_FIELDS = f"name string, ord int, description string, extends string, decorators array<string>, exported boolean, n_methods int, lines {SPAN}"
IMPORT_FIELDS = "type string, module string, name string, alias string, level int, line int"
VARIABLE_FIELDS = "owner string, kind string, name string, type string, value string, line int"

FLAGS = ("async", "generator", "arrow", "exported", "is_constructor", "is_magic", "is_protected", "is_public", "is_static", "is_classmethod", "is_property")


def param(name: str, kind: str = "", default: str | None = None, description: str = "", optional: bool = False, rest: bool = False) -> dict:
    return {"name": name, "type": kind, "default": default, "description": description, "optional": optional, "rest": rest}


def symbol(name: str, **fields) -> dict:
    """A function or method row; what isn't given is null, false or empty."""
    out = {
        "class_name": None, "name": name, "ord": 0, "kind": "function", "signature": "()", "description": "", "returns": {"type": "", "description": ""},
        "parameters": [], "throws": [], "decorators": [], "function_calls": [], "modifiers": [], "complexity": None, "lines": {"start": None, "end": None}, "method_kind": None,
    } | dict.fromkeys(FLAGS, False)
    return out | fields


def class_row(name: str, **fields) -> dict:
    return {"name": name, "ord": 0, "description": "", "extends": "", "decorators": [], "exported": False, "n_methods": 0, "lines": {"start": None, "end": None}} | fields


def document(symbols: list[dict], doc: dict) -> dict:
    """The last symbol with the descriptions of its doc comment; a declared type, default or
    exception wins where there is one."""
    row = symbols[-1]
    row["description"] = doc.get("description") or row["description"]
    by = {p["name"]: p for p in doc.get("params", [])}
    for p in row["parameters"]:
        if p["name"] in by:
            p["description"] = by[p["name"]]["description"]
            p["type"] = p["type"] or by[p["name"]]["type"]
    returns = doc.get("returns") or {}
    row["returns"] = {"type": row["returns"]["type"] or returns.get("type", ""), "description": returns.get("description", "")}
    row["throws"] = row["throws"] or doc.get("throws", [])
    return row


def document_from(content: str, summary: str = "", functions=(), classes=(), imports=(), variables=()) -> dict:
    for rows in (functions, classes):
        for i, r in enumerate(rows):
            r["ord"] = i
    return {"summary": summary, "symbols": list(functions), "classes": list(classes), "imports": list(imports), "variables": list(variables), "n_lines": len(content.splitlines())}
