"""Python source to rows, by the standard parser."""

from __future__ import annotations

import ast

from .docs import google
from .records import class_row, document, document_from, param, symbol

_Function = (ast.FunctionDef, ast.AsyncFunctionDef)


def _text(node: ast.AST | None) -> str:
    kind = node.__class__
    if node is None:
        return ""
    if kind is ast.Name:
        return node.id
    if kind is ast.Attribute and node.value.__class__ in (ast.Name, ast.Attribute):
        return f"{_text(node.value)}.{node.attr}"
    if kind is ast.Constant and node.value.__class__ in (int, str, bool) and node.kind is None:
        return repr(node.value)
    return ast.unparse(node)


def signature(node) -> tuple[str, list[dict]]:
    """The signature (names and defaults, no annotations) and the parameters."""
    a, parts, params = node.args, [], []

    def take(arg: ast.arg, prefix: str = "", default: ast.AST | None = None) -> None:
        value = None if default is None else _text(default)
        parts.append(prefix + arg.arg + ("" if value is None else f"={value}"))
        params.append(param(prefix + arg.arg, _text(arg.annotation), value, optional=value is not None, rest=bool(prefix)))

    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    for arg, default in zip(plain, defaults, strict=True):
        take(arg, default=default)
    if a.vararg:
        take(a.vararg, "*")
    elif a.kwonlyargs:
        parts.append("*")
    for arg, default in zip(a.kwonlyargs, a.kw_defaults, strict=True):
        take(arg, default=default)
    if a.kwarg:
        take(a.kwarg, "**")
    return f"({', '.join(parts)})", params


# Fields without nodes that count, and nodes that hold none.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "name", "names", "arg", "kind", "module", "level", "type_comment", "conversion", "simple", "is_async", "rest", "kwd_attrs"}
_LEAVES = {ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, type(None), str, bool}
_NESTING = {ast.If, ast.For, ast.While, ast.With, ast.Try}
_FIELDS = {kind: tuple(f for f in kind._fields if f not in _PLAIN) for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)}


def measured(node: ast.AST) -> tuple[list[str], dict]:
    """Distinct names that are called (sorted, attribute chains as written) and the complexity, in one walk."""
    names, deepest, boolean = set(), 0, 0
    n_of = dict.fromkeys((ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.IfExp), 0)
    todo = [(node, 0)]
    while todo:
        n, depth = todo.pop()
        kind = n.__class__
        if kind in n_of:
            n_of[kind] += 1
        elif kind is ast.Call:
            if n.func.__class__ in (ast.Name, ast.Attribute):
                names.add(_text(n.func))
        elif kind is ast.BoolOp:
            boolean += len(n.values) - 1
        if kind in _NESTING:
            depth += 1
            deepest = max(deepest, depth)
        for f in _FIELDS.get(kind, ()):
            below = getattr(n, f, None)
            if below.__class__ is list:
                for x in below:
                    if x.__class__ not in _LEAVES:
                        todo.append((x, depth))
            elif below.__class__ not in _LEAVES:
                todo.append((below, depth))
    branches, loops = n_of[ast.If], n_of[ast.For] + n_of[ast.While]
    return sorted(names), {
        "cyclomatic": 1 + branches + loops + n_of[ast.ExceptHandler] + boolean,
        "nesting_depth": deepest,
        "num_branches": branches + n_of[ast.IfExp],
        "num_loops": loops + n_of[ast.AsyncFor],
    }


def calls(node: ast.AST) -> list[str]:
    return measured(node)[0]


def complexity(node: ast.AST) -> dict:
    return measured(node)[1]


def statements(tree: ast.AST) -> list[ast.AST]:
    """All statements (and handlers and cases), outer ones first."""
    found = [tree]
    for n in found:  # grows
        for f in ("body", "handlers", "orelse", "finalbody", "cases"):
            if n.__class__ not in _LEAVES:
                found += getattr(n, f, ())
    return found


def literal_type(node: ast.AST | None) -> str:
    """The type that a literal shows, else nothing."""
    if isinstance(node, ast.Constant):
        return "None" if node.value is None else type(node.value).__name__
    kinds = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.Tuple: "tuple", ast.Lambda: "function", ast.GeneratorExp: "generator", ast.JoinedStr: "str"}
    return next((name for kind, name in kinds.items() if isinstance(node, kind)), "")


def function_row(node, class_name: str | None = None) -> dict:
    sig, params = signature(node)
    returns = _text(node.returns)
    is_async = isinstance(node, ast.AsyncFunctionDef)
    called, complexities = measured(node)
    if is_async and returns:
        returns = f"Coroutine[{returns}]"
    row = symbol(
        node.name,
        class_name=class_name,
        kind="method" if class_name else "function",
        signature=sig,
        parameters=params,
        returns={"type": returns, "description": ""},
        decorators=[_text(d) for d in node.decorator_list],
        function_calls=called,
        complexity=complexities,
        lines={"start": node.lineno, "end": node.end_lineno},
        **{"async": is_async},
    )
    if class_name:
        name = node.name
        magic = name.startswith("__") and name.endswith("__") and len(name) > 4
        decorated = " ".join(row["decorators"])
        row["is_constructor"] = name == "__init__"
        row["is_magic"] = magic and name != "__init__"
        row["is_protected"] = name.startswith("_") and not name.startswith("__")
        row["is_public"] = not (row["is_constructor"] or row["is_magic"] or row["is_protected"])
        row["is_static"], row["is_classmethod"], row["is_property"] = ("staticmethod" in decorated, "classmethod" in decorated, "property" in decorated)
    return document([row], google(ast.get_docstring(node)))


def _assigned(node: ast.AST) -> list[tuple[str, str, ast.AST | None]]:
    """(name, annotation, value) of a plain assignment."""
    if isinstance(node, ast.Assign):
        return [(t.id, "", node.value) for t in node.targets if isinstance(t, ast.Name)]
    if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
        return [(node.target.id, _text(node.annotation), node.value)]
    return []


def _variable(node: ast.AST, name: str, kind: str, value: ast.AST | None, annotation: str, owner: str | None = None) -> dict:
    return {"owner": owner, "kind": kind, "name": name, "type": annotation or literal_type(value), "value": _text(value) or None, "line": node.lineno}


def parse(content: str) -> dict:
    """Rows of a module; raises SyntaxError."""
    tree = ast.parse(content)
    functions, classes, variables, imports = [], [], [], []
    for node in tree.body:
        if isinstance(node, _Function):
            functions.append(function_row(node))
        elif isinstance(node, ast.ClassDef):
            methods = [function_row(m, node.name) for m in node.body if isinstance(m, _Function)]
            functions += methods
            for item in node.body:
                variables += [_variable(item, n, "attribute", v, t, node.name) for n, t, v in _assigned(item)]
            classes.append(class_row(node.name, description=ast.get_docstring(node) or "", extends=", ".join(map(_text, node.bases)), decorators=[_text(d) for d in node.decorator_list], n_methods=len(methods), lines={"start": node.lineno, "end": node.end_lineno}))
        else:
            for name, annotation, value in _assigned(node):
                if not name.startswith("_"):
                    variables.append(_variable(node, name, "constant" if name.isupper() else "global", value, annotation))
    for node in statements(tree):
        if isinstance(node, ast.Import):
            imports += [{"type": "import", "module": a.name, "name": None, "alias": a.asname, "level": 0, "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [{"type": "from_import", "module": node.module or "", "name": a.name, "alias": a.asname, "level": node.level, "line": node.lineno} for a in node.names]
    imports.sort(key=lambda i: (i["line"], i["module"], i["name"] or ""))
    return document_from(content, ast.get_docstring(tree) or "", functions, classes, imports, variables)


def main_block(content: str, most: int = 15) -> str | None:
    """The body under ``if __name__ == ...``: dedented, without blank lines, its first lines."""
    if '__name__ == "__main__"' not in content and "__name__ == '__main__'" not in content:
        return None
    try:
        tree = ast.parse(content)
    except SyntaxError:
        return None
    lines = content.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and isinstance(node.test.left, ast.Name) and node.test.left.id == "__name__":
            body = [x for x in lines[node.body[0].lineno - 1 : node.end_lineno] if x.strip()]
            if body:
                cut = min(len(x) - len(x.lstrip()) for x in body)
                return "\n".join(x[cut:] for x in body[:most])
    return None
