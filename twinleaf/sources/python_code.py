"""Front-end for Python source, by the standard library's parser."""

from __future__ import annotations

import ast

from . import trees


def parse(source: str) -> list[trees.Node]:
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        raise trees.ParseError(f"Parse error: {e}") from None
    return [_node(n) for n in module.body]


def _node(n: ast.AST) -> trees.Node:
    parts = []
    for name, value in ast.iter_fields(n):
        if name in ("ctx", "type_comment", "kind"):
            continue
        parts.append((name, _node(value) if isinstance(value, ast.AST) else [_node(v) if isinstance(v, ast.AST) else v for v in value] if isinstance(value, list) else value))
    flag, part = None, None
    if isinstance(n, (ast.Name, ast.arg)):
        flag, part = "variables", "id" if isinstance(n, ast.Name) else "arg"
    elif isinstance(n, ast.Constant) and isinstance(n.value, (str, bytes, int, float)) and not isinstance(n.value, bool):
        flag, part = "literals", "value"
    elif isinstance(n, ast.Attribute):
        flag, part = "identifiers", "attr"
    elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        flag, part = "identifiers", "name"
    return trees.Node(type(n).__name__, parts, getattr(n, "lineno", -1), getattr(n, "end_lineno", None) or -1, flag, part)
