"""Python structure from the syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from .base import Class, Method, Structure, parameter

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
LOOPS_AND_IFS = (ast.If, ast.For, ast.While)
# What adds a path, and what adds a level.
BRANCHING = (*LOOPS_AND_IFS, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension)
NESTING = (*LOOPS_AND_IFS, ast.With, ast.Try, ast.TryStar)


def cyclomatic(node: ast.AST) -> int:
    return 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, BRANCHING) for n in ast.walk(node))


def nesting(node: ast.AST) -> int:
    """The most nesting statements on a path from the node down."""
    deepest, todo = 0, [(node, 0)]
    while todo:
        at, depth = todo.pop()
        deepest = max(deepest, depth)
        todo += [(child, depth + isinstance(child, NESTING)) for child in ast.iter_child_nodes(at)]
    return deepest


def _elif_of(node: ast.AST) -> ast.AST | None:
    """The ``elif`` of an ``if``, which the tree holds as a lone ``if`` in its else branch."""
    branch = getattr(node, "orelse", None)
    return branch[0] if isinstance(node, ast.If) and len(branch) == 1 and isinstance(branch[0], ast.If) else None


def _price(node: ast.AST, parent: ast.AST, depth: int, name: str) -> tuple[int, int]:
    """(points, further levels below) of one node."""
    if isinstance(node, LOOPS_AND_IFS):
        flat = node is _elif_of(parent)
        ends = bool(node.orelse) and _elif_of(node) is None
        return (1 if flat else 1 + depth) + ends, 0 if flat else 1
    if isinstance(node, ast.IfExp):
        return 2 + depth, 1  # the branch, and its else
    if isinstance(node, ast.ExceptHandler):
        return 1 + depth, 1
    if isinstance(node, ast.BoolOp):
        return 1, 0
    if isinstance(node, (ast.Try, ast.TryStar)):
        return bool(node.finalbody) + bool(node.orelse), 0
    if isinstance(node, (ast.With, *FUNCTIONS, ast.Lambda)):
        return 0, 1
    if isinstance(node, ast.Call) and name in (getattr(node.func, "id", None), getattr(node.func, "attr", None)):
        return 1, 0
    return 0, 0


def _below(node: ast.AST) -> Iterator[tuple[ast.AST, ast.AST]]:
    """(child, parent) of what a walk visits next; statements directly in a try count only by their children."""
    if not isinstance(node, (ast.Try, ast.TryStar)):
        yield from ((child, node) for child in ast.iter_child_nodes(node))
        return
    for statement in (*node.body, *node.orelse, *node.finalbody):
        yield from ((child, statement) for child in ast.iter_child_nodes(statement))
    yield from ((handler, node) for handler in node.handlers)


def cognitive(node: ast.AST) -> int:
    """Branches cost one and their depth; else, finally, boolean runs and recursion cost one."""
    score, todo, name = 0, [(child, parent, 0) for child, parent in _below(node)], getattr(node, "name", "")
    while todo:
        at, parent, depth = todo.pop()
        points, deeper = _price(at, parent, depth, name)
        score += points
        todo += [(child, own, depth + deeper) for child, own in _below(at)]
    return score


def _text(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


def parameters(a: ast.arguments) -> list[dict]:
    """Parameters but self and cls, then keyword-only ones, then the starred ones; positional-only ones are left out."""
    first_default = len(a.args) - len(a.defaults)
    out = [parameter(x.arg, _text(x.annotation), i >= first_default) for i, x in enumerate(a.args) if x.arg not in ("self", "cls")]
    out += [parameter(x.arg, _text(x.annotation), d is not None) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    return out + [parameter(stars + x.arg, _text(x.annotation)) for stars, x in (("*", a.vararg), ("**", a.kwarg)) if x]


def attributes(node: ast.ClassDef) -> list[str]:
    """Names that are assigned on self or cls anywhere in the class, in the order of the walk."""
    found: dict[str, None] = {}
    for n in ast.walk(node):
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Attribute) and getattr(t.value, "id", None) in ("self", "cls"):
                found.setdefault(t.attr)
    return list(found)


def _method(node: ast.FunctionDef | ast.AsyncFunctionDef, inside: bool) -> Method:
    end = node.end_lineno or node.lineno
    return Method(
        node.name, node.lineno, end, end - node.lineno + 1, parameters(node.args), cyclomatic(node), cognitive(node), nesting(node),
        inside and node.name == "__init__", ast.get_docstring(node), [_text(d) for d in node.decorator_list],
    )


def _class(node: ast.ClassDef) -> Class:
    end = node.end_lineno or node.lineno
    methods = [_method(n, True) for n in node.body if isinstance(n, FUNCTIONS)]
    return Class(node.name, node.lineno, end, end - node.lineno + 1, methods, attributes(node), [_text(b) for b in node.bases], ast.get_docstring(node), [_text(d) for d in node.decorator_list])


def parse(text: str) -> Structure:
    """All classes, nested ones too, the module's functions, and top-level names of its imports.

    What does not parse has no structure.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Structure()
    imports = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports |= {a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            imports.add(n.module.split(".")[0])
    return Structure([_class(n) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)], [_method(n, False) for n in tree.body if isinstance(n, FUNCTIONS)], sorted(imports))
