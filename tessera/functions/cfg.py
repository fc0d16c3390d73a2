"""Control flow of Python functions: blocks, reachability, definitions and uses, post-dominators, longest path."""

from __future__ import annotations

import ast
from typing import Any


def build(text: str) -> list[dict[str, Any]]:
    """Blocks of the first function in ``text``: id, line, kind, defs, uses, next. Block 0 is the entry."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    function = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
    if function is None:
        return []
    blocks: list[dict[str, Any]] = []

    def names(node: ast.AST, kind: type) -> list[str]:
        return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, kind)})

    def add(line: int, kind: str, head: list[ast.AST]) -> int:
        blocks.append({"id": len(blocks), "line": line, "kind": kind, "defs": sorted({d for h in head for d in names(h, ast.Store)}), "uses": sorted({u for h in head for u in names(h, ast.Load)}), "next": []})
        return blocks[-1]["id"]

    def link(ends: list[int], to: int) -> None:
        for e in ends:
            if to not in blocks[e]["next"]:
                blocks[e]["next"].append(to)

    def walk(body: list[ast.stmt], ends: list[int]) -> list[int]:
        for s in body:
            if isinstance(s, ast.If):
                b = add(s.lineno, "branch", [s.test])
                link(ends, b)
                ends = walk(s.body, [b]) + (walk(s.orelse, [b]) if s.orelse else [b])
            elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
                b = add(s.lineno, "loop", [s.test] if isinstance(s, ast.While) else [s.target, s.iter])
                link(ends, b)
                link(walk(s.body, [b]), b)
                ends = [b]
            elif isinstance(s, (ast.Return, ast.Raise)):
                link(ends, add(s.lineno, "return" if isinstance(s, ast.Return) else "raise", [s]))
                ends = []
            elif isinstance(s, (ast.Try, ast.With, ast.AsyncWith)):
                b = add(s.lineno, "block", list(getattr(s, "items", [])))
                link(ends, b)
                inner = walk(s.body, [b])
                for h in getattr(s, "handlers", []):
                    inner += walk(h.body, [b])
                ends = walk(getattr(s, "finalbody", []), inner)
            else:
                kind = "assign" if isinstance(s, (ast.Assign, ast.AugAssign, ast.AnnAssign)) else "call" if isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) else "yield" if isinstance(s, ast.Expr) and isinstance(s.value, (ast.Yield, ast.YieldFrom)) else "statement"
                b = add(s.lineno, kind, [s])
                link(ends, b)
                ends = [b]
        return ends

    entry = add(function.lineno, "entry", [])
    blocks[entry]["defs"] = sorted(a.arg for a in [*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs])
    walk(function.body, [entry])
    return blocks


def reachable(blocks: list[dict]) -> set[int]:
    seen, todo = set(), [0] if blocks else []
    while todo:
        b = todo.pop()
        if b not in seen:
            seen.add(b)
            todo += blocks[b]["next"]
    return seen


def def_use(blocks: list[dict]) -> dict[str, dict]:
    """First line that defines a name, and the lines that use it from there on."""
    out: dict[str, dict] = {}
    for b in sorted(blocks, key=lambda b: b["line"]):
        for d in b["defs"]:
            out.setdefault(d, {"defined": b["line"], "used": []})
    for b in blocks:
        for u in b["uses"]:
            if u in out and b["line"] >= out[u]["defined"]:
                out[u]["used"].append(b["line"])
    return out


def post_dominators(blocks: list[dict]) -> dict[int, set[int]]:
    every = {b["id"] for b in blocks}
    dom = {b["id"]: set(every) if b["next"] else {b["id"]} for b in blocks}
    while True:
        before = {k: set(v) for k, v in dom.items()}
        for b in reversed(blocks):
            if b["next"]:
                dom[b["id"]] = {b["id"]} | set.intersection(*(dom[n] for n in b["next"]))
        if dom == before:
            break
    return dom


def critical_path(blocks: list[dict], *, budget: int = 20_000) -> list[int]:
    """Longest path from the entry without a repeated block; the search stops at ``budget`` steps."""
    best: list[int] = []
    todo = [[0]] if blocks else []
    while todo and budget:
        budget -= 1
        path = todo.pop()
        if len(path) > len(best):
            best = path
        todo += [[*path, n] for n in blocks[path[-1]]["next"] if n not in path]
    return best


def summary(text: str, *, depth: bool = True) -> dict[str, int]:
    """Counts of a function's control flow; ``depth`` is the length of its longest path."""
    b = build(text)
    out = {"blocks": len(b), "branches": sum(x["kind"] == "branch" for x in b), "loops": sum(x["kind"] == "loop" for x in b), "returns": sum(x["kind"] == "return" for x in b), "unreachable": len(b) - len(reachable(b))}
    return out | {"depth": len(critical_path(b))} if depth else out
