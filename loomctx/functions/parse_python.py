"""Top-level declarations and imports of Python sources, by the standard parser; a line scan where a file doesn't parse."""

from __future__ import annotations

import ast
import re

_HEAD = re.compile(r"^(?:async\s+)?(def|class)\s+(\w+)", re.M)
_IMPORT = re.compile(r"^(?:import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)|from\s+(\.*[\w.]*)\s+import\b)", re.M)


def flat(text: str) -> str:
    return " ".join(text.split())


def decl(kind, name, start, end, line_start, line_end, signature, calls=(), bases=(), impls=()) -> dict:
    return {"kind": kind, "name": name, "byte_start": start, "byte_end": end, "line_start": line_start, "line_end": line_end, "signature": signature, "calls": sorted(set(calls)), "bases": list(dict.fromkeys(bases)), "impls": list(dict.fromkeys(impls))}


def _doc(node) -> str | None:
    """First line of a docstring."""
    first = node.body[0] if node.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        lines = first.value.value.strip().splitlines()
        return lines[0].strip() or None if lines else None
    return None


class _Places:
    """Byte offsets of (line, UTF-8 column)."""

    def __init__(self, data: bytes):
        self.data, self.starts = data, [0]
        for line in data.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def text(self, a: int, b: int) -> str:
        return self.data[a:b].decode("utf-8", "replace")


def _header(p: _Places, node) -> str:
    """From ``def`` or ``class`` to the body, which a comment or the first statement begins."""
    start, first = p.at(node.lineno, node.col_offset), node.body[0]
    line = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
    end = p.at(first.lineno, first.col_offset) if line == first.lineno else p.at(line, 0)
    text = re.sub(r"#[^\n]*(?=\n|$)", "", p.text(start, end)) if "\n" in p.text(start, end) else p.text(start, end)
    return flat(text).rstrip("@ ")


def _calls(node) -> list[str]:
    out = []
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                out.append(n.func.id)
            elif isinstance(n.func, ast.Attribute):
                out.append(n.func.attr)
    return out


def _declared(p: _Places, node) -> dict:
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    start = p.at(first, node.col_offset) if first != node.lineno else p.at(node.lineno, node.col_offset)
    header, doc = _header(p, node), _doc(node)
    quoted = f'    """{doc}"""\n' if doc else ""
    calls = [c for part in [*node.body, *([] if isinstance(node, ast.ClassDef) else [node.args]), *(node.bases + node.keywords if isinstance(node, ast.ClassDef) else [])] for c in _calls(part)]
    if isinstance(node, ast.ClassDef):
        methods = [f"    {_header(p, m)} ...\n" for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        bases = [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        return decl("class", node.name, start, p.at(node.end_lineno, node.end_col_offset), first, node.end_lineno, f"{header}\n{quoted}{''.join(methods)}", calls, bases)
    signature = f"{header}\n{quoted}    ...\n" if doc else f"{header} ...\n"
    return decl("function", node.name, start, p.at(node.end_lineno, node.end_col_offset), first, node.end_lineno, signature, calls)


def _broken(text: str) -> tuple[list[dict], list[str]]:
    """Blocks from each top-level ``def`` or ``class`` line to the next line that begins at the left margin."""
    decls = []
    for m in _HEAD.finditer(text):
        stop = re.compile(r"^[^\s#)\]}]", re.M).search(text, m.end())
        body = text[m.start() : stop.start() if stop else len(text)].rstrip()
        start = len(text[: m.start()].encode())
        line = text.count("\n", 0, m.start()) + 1
        head = flat(body.split("\n", 1)[0])
        decls.append(decl("class" if m[1] == "class" else "function", m[2], start, start + len(body.encode()), line, line + body.count("\n"), f"{head} ...\n", re.findall(r"(?<!def )(?<!class )\b(\w+)\(", body)))
    imports = [part.split()[0] for m in _IMPORT.finditer(text) if m[1] for part in m[1].split(",")] + [m[2] for m in _IMPORT.finditer(text) if m[2] and m[2] != "__future__"]
    return decls, imports


def scan(text: str) -> tuple[list[dict], list[str]]:
    """(declarations, imports) of a source text."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _broken(text)
    p = _Places(text.encode())
    decls, imports = [], []
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            imports.append("." * node.level + (node.module or ""))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            decls.append(_declared(p, node))
    return decls, imports
