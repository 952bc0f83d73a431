"""Command line: python -m loomctx.cli COMMAND. Exit code 2 without an index, 1 on other errors."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import subprocess
import sys
import tempfile

from loomctx import schema as S
from loomctx.plans.engine import Engine, NoIndex, find_root
from loomctx.session import session
from loomctx.sources import config
from loomctx.sources.files import query_file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomctx")
    p.add_argument("--repo", help="repository; the nearest indexed folder upwards by default")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple, **flags) -> None:
        c = sub.add_parser(name)
        for a, kw in arguments:
            c.add_argument(a, **kw)
        for f, kw in flags.items():
            c.add_argument("--" + f.replace("_", "-"), **kw)

    yes, number = {"action": "store_true"}, {"type": int}
    add("init", ("path", {"nargs": "?"}))
    add("index", ("path", {"nargs": "?"}), force=yes)
    add("status")
    add("search", ("query", {}), limit={"type": int, "default": 10}, json=yes)
    add("pack", ("query", {}), budget=number, mode={}, json=yes, render={"choices": ("plain", "messages", "chat")}, no_content=yes, copy=yes)
    add("ask-context", ("query", {}), budget=number, mode={})
    add("callers", ("symbol", {}))
    add("tests", ("target", {}))
    add("impact", ("target", {}), depth={"type": int, "default": 3})
    add("explain", ("symbol", {}))
    add("why", ("pack_id", {}))
    add("serve")
    add("demo", ("path", {"nargs": "?"}), out={"default": "context-demo.html"})
    add("doctor")
    add("pr-context", ("since", {"nargs": "?"}), budget={"type": int, "default": 8000}, json=yes)
    add("cache-report", json=yes)
    add("bench", ("which", {"choices": ("token-savings", "cache-stability")}), budget={"type": int, "default": 2000}, queries={}, json=yes)
    add("gc", days={"type": int, "default": 30})
    return p


def show(value) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def to_clipboard(text: str) -> bool:
    """Pipe the text to the first clipboard tool that works."""
    for tool in (["pbcopy"], ["wl-copy"], ["xclip", "-selection", "clipboard"], ["xsel", "-ib"], ["clip.exe"]):
        if shutil.which(tool[0]) and subprocess.run(tool, input=text.encode(), check=False).returncode == 0:
            return True
    return False


def demo_html(engine: Engine) -> str:
    """A self-contained page: the query matrix, reports and graph as one JSON blob in a template."""
    from loomctx.operators.hotset import top_chunks

    names = [r["symbol"] for r in top_chunks(engine.store.table("nodes"), 2).select("symbol").collect()] or ["main"]
    matrix = [(f"Refactor {names[0]}", m) for m in S.MODES] + [(f"Where is {names[-1]} used", "default")]
    packs = engine.packs(engine.requests([{"query": q, "mode": m, "token_budget": 4000} for q, m in matrix]), "demo")
    blob = json.dumps({"packs": packs, "status": engine.status(), "cache": engine.cache_report(), "graph": engine.graph()}, default=str).replace("</", "<\\/")
    template = """<!doctype html><meta charset="utf-8"><title>Context packs</title><style>body{font:14px sans-serif;margin:2em}td,th{padding:2px 10px;text-align:left}</style>
<h1>Context packs</h1><table id="packs"></table><pre id="more"></pre><script>const data = __DATA__;
document.getElementById("packs").innerHTML = "<tr><th>query<th>mode<th>items<th>tokens<th>saved %</tr>" + data.packs.map((p, i) => `<tr onclick="show(${i})"><td>${p.query}<td>${p.mode}<td>${p.items.length}<td>${p.totals.selected_tokens}<td>${p.totals.saved_pct}</tr>`).join("");
function show(i) { document.getElementById("more").textContent = JSON.stringify(data.packs[i].items.map(x => [x.path, x.symbol, x.why]), null, 1) } show(0);</script>
"""
    return template.replace("__DATA__", blob)


def run(a: argparse.Namespace) -> int:
    root = os.path.abspath(a.path) if getattr(a, "path", None) else find_root(a.repo or ".")
    if a.command == "init":
        print("created: " + (", ".join(config.init(root)) or "nothing, all there"))
        return 0
    e = Engine(session(a.master, 8), root)
    if a.command == "index":
        show(e.index(a.force))
    elif a.command == "status":
        show(e.status())
    elif a.command == "search":
        hits = e.search(a.query, a.limit)
        show(hits) if a.json else [print(f"{h['score']:.2f}  {h['path']}::{h['symbol']}  {h['why']['detail']}") for h in hits]
    elif a.command in ("pack", "ask-context"):
        content = a.command == "pack" and not a.no_content
        packed = e.pack(a.query, a.budget, a.mode, content)
        if a.command == "ask-context":
            packed |= e.coverage(packed)
            show(packed)
            return 0
        text = json.dumps(packed, indent=2, ensure_ascii=False) if a.json else e.render(packed, a.render or "plain")
        print(text)
        if a.copy and not to_clipboard(text):
            print("no clipboard tool found", file=sys.stderr)
    elif a.command == "callers":
        show(e.callers(a.symbol))
    elif a.command == "tests":
        show(e.tests(a.target))
    elif a.command == "impact":
        show(e.impact(a.target, a.depth))
    elif a.command == "explain":
        show(e.explain(a.symbol))
    elif a.command == "why":
        found = e.why(a.pack_id)
        if found is None:
            raise KeyError(f"no pack {a.pack_id}")
        show(found)
    elif a.command == "serve":
        from loomctx.rpc import serve

        serve(e, sys.stdin, sys.stdout)
    elif a.command == "demo":
        if not e.store.exists():
            e.index()
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(demo_html(e))
        print(a.out)
    elif a.command == "doctor":
        checks = e.doctor()
        for level, message in checks:
            print(f"{level:5} {message}")
        return 2 if any(level == "fail" for level, _ in checks) else 0
    elif a.command == "pr-context":
        show(e.pr_context(a.since, a.budget))
    elif a.command == "cache-report":
        show(e.cache_report())
    elif a.command == "bench":
        if a.which == "token-savings":
            queries = [r["query"] for r in query_file(e.spark, "file://" + os.path.abspath(a.queries)).collect()] if a.queries else None
            show(e.bench_token_savings(a.budget, queries))
        else:
            with tempfile.TemporaryDirectory() as copy:
                show(e.bench_cache_stability(os.path.join(copy, "repo")))
    elif a.command == "gc":
        show(e.gc(a.days))
    return 0


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        return run(a)
    except NoIndex as e:
        print(e, file=sys.stderr)
        return 2
    except (KeyError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
