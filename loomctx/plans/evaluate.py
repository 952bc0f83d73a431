"""Evaluation over many repositories: index each, packs for every query and budget in one batch, result files, and their verification."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.operators import report
from loomctx.plans.engine import Engine
from loomctx.sources.files import result_rows

BUDGETS = (2_000, 6_000, 12_000)
QUERIES = {"top_symbol": "Explain {symbol} and what uses it", "architecture": "architecture overview of the main modules", "tests": "tests that cover {symbol}"}


def evaluate(spark: SparkSession, repos: list[str], out: str) -> dict:
    """Writes repo_index_metrics.csv, pack_metrics.jsonl, failures.jsonl, report.md and manifest.json into ``out``; the manifest."""
    os.makedirs(out, exist_ok=True)
    started, indexed, packs, failures = time.time(), [], [], []
    for root in repos:
        name = os.path.basename(os.path.abspath(root))
        try:
            e, begin = Engine(spark, root), time.time()
            counters = e.index(force=True)
            wall = int((time.time() - begin) * 1000)
            status = e.status()
            top = report.top_symbol(e.store.table("nodes")).select("symbol", "path", "tokens", "centrality").first()
            symbol = top["symbol"] if top else "main"
            indexed.append({"repo": name, "index_wall_ms": wall, **counters, **{f"count_{k}": status[k] for k in ("files", "chunks", "signatures", "docs", "edges", "skipped_files")}, "top_symbol": symbol, "top_symbol_path": top["path"] if top else None})
            asked = [{"query": q.format(symbol=symbol), "token_budget": b, "include_content": False, "mode": "default"} for q in QUERIES.values() for b in BUDGETS]
            names = [(k, b) for k in QUERIES for b in BUDGETS]
            begin = time.time()
            done = e.packs(e.requests(asked), "bench")
            wall = int((time.time() - begin) * 1000 / max(1, len(done)))
            by_text = {(p["query"], p["token_budget"]): p for p in done}
            for (kind, budget), a in zip(names, asked):
                p = by_text[a["query"], budget]
                packs.append({"repo": name, "query_name": kind, "budget": budget, "pack_wall_ms": wall, "pack_id": p["pack_id"], "status": "ok", "items": len(p["items"]), "stable_items": len(p["layout"]["stable_prefix_items"]), **p["totals"]})
        except Exception as error:  # one repository's failure is a row, not the end
            failures.append({"repo": name, "error": str(error)[:500]})
    _csv(os.path.join(out, "repo_index_metrics.csv"), indexed)
    for file, rows in (("pack_metrics.jsonl", packs), ("failures.jsonl", failures)):
        with open(os.path.join(out, file), "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows)
    manifest = {"repos": len(indexed), "packs": len(packs), "failures": len(failures), "budgets": list(BUDGETS), "queries": sorted(QUERIES), "seconds": round(time.time() - started, 2)}
    with open(os.path.join(out, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=1, sort_keys=True)
    if packs:
        with open(os.path.join(out, "report.md"), "w", encoding="utf-8") as f:
            f.write(markdown(spark, out, manifest))
    return manifest


def _csv(path: str, rows: list[dict]) -> None:
    """Preferred columns first, then others as they come."""
    import csv

    columns = ["repo", "index_wall_ms"]
    for r in rows:
        columns += [c for c in r if c not in columns]
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, columns)
        w.writeheader()
        w.writerows(rows)


def by_group(spark: SparkSession, out: str, key: str) -> DataFrame:
    rows = result_rows(spark, "file://" + os.path.join(os.path.abspath(out), "pack_metrics.jsonl"))
    return report.grouped_medians(rows, key, "items", "selected_tokens", "estimated_raw_tokens", "saved_pct", "stable_items")


def _number(x: float) -> str:
    """Whole numbers without a point."""
    return str(round(x)) if abs(x - round(x)) < 1e-4 else f"{x:.2f}"


def markdown(spark: SparkSession, out: str, manifest: dict) -> str:
    lines = ["# Evaluation", "", f"- repositories: {manifest['repos']}", f"- packs: {manifest['packs']}, failures: {manifest['failures']}", f"- seconds: {manifest['seconds']}", ""]
    for key in ("budget", "query_name"):
        found = by_group(spark, out, key).orderBy(key)
        lines += [f"| {key} | " + " | ".join(found.columns[1:]) + " |", "|" + "---|" * len(found.columns)]
        lines += [f"| {r[0]} | " + " | ".join(_number(x) for x in r[1:]) + " |" for r in found.collect()]
        lines.append("")
    return "\n".join(lines)


def verify(spark: SparkSession, repos: list[str], out: str) -> list[tuple[str, bool]]:
    """(check, passed): four over the run, eight for each repository against its own index."""
    base = "file://" + os.path.abspath(out) + "/"
    with open(os.path.join(out, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    index = {r["repo"]: r for r in result_rows(spark, base + "repo_index_metrics.csv").collect()}
    packs = result_rows(spark, base + "pack_metrics.jsonl").cache()
    checks = [
        ("one index row for each repository", len(index) == manifest["repos"]),
        ("packs counted", packs.count() == manifest["packs"] == manifest["repos"] * len(QUERIES) * len(BUDGETS)),
        ("no failures", manifest["failures"] == 0),
        ("packs within budgets", packs.where("selected_tokens > budget").isEmpty()),
    ]
    for root in repos:
        e, name = Engine(spark, root), os.path.basename(os.path.abspath(root))
        status, row = e.status(), index.get(name)
        checks += [(f"{name}: {k}", row is not None and int(row[f"count_{k}"]) == status[k]) for k in ("files", "chunks", "signatures", "docs", "edges")]
        mine = packs.where(F.col("repo") == name)
        checks.append((f"{name}: packs logged", mine.join(e.store.read_log("packs").select(F.col("id").alias("pack_id")), "pack_id", "left_anti").isEmpty()))
        top = e.store.table("nodes").where((F.col("kind") == S.CHUNK) & F.col("valid") & (F.col("symbol") == (row["top_symbol"] if row else "")))
        checks.append((f"{name}: top symbol indexed", not top.isEmpty()))
        checks.append((f"{name}: savings add up", mine.where("saved_tokens != greatest(estimated_raw_tokens - selected_tokens, 0)").isEmpty()))
    packs.unpersist()
    return checks
