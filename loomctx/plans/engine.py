"""The engine: index a repository, answer packs and graph questions from the latest version."""

from __future__ import annotations

import json
import os
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions import tokens
from loomctx.functions.parse import declarations
from loomctx.functions.text import first_lines
from loomctx.operators import graph as G
from loomctx.operators import delta, hotset, index, lookup, maintain, pack, postings, render, report
from loomctx.sources import config, files
from loomctx.sources.store import PACKS, Store, ulid


def git(root: str, *arguments: str) -> list[str]:
    """Lines that git prints, none where it fails or isn't there."""
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return done.stdout.splitlines() if done.returncode == 0 else []


def find_root(path: str = ".") -> str:
    """The nearest folder upwards with an index, else the folder itself."""
    start = at = os.path.abspath(path)
    while True:
        if os.path.isdir(os.path.join(at, files.STATE_DIR)):
            return at
        up = os.path.dirname(at)
        if up == at:
            return start
        at = up


#: Batches of postings until they are written anew.
BATCHES = 32


class NoIndex(RuntimeError):
    """There is no index to read."""


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.root, self.parsed, self.resolved = self.store.root, 0, {}

    # --- writing --------------------------------------------------------------------------------------------------

    def index(self, force: bool = False) -> dict:
        """Bring the index up to date. Only new and changed files are read and parsed, and only what they can affect is resolved again; ranks are made anew.

        Declarations are kept with the index, so those of unchanged files are read back. ``parsed`` is the number of files parsed by the last run.
        """
        store, spark = self.store, self.spark
        old_files, old_nodes = store.table("files"), store.table("nodes")
        now = files.listing(spark, self.root)
        known = old_files.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.col("skipped").alias("k"))
        same = (F.col("mtime") == F.col("m")) & (F.col("size") == F.col("s")) & F.col("k").isNull()
        touched = now if force else now.join(known, "path", "left").where(~F.coalesce(same, F.lit(False))).select("path", "mtime", "size")
        read = G.cut(files.prepare(files.contents(touched, self.root)))
        present = now.join(read.select("path", "content_sha", F.col("skipped").alias("why")), "path", "left").join(old_files.select("path", F.col("content_sha").alias("old_sha")), "path", "left")
        status = maintain.classify_files(present.select("path", "mtime", "size", F.coalesce("content_sha", "old_sha").alias("content_sha")), old_files, force)
        status = G.cut(status.select("path", "status"))
        changed = read.join(status.where("status in ('new', 'changed')"), "path", "left_semi")
        good = index.classified(changed.where("skipped is null"))
        # contents of unchanged files are in their file nodes, their declarations in a table of the version before
        texts_old = old_nodes.where(F.col("valid") & (F.col("kind") == S.FILE)).select("id", F.col("content").alias("text"))
        kept = old_files.where("skipped is null").join(status.where("status in ('unchanged', 'touched')"), "path", "left_semi")
        kept_text = index.classified(kept.join(texts_old, F.col("file_node") == F.col("id")).select("path", "text"))
        columns = ["path", "text", "lang", "role"]
        everything = G.cut(good.select(columns).unionByName(kept_text.select(columns)))
        old_parsed = store.table("declarations")
        parsed_new = G.cut(declarations(good.select(columns).unionByName(kept_text.select(columns).join(old_parsed, "path", "left_anti"))))
        self.parsed = parsed_new.count()
        parsed = G.cut(parsed_new.unionByName(old_parsed.join(kept_text.select("path"), "path", "left_semi")))
        placed = G.cut(index.build_nodes(everything, parsed))
        fresh, encoding = self._counted(index.one_per_id(placed), old_nodes)
        by_change = self._edges(force, status, everything, parsed, placed)
        edges = by_change["edges"]
        ranks = G.centrality(edges).select("id", "centrality")
        stamp = F.current_timestamp()
        before = old_nodes.select("id", F.col("created_at").alias("old_created"), F.lit(True).alias("was"))
        nodes = fresh.join(ranks, "id", "left").join(before, "id", "left").select(*fresh.columns, F.lit(True).alias("valid"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"), F.coalesce("old_created", stamp).alias("created_at"), F.lit(None).cast("timestamp").alias("staled_at"))
        gone = old_nodes.join(fresh.select("id"), "id", "left_anti").withColumn("staled_at", F.coalesce("staled_at", stamp)).withColumn("valid", F.lit(False))
        nodes = G.cut(nodes.unionByName(gone.select(nodes.columns)))
        chunk_places = placed.where(F.col("kind") == S.CHUNK).select("path", "id").distinct()
        old_places = maintain.members(old_files)
        changes = maintain.node_changes(old_places, chunk_places)
        history = store.table("edges").where(F.col("kind") == S.SUPERSEDES)
        edges = edges.unionByName(G.max_weight(history.unionByName(maintain.supersedes(changes))))
        merkle = placed.where(F.col("kind") == S.CHUNK).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("byte_start", "byte_end", "id"))).alias("merkle"))
        file_ids = placed.where(F.col("kind") == S.FILE).select("path", F.col("id").alias("file_node"))
        rows = now.join(read.select("path", "content_sha", "skipped"), "path", "left").join(old_files.select("path", F.col("content_sha").alias("old_sha")), "path", "left").join(merkle, "path", "left").join(file_ids, "path", "left")
        rows = rows.select("path", "file_node", F.coalesce("merkle", F.array().cast("array<struct<byte_start:bigint,byte_end:bigint,id:string>>")).alias("merkle"), "mtime", "size", F.coalesce("content_sha", "old_sha").alias("content_sha"), "skipped")
        # counts go by chunk ids: what is new, gone, or in both snapshots
        ids_now, ids_before = chunk_places.select("id").distinct(), old_nodes.where(F.col("valid") & (F.col("kind") == S.CHUNK)).select("id")
        by_id = ids_now.join(ids_before, "id", "left_anti").select(F.lit("").alias("path"), "id", F.lit("added").alias("change")).unionByName(ids_before.join(ids_now, "id", "left_anti").select(F.lit("").alias("path"), "id", F.lit("removed").alias("change")))
        counters = maintain.index_report(status, by_id, ids_now.join(ids_before, "id", "left_semi")).first().asDict()
        hot = G.cut(hotset.next_version(store.table("hot_set"), hotset.hot_members(nodes)))
        counters |= {"edges": edges.count(), "hot_set_version": hot.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]}
        head = git(self.root, "rev-parse", "--short", "HEAD")
        posts = self._post(old_nodes, nodes)
        store.commit({"nodes": nodes, "edges": edges, "files": rows, "hot_set": hot, "declarations": parsed, "references": by_change["references"], "imports": by_change["imports"]}, {"edges_by_change": True, "last_index_report": counters, "last_indexed_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "head_commit": head[0] if head else None, "postings": posts, "encoding": encoding})
        return counters

    def _counted(self, fresh: DataFrame, old_nodes: DataFrame) -> tuple[DataFrame, str | None]:
        """Nodes with exact tokens if the settings name an encoding, and what identifies it; only nodes that the same encoding hasn't counted before are."""
        path = config.load(self.root).get("encoding")
        if not path:
            return fresh, None
        ranks = tokens.read_ranks(self.spark, path)
        encoding = tokens.fingerprint(ranks)
        same = self.store.manifest()["meta"].get("encoding") == encoding
        known = old_nodes.select("id", F.col("tokens").alias("exact")) if same else old_nodes.limit(0).select("id", F.col("tokens").alias("exact"))
        new = fresh.join(known, "id", "left_anti").select("id", tokens.exact_tokens(self.spark, "content", ranks).alias("exact"))
        counts = G.cut(new.unionByName(known.join(fresh.select("id"), "id", "left_semi")))
        return fresh.join(counts, "id").withColumn("tokens", F.col("exact")).select(fresh.columns), encoding

    def _edges(self, force: bool, status: DataFrame, everything: DataFrame, parsed: DataFrame, placed: DataFrame) -> dict[str, DataFrame]:
        """References, imports and edges as the changed files leave them; ``resolved`` counts the references, imports and documents that were looked at again."""
        store, now = self.store, delta.entries(placed)
        old = {name: store.table(name) for name in ("references", "imports", "declarations", "edges", "nodes", "files")}
        if force or not store.manifest()["meta"].get("edges_by_change"):
            old = {name: table.limit(0) for name, table in old.items()}
            paths = everything.select("path")
        else:
            paths = G.cut(status.where("status in ('new', 'changed', 'deleted')").select("path"))
        places = old["files"].join(paths, "path", "left_semi").select("path", F.explode("merkle").alias("e")).select("path", F.col("e.id").alias("id"), F.col("e.byte_start").alias("ord"))
        declared = old["declarations"].select("path", F.explode("decls").alias("d")).select("path", F.col("d.name").alias("symbol"), F.col("d.byte_start").alias("ord"))
        names = G.cut(delta.changed_names(places.join(declared, ["path", "ord"]).select("id", "path", "symbol", "ord"), now.join(paths, "path", "left_semi")))
        changed = parsed.join(paths, "path", "left_semi")
        refs, refs_again = delta.change_references(old["references"], delta.references(changed, placed), paths, names, now)
        before, after = old["files"].where("skipped is null").select("path"), everything.select("path")
        moved = before.join(after, "path", "left_anti").unionByName(after.join(before, "path", "left_anti"))
        imports, imports_again = delta.change_imports(old["imports"], index.imported(changed, everything), paths, moved, after)
        docs, old_docs = (t.where(F.col("kind") == S.DOC) for t in (placed, old["nodes"].where("valid")))
        mentions, docs_again = delta.change_mentions(old["edges"].where(F.col("kind") == S.MENTIONS), old_docs, docs.select("id", "content").distinct(), names, now)
        refs, imports = G.cut(refs), G.cut(imports)
        self.resolved = {"references": refs_again.count(), "imports": imports_again.count(), "documents": docs_again.count()}
        return {"references": refs, "imports": imports, "edges": G.cut(delta.edges_of(refs, imports, mentions, placed))}

    def _post(self, old_nodes: DataFrame, nodes: DataFrame) -> dict:
        """Adds the nodes that are new or named anew to the postings and takes out those that are gone; after ``BATCHES`` runs all are written anew."""
        known = self.store.manifest()["meta"].get("postings")
        columns = ["id", *pack.SEARCHED]
        now, before = pack.searchable(nodes), pack.searchable(old_nodes)
        if known is None or known["batch"] + 1 >= BATCHES:
            known, before = {"folder": f"postings-{ulid()}", "batch": -1}, before.limit(0)
        same = [now[c].eqNullSafe(before[c]) for c in ("id", "symbol", "path")]  # an id stands for one content
        fresh, lost = now.join(before, same, "left_anti"), before.join(now, same, "left_anti")
        postings.write_batch(self.spark, self.store.uri(known["folder"]), known["batch"] + 1, fresh.select(columns), *columns, deleted=lost)
        return known | {"batch": known["batch"] + 1}

    def posts(self) -> postings.Index | None:
        known = self.store.manifest()["meta"].get("postings")
        return postings.read(self.spark, self.store.uri(known["folder"]), "string", known["batch"]) if known else None

    def gc(self, days: int = 30) -> dict:
        nodes, edges = self.store.table("nodes"), self.store.table("edges")
        kept, kept_edges = maintain.collect_garbage(nodes, edges, F.current_timestamp(), days)
        kept, kept_edges = G.cut(kept), G.cut(kept_edges)
        out = {"nodes_removed": nodes.count() - kept.count(), "edges_removed": edges.count() - kept_edges.count()}
        self.store.commit({"nodes": kept, "edges": kept_edges}, {})
        self.store.compact()
        return out

    # --- reading --------------------------------------------------------------------------------------------------

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if not self.store.exists() or not self.store.manifest()["version"]:
            raise NoIndex(f"no index in {self.root}")
        return tuple(self.store.table(t) for t in ("nodes", "edges", "files"))

    def hot(self) -> tuple[DataFrame, int]:
        table = self.store.table("hot_set")
        version = table.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        return table.where(F.col("version") == version), int(version)

    def dirty(self) -> list[str]:
        _, _, known = self._tables()
        return [r["path"] for r in maintain.dirty_files(files.listing(self.spark, self.root), known).orderBy("path").collect()]

    def requests(self, rows: list[dict]) -> DataFrame:
        settings = config.load(self.root)
        default = {"token_budget": settings["budget"], "mode": "default", "include_content": True, "dirty_paths": []}
        full = [default | {"request_id": ulid()} | {k: v for k, v in r.items() if v is not None} for r in rows]
        for r in full:
            S.profile(r["mode"])  # an unknown mode is an error
        names = [c.split()[0] for c in S.REQUESTS.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in full], S.REQUESTS)

    def packs(self, requests: DataFrame, surface: str = "cli", log: bool = True) -> list[dict]:
        """Packs of all requests, in one set of jobs; logged with their uses unless told otherwise."""
        nodes, edges, known = self._tables()
        settings, meta = config.load(self.root), self.store.manifest()["meta"]
        hot, version = self.hot()
        items, sums = pack.build_packs(requests, nodes, edges, known, hot, version, settings["weights"], settings["threshold"], self.posts())
        items = items.cache()
        found: dict[str, list] = {}
        for r in items.orderBy("request_id", "ord").collect():  # at most MAX_CANDIDATES items of each request
            found.setdefault(r["request_id"], []).append(r)
        total = {r["request_id"]: r for r in sums.collect()}
        out = []
        for q in requests.collect():
            mine, t = found.get(q["request_id"], []), total.get(q["request_id"])
            dirty = q["dirty_paths"] or []
            out.append(
                {
                    "pack_version": "1", "pack_id": q["request_id"], "query": q["query"], "mode": q["mode"] or "default", "repo": os.path.basename(self.root), "head": meta.get("head_commit"),
                    "freshness": {"state": "stale" if dirty else "fresh", "stale_files": len(dirty), "indexed_at": meta.get("last_indexed_at", "")},
                    "token_budget": q["token_budget"], "tokenizer": "ranks" if meta.get("encoding") else "bytes/4", "token_estimate": not meta.get("encoding"),
                    "items": [{k: v for k, v in {"type": r["type"], "path": r["path"], "symbol": r["symbol"], "lines": list(r["lines"]), "tokens": r["tokens"], "node": r["node"], "content": r["content"], "why": {"reason": r["reason"], "score": r["score"], "detail": r["detail"]}}.items() if v is not None} for r in mine],
                    "layout": {"stable_prefix_items": [r["node"] for r in mine if r["stable"]], "hot_set_version": version},
                    "totals": {"selected_tokens": t["selected_tokens"] if t else 0, "estimated_raw_tokens": t["raw_tokens"] if t else 0, "saved_tokens": t["saved_tokens"] if t else 0, "saved_pct": t["saved_pct"] if t else 0.0},
                }
            )
        items.unpersist()
        if log:
            now = datetime.now(timezone.utc)
            rows = [(p["pack_id"], now, p["query"], p["token_budget"], version, p["totals"]["selected_tokens"], p["totals"]["estimated_raw_tokens"], p["totals"]["saved_pct"], p["layout"]["stable_prefix_items"], json.dumps(p), surface) for p in out]
            self.store.log("packs", self.spark.createDataFrame(rows, PACKS))
            used = [(i["node"], now) for p in out for i in p["items"]]
            if used:
                self.store.log("usage", self.spark.createDataFrame(used, "node_id string, ts timestamp"))
        return out

    def pack(self, query: str, budget: int | None = None, mode: str | None = None, include_content: bool = True, dirty_paths: list[str] | None = None, surface: str = "cli", log: bool = True) -> dict:
        dirty = self.dirty() if dirty_paths is None else dirty_paths
        return self.packs(self.requests([{"query": query, "token_budget": budget, "mode": mode, "include_content": include_content, "dirty_paths": dirty}]), surface, log)[0]

    def render(self, packed: dict, form: str = "plain") -> str:
        schema = "request_id string, ord int, type string, path string, symbol string, lines array<bigint>, tokens bigint, node string, content string, stable boolean"
        stable = set(packed["layout"]["stable_prefix_items"])
        rows = [(packed["pack_id"], n, i["type"], i["path"], i.get("symbol"), i["lines"], i["tokens"], i["node"], i.get("content"), i["node"] in stable) for n, i in enumerate(packed["items"])]
        items = self.spark.createDataFrame(rows, schema)
        sums = self.spark.createDataFrame([(packed["pack_id"], packed["totals"]["selected_tokens"], packed["totals"]["saved_pct"], packed["layout"]["hot_set_version"])], "request_id string, selected_tokens long, saved_pct double, hot_set_version long")
        done = {"plain": lambda: render.render_plain(items, sums), "messages": lambda: render.render_messages(items), "chat": lambda: render.render_chat(items, sums)}[form]().first()
        return done["text"] if done else ""

    def why(self, pack_id: str) -> dict | None:
        row = self.store.read_log("packs").where(F.col("id") == pack_id).select("pack").first()
        return json.loads(row["pack"]) if row else None

    def search(self, query: str, limit: int = 10) -> list[dict]:
        nodes, edges, known = self._tables()
        request = self.requests([{"query": query, "mode": "default"}])
        hits = pack.gather(request, nodes, edges, known, pack.profiles(self.spark), self.posts(), max(limit, 10)).orderBy("place").limit(limit)
        rows = hits.join(nodes.select("id", first_lines("content", 4).alias("snippet")), "id").orderBy("place").collect()
        return [{"path": r["path"], "symbol": r["symbol"], "kind": S.NODE_KINDS[r["kind"]], "lines": [r["line_start"], r["line_end"]], "score": round(r["score"], 2), "why": {"reason": r["reason"], "detail": r["detail"]}, "node": r["id"], "snippet": r["snippet"]} for r in rows]

    def _seeds(self, name: str, with_files: bool = False) -> DataFrame:
        nodes, _, known = self._tables()
        return lookup.seeds(self.spark.createDataFrame([(name,)], "name string"), nodes, known.where("skipped is null"), with_files=with_files).select("id")

    def callers(self, symbol: str) -> list[dict]:
        nodes, edges, _ = self._tables()
        found = lookup.callers(self._best(symbol), nodes, edges).join(nodes.select(F.col("id").alias("caller"), "line_start", "line_end"), "caller").orderBy("path", "line_start")
        return [{"path": r["path"], "symbol": r["symbol"], "lines": [r["line_start"], r["line_end"]], "confidence": r["confidence"]} for r in found.collect()]

    def _best(self, symbol: str) -> DataFrame:
        nodes, _, _ = self._tables()
        chunks = nodes.where(F.col("valid") & (F.col("kind") == S.CHUNK))
        return pack.symbol_hits(chunks, self.spark.createDataFrame([(symbol,)], "name string"), 1).select("id")

    def tests(self, target: str) -> list[dict]:
        nodes, edges, _ = self._tables()
        seeds = G.cut(self._seeds(target))
        if seeds.isEmpty():
            raise KeyError(f"nothing found for '{target}'")
        found = lookup.covering_tests(seeds, nodes, edges).join(nodes.select(F.col("id").alias("test"), "line_start", "line_end"), "test").join(nodes.select("id", F.col("symbol").alias("covers")), "id").orderBy("path", "line_start", "covers")
        return [{"path": r["path"], "symbol": r["symbol"], "lines": [r["line_start"], r["line_end"]], "covers": r["covers"]} for r in found.collect()]

    def explain(self, symbol: str) -> dict | None:
        nodes, edges, _ = self._tables()
        target = G.cut(self._best(symbol))
        head = lookup.signature_of(target, nodes).first()
        if head is None:
            return None
        links = lookup.explain(target, nodes, edges).orderBy("direction", "reason", "path", "symbol").collect()
        side = lambda d: [{"reason": r["reason"], "path": r["path"], "symbol": r["symbol"]} for r in links if r["direction"] == d]
        return {"symbol": head["symbol"], "path": head["path"], "signature": head["signature"], "outgoing": side("outgoing"), "incoming": side("incoming")}

    def impact(self, target: str, depth: int = 3) -> list[dict]:
        nodes, edges, _ = self._tables()
        seeds = G.cut(self._seeds(target, with_files=True))
        if seeds.isEmpty():
            raise KeyError(f"nothing found for '{target}'")
        rows = G.impact(seeds, edges, depth, nodes.where("valid")).join(nodes.select("id", "path", "symbol"), "id").orderBy("distance", "path", "symbol").collect()
        levels = sorted({r["distance"] for r in rows})
        return [{"distance": d, "count": sum(r["distance"] == d for r in rows), "items": [{"path": r["path"], "symbol": r["symbol"], "via": r["via"]} for r in rows if r["distance"] == d]} for d in levels]

    def content(self, ids: list[str]) -> list[dict]:
        nodes, _, _ = self._tables()
        wanted = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
        return [{"node": r["id"], "path": r["path"], "content": r["content"]} for r in wanted.join(nodes, "id").orderBy("pos").collect()]

    def changed(self) -> dict:
        return {"changed_files": self.dirty(), "last_index": self.store.manifest()["meta"].get("last_index_report"), "hint": "run index to bring the graph up to date"}

    def pr_context(self, since: str | None = None, budget: int = 8000) -> dict:
        nodes, edges, _ = self._tables()
        paths = sorted(git(self.root, "diff", "--name-only", since)) if since else self.dirty()
        source = f"git diff {since}" if since else "changed since the last index"
        if not paths:
            return {"source": source, "changed_files": [], "changed_symbols": [], "impacted": {}, "suggested_pack": None}
        changed = self.spark.createDataFrame([(p,) for p in paths], "path string")
        rows = nodes.where(F.col("valid") & (F.col("kind") == S.CHUNK)).join(changed, "path", "left_semi").orderBy("path", "byte_start").collect()
        impacted = {r["relation"]: r["entries"] for r in lookup.changed_context(changed, nodes, edges).orderBy("relation").collect()}
        names = [r["symbol"] for r in rows if r["symbol"]][:5]
        packed = self.pack(f"review changes to {', '.join(names or paths)}", budget, "pr", False, paths)
        return {"source": source, "changed_files": paths, "changed_symbols": [f"{r['path']}::{r['symbol']}" for r in rows if r["symbol"]], "impacted": impacted, "suggested_pack": packed}

    # --- reports --------------------------------------------------------------------------------------------------

    def status(self) -> dict:
        nodes, edges, known = self._tables()
        meta, dirty = self.store.manifest()["meta"], self.dirty()
        return report.counts(nodes, known, edges).first().asDict() | {"last_indexed_at": meta.get("last_indexed_at"), "head": meta.get("head_commit"), "hot_set_version": self.hot()[1], "dirty_files": len(dirty), "dirty": dirty[:10]}

    def doctor(self) -> list[tuple[str, str]]:
        """(level, message) of every check: ok, warn or fail. No index or an empty one fails, all else only warns."""
        if not self.store.exists():
            return [("fail", "no index: run index first")]
        s = self.status()
        out = [("ok" if s["files"] else "fail", f"{s['files']} files, {s['chunks']} chunks, {s['edges']} edges")]
        out.append(("warn" if s["dirty_files"] else "ok", f"{s['dirty_files']} files changed since the last index"))
        out.append(("ok" if s["hot_set_version"] else "warn", f"hot set version {s['hot_set_version']}"))
        out.append(("warn" if s["skipped_files"] else "ok", f"{s['skipped_files']} files skipped"))
        try:
            config.load(self.root)
            out.append(("ok", "settings readable"))
        except ValueError as e:
            out.append(("warn", f"settings malformed: {e}"))
        return out

    def cache_report(self) -> dict:
        nodes, _, _ = self._tables()
        row = report.cache_report(self.store.table("hot_set"), nodes, self.store.packs()).first().asDict()
        last = self.store.manifest()["meta"].get("last_index_report") or {}
        return row | {"chunk_preservation_pct": last.get("preservation_pct")}

    def coverage(self, packed: dict) -> dict:
        """Coverage by reason and the risk of a pack."""
        rows = [(packed["pack_id"], i["type"], i["path"], i["tokens"], i["why"]["reason"]) for i in packed["items"]]
        items = self.spark.createDataFrame(rows, "request_id string, type string, path string, tokens long, reason string")
        dirty = ["x"] * packed["freshness"]["stale_files"]
        requests = self.spark.createDataFrame([(packed["pack_id"], dirty)], "request_id string, dirty_paths array<string>")
        return {"coverage": [r.asDict() for r in report.coverage(items).orderBy("reason").collect()], "risk": report.risk(items, requests).first().asDict()}

    def bench_token_savings(self, budget: int = 2000, queries: list[str] | None = None) -> dict:
        """Savings over three questions about each of the eight most central symbols, or over given queries, in one batch."""
        nodes, _, _ = self._tables()
        if queries is None:
            top = [r["symbol"] for r in hotset.top_chunks(nodes, 8).select("symbol").collect()]
            queries = [q.format(s) for s in top for q in ("Refactor {}", "Where is {} used", "Add tests for {}")]
        packed = self.packs(self.requests([{"query": q, "token_budget": budget, "include_content": False} for q in queries]), "bench")
        sums = self.spark.createDataFrame([(p["totals"]["saved_pct"],) for p in packed], "saved_pct double")
        return report.savings(sums).first().asDict() | {"results": [{"query": p["query"], **p["totals"]} for p in packed]}

    def bench_cache_stability(self, copy_to: str) -> dict:
        """Index a copy, append a comment to its most central source, add a document, delete it; what each step preserves and whether the hot prefix moves."""
        import shutil

        shutil.copytree(self.root, copy_to, ignore=shutil.ignore_patterns(files.STATE_DIR, ".git"), dirs_exist_ok=True)
        other = Engine(self.spark, copy_to)
        other.index()
        nodes = other.store.table("nodes")
        first = nodes.where(F.col("lang").isin("python", "typescript", "tsx", "java") & F.col("valid") & (F.col("kind") == S.CHUNK)).orderBy(F.desc("centrality"), "id").select("path", "lang").first()

        def prefix() -> list[str]:
            return [r["node_id"] for r in other.hot()[0].orderBy("position").collect()]

        steps, before = [], prefix()
        note = os.path.join(copy_to, "NOTES_bench.md")

        def edit() -> None:
            if first:
                with open(os.path.join(copy_to, first["path"]), "a", encoding="utf-8") as f:
                    f.write("\n# bench\n" if first["lang"] == "python" else "\n// bench\n")

        def add() -> None:
            with open(note, "w", encoding="utf-8") as f:
                f.write("# Notes\n\nA document that the replay adds and deletes again.\n")

        for name, act in (("append comment", edit), ("add document", add), ("delete document", lambda: os.remove(note))):
            act()
            counters = other.index()
            now = prefix()
            steps.append({"step": name, **{k: counters[k] for k in ("chunks_preserved", "chunks_staled", "chunks_new", "preservation_pct")}, "prefix_same": now == before})
            before = now
        return {"steps": steps, "stable": sum(s["prefix_same"] for s in steps), "of": len(steps), "min_preservation_pct": min([100.0, *(s["preservation_pct"] for s in steps)])}

    def graph(self, limit: int = 400) -> dict:
        """The most central nodes and the edges between them, for display."""
        nodes, edges, _ = self._tables()
        top = nodes.where("valid").orderBy(F.desc("centrality"), "id").limit(limit).select("id", "path", "symbol", "kind", "centrality")
        links = edges.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst")), "dst", "left_semi")
        return {"nodes": [r.asDict() for r in top.collect()], "edges": [r.asDict() for r in links.orderBy("src", "kind", "dst").collect()]}

