"""State of an index: versioned Parquet snapshots behind a manifest, append-only logs.

A run writes a new folder and then replaces the manifest in one rename, so readers see a whole version or the one before, and a crash
loses nothing that was committed.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions.parse import DECL
from loomctx.operators.maintain import retained, usage_stats
from loomctx.sources.files import STATE_DIR

TABLES = {
    "nodes": S.NODES,
    "edges": S.EDGES,
    "files": S.FILES,
    "hot_set": "version long, position long, node_id string",
    "declarations": f"path string, decls array<{DECL}>, imports array<string>",
    "references": "path string, chunk string, name string, kind int, is_test boolean, target string, weight double",
    "imports": "path string, module string, lang string, target string",
}
PACKS = "id string, ts timestamp, query string, budget long, hot_set_version long, selected_tokens long, raw_tokens long, saved_pct double, stable_ids array<string>, pack string, surface string"
USAGE = "node_id string, ts timestamp"
KEPT = 2


def ulid() -> str:
    """A time-ordered identifier: 48 bits of milliseconds and 80 random ones in base 32."""
    value, out = (int(time.time() * 1000) << 80) | int.from_bytes(os.urandom(10), "big"), ""
    for _ in range(26):
        value, digit = divmod(value, 32)
        out = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"[digit] + out
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self.state = os.path.join(self.root, STATE_DIR)

    @property
    def manifest_path(self) -> str:
        return os.path.join(self.state, "manifest.json")

    def exists(self) -> bool:
        return os.path.exists(self.manifest_path)

    def manifest(self) -> dict:
        if not self.exists():
            return {"version": 0, "meta": {}}
        with open(self.manifest_path, encoding="utf-8") as f:
            return json.load(f)

    def uri(self, *parts: str) -> str:
        return "file://" + os.path.join(self.state, *parts)

    def table(self, name: str) -> DataFrame:
        """A table of the current version, empty before the first, and where an older version has none of that name."""
        version = self.manifest()["version"]
        if not version or not os.path.isdir(os.path.join(self.state, f"v{version:06d}", name)):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self.uri(f"v{version:06d}", name))

    def commit(self, tables: dict[str, DataFrame], meta: dict) -> int:
        """Write the given tables, copy the others, switch the manifest; the last two versions stay for readers."""
        before = self.manifest()
        version = before["version"] + 1
        for name, schema in TABLES.items():
            df = tables.get(name, self.table(name))
            columns = [F.col(c).cast(t).alias(c) for c, t in self.spark.createDataFrame([], schema).dtypes]
            writer = df.select(columns).write.mode("overwrite")
            writer.partitionBy().parquet(self.uri(f"v{version:06d}", name))
        os.makedirs(self.state, exist_ok=True)
        temporary = f"{self.manifest_path}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump({"version": version, "meta": before["meta"] | meta}, f, indent=1, sort_keys=True)
        os.replace(temporary, self.manifest_path)
        for old in sorted(d for d in os.listdir(self.state) if d.startswith("v"))[:-KEPT]:
            shutil.rmtree(os.path.join(self.state, old), ignore_errors=True)
        return version

    def log(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.uri("log", name))

    def read_log(self, name: str) -> DataFrame:
        schema = {"packs": PACKS, "usage": USAGE}[name]
        if not os.path.isdir(os.path.join(self.state, "log", name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.uri("log", name))

    def packs(self) -> DataFrame:
        """The pack log as far as it is retained."""
        return retained(self.read_log("packs"))

    def stats(self) -> DataFrame:
        return usage_stats(self.read_log("usage"))

    def compact(self) -> None:
        """Rewrite the pack log to what is retained."""
        target = os.path.join(self.state, "log", "packs")
        if os.path.isdir(target):
            self.packs().write.mode("overwrite").parquet(self.uri("log", "packs.new"))
            shutil.rmtree(target)
            os.replace(f"{target}.new", target)
