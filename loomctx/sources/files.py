"""Repository files as a table: listing with ignore rules, contents, skip reasons.

Listing is metadata only and happens on the driver; contents are read by tasks. Bodies of sources that are tables already
(path, mtime, size, content) come in by ``prepare`` directly.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomctx.functions.text import normalize, text_sha

STATE_DIR = ".loomctx"
IGNORE_FILES = (".gitignore", ".ignore", ".contextignore")
MAX_BYTES = 2 * 1024 * 1024
# What is never indexed.
BINARY_EXTENSIONS = "png jpg jpeg gif webp ico pdf zip gz tar bz2 xz 7z jar class so dylib dll exe bin o a woff woff2 ttf eot otf mp3 mp4 mov avi wasm pyc db sqlite parquet".split()
LOCK_FILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock poetry.lock uv.lock Pipfile.lock composer.lock Gemfile.lock".split()


def ignore_pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(regex on a path below the file's folder, negated, folders only) of one ignore line; None for blanks and comments."""
    line = line.rstrip("\n").rstrip("\r")
    line = line if line.endswith("\\ ") else line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            j = line.index("]", i + 2) if line[i + 1] in "!]" and "]" in line[i + 2 :] else line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : j].replace("!", "^", 1 if line[i + 1] == "!" else 0).replace("\\", "\\\\") + "]", j + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folder


class Ignore:
    """Rules of all ignore files above a path; the last rule that matches decides, nearer folders last."""

    def __init__(self, rules: list[tuple[str, re.Pattern, bool, bool]] | None = None):
        self.rules = rules or []

    def below(self, folder: str, relative: str) -> Ignore:
        found = []
        for name in IGNORE_FILES:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    found += [(relative, *p) for line in f if (p := ignore_pattern(line))]
        return Ignore(self.rules + found) if found else self

    def __call__(self, path: str, is_folder: bool) -> bool:
        verdict = False
        for base, pattern, negated, folder in self.rules:
            inside = path[len(base) + 1 :] if base else path
            if (is_folder or not folder) and (not base or path.startswith(base + "/")) and pattern.match(inside):
                verdict = not negated
        return verdict


def wanted_name(name: str) -> bool:
    """Neither a lock file, nor minified, nor of a binary kind."""
    extension = name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""
    return name not in LOCK_FILES and not name.endswith((".min.js", ".min.css")) and extension not in BINARY_EXTENSIONS


def repo_files(root: str) -> list[tuple[str, int, int]]:
    """Sorted (relative path, mtime, size) of the files to index; hidden files and folders and ignored ones are left out."""
    out: list[tuple[str, int, int]] = []
    stack = [("", Ignore())]
    while stack:
        relative, above = stack.pop()
        folder = os.path.join(root, relative)
        rules = above.below(folder, relative)
        for entry in os.scandir(folder):
            path = f"{relative}/{entry.name}" if relative else entry.name
            if entry.name.startswith(".") or entry.name == STATE_DIR or entry.is_symlink():
                continue
            if entry.is_dir():
                if not rules(path, True):
                    stack.append((path, rules))
            elif entry.is_file() and wanted_name(entry.name) and not rules(path, False):
                stat = entry.stat()
                if stat.st_size <= MAX_BYTES:
                    out.append((path, int(stat.st_mtime), stat.st_size))
    return sorted(out)


def _read(root: str):
    def kernel(batches):
        for batch in batches:
            bodies = []
            for path in batch.column("path").to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        bodies.append(f.read())
                except OSError:
                    bodies.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary())], names=[*batch.schema.names, "content"])

    return kernel


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size)."""
    return spark.createDataFrame(repo_files(root), "path string, mtime long, size long")


def contents(files: DataFrame, root: str) -> DataFrame:
    """Adds ``content``, read by tasks from a folder that they all see; files that can't be read are gone."""
    schema = "path string, mtime long, size long, content binary"
    return files.select("path", "mtime", "size").mapInArrow(_read(os.path.abspath(root)), schema).where("content is not null")


def prepare(files: DataFrame) -> DataFrame:
    """(path, mtime, size, skipped, text, content_sha): a zero byte makes a file binary, invalid UTF-8 is skipped, the rest is normalised."""
    zero = F.position(F.unhex(F.lit("00")), F.col("content")) > 0
    as_text = F.decode("content", "UTF-8")
    skipped = F.when(zero, "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "non-utf8")
    out = files.withColumn("skipped", skipped).withColumn("text", F.when(F.col("skipped").isNull(), normalize(as_text)))
    return out.select("path", "mtime", "size", "skipped", "text", text_sha("text").alias("content_sha"))


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """One query a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query != ''")


def result_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Result files of the harness, CSV with a header or JSON lines; a schema spares the inference pass."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.csv(path, header=True, inferSchema=schema is None)
