"""Source code to declarations: the only step of indexing that needs Python, run over Arrow batches of changed files only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from loomctx.functions import parse_braces, parse_python

SCANNERS = {"python": parse_python.scan, "typescript": parse_braces.scan_typescript, "tsx": parse_braces.scan_typescript, "java": parse_braces.scan_java}
DECL = "struct<kind:string,name:string,byte_start:bigint,byte_end:bigint,line_start:bigint,line_end:bigint,signature:string,calls:array<string>,bases:array<string>,impls:array<string>>"
_DECL = pa.struct([("kind", pa.string()), ("name", pa.string()), *((c, pa.int64()) for c in ("byte_start", "byte_end", "line_start", "line_end")), ("signature", pa.string()), *((c, pa.list_(pa.string())) for c in ("calls", "bases", "impls"))])


def parse(lang: str, text: str) -> tuple[list[dict], list[str]]:
    """Declarations and imports; none for other languages, or where a scanner gives up."""
    scanner = SCANNERS.get(lang)
    if scanner is None:
        return [], []
    try:
        return scanner(text)
    except (RecursionError, MemoryError):
        return [], []


def _kernel(batches):
    for batch in batches:
        out = [parse(lang, text or "") for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([o[0] for o in out], pa.list_(_DECL)), pa.array([o[1] for o in out], pa.list_(pa.string()))], names=["path", "decls", "imports"])


def declarations(files: DataFrame) -> DataFrame:
    """(path, decls, imports) of files (path, lang, text). Small tables hold work for all cores, so files are dealt to four tasks for each, which AQE doesn't join again."""
    dealt = files.select("path", "lang", "text").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(_kernel, f"path string, decls array<{DECL}>, imports array<string>")
