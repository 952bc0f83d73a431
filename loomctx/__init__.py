"""loomctx: a Spark-first context engine (code graph, retrieval, budgeted context packs)."""

__version__ = "0.1.0"
