"""Data model: enumerations, task profiles and table schemas."""

from __future__ import annotations

# Node and edge kinds by number.
NODE_KINDS = {1: "file", 2: "ast_chunk", 3: "signature", 4: "doc_chunk"}
FILE, CHUNK, SIGNATURE, DOC = 1, 2, 3, 4
EDGE_KINDS = {1: "imports", 2: "calls", 3: "inherits", 4: "implements", 5: "tested_by", 6: "doc_mention", 7: "supersedes"}
IMPORTS, CALLS, INHERITS, IMPLEMENTS, TESTED_BY, MENTIONS, SUPERSEDES = range(1, 8)
WALK_KINDS = (IMPORTS, CALLS, INHERITS, IMPLEMENTS, TESTED_BY, MENTIONS)
IMPACT_KINDS = (IMPORTS, CALLS, INHERITS, IMPLEMENTS, TESTED_BY)
#: Why a neighbour is there, by edge kind: followed forwards, backwards.
REASONS = {1: ("imports", "imported_by"), 2: ("calls", "called_by"), 3: ("inherits", "inherits"), 4: ("inherits", "inherits"), 5: ("tested_by", "tested_by"), 6: ("doc_mention", "doc_mention"), 7: ("supersedes", "supersedes")}

# Scoring weights, priors by reason group, roles.
WEIGHTS = {"text": 0.40, "hop": 0.25, "edge_prior": 0.15, "centrality": 0.10, "role": 0.10}
PRIORS = {"anchor": 1.0, "calls": 0.8, "tested_by": 0.8, "structure": 0.6, "doc": 0.4, "other": 0.5}
ROLES = {"role_test": 0.5, "role_code": 0.7}
SECURITY_WORDS = ["auth", "token", "secret", "session", "password", "permission", "crypt", "valid", "sanitiz", "credential"]
MODES = ("default", "bugfix", "refactor", "test", "security", "architecture", "pr")
#: What each mode changes.
OVERRIDES = {
    "default": {},
    "bugfix": {"tested_by": 1.0, "calls": 0.9, "role_test": 0.9, "anchor_dirty": True},
    "refactor": {"calls": 0.9, "structure": 0.9, "doc": 0.3, "role_test": 0.6, "role_code": 0.8},
    "test": {"tested_by": 1.0, "role_test": 1.0, "role_code": 0.6},
    "security": {"tested_by": 0.7, "keywords": SECURITY_WORDS, "bonus": 0.15},
    "architecture": {"doc": 1.0, "structure": 0.9, "role_test": 0.3},
    "pr": {"tested_by": 0.9, "doc": 0.5, "role_test": 0.8, "anchor_dirty": True},
}

DEFAULT_BUDGET = 12_000
MAX_CANDIDATES = 600
SEARCH_HITS = 32
ANCHOR_HITS = 3
FILE_FANOUT = 8
FRONTIER = 512
MENTIONS_PER_DOC = 8
HOT_POOL, HOT_TOKENS, HOT_MEMBERS, HOT_VERSIONS = 200, 4_000, 64, 3
PACKS_KEPT = 10_000

NODES = "id string, hash string, kind int, path string, symbol string, lang string, role string, byte_start long, byte_end long, line_start long, line_end long, tokens long, content string, valid boolean, centrality double, created_at timestamp, staled_at timestamp"
EDGES = "src string, kind int, dst string, weight double"
FILES = "path string, file_node string, merkle array<struct<byte_start:bigint,byte_end:bigint,id:string>>, mtime long, size long, content_sha string, skipped string"
REQUESTS = "request_id string, query string, token_budget long, mode string, include_content boolean, dirty_paths array<string>"


def profile(mode: str, weights: dict[str, float] | None = None, threshold: float = 0.0) -> dict:
    """Everything that scoring needs for a task mode; an empty mode is the default one, an unknown one an error."""
    mode = mode or "default"
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}' (valid: {'|'.join(MODES)})")
    out = {"mode": mode, **{f"w_{k}": v for k, v in (WEIGHTS | (weights or {})).items()}, **PRIORS, **ROLES, "keywords": [], "bonus": 0.0, "anchor_dirty": False, "threshold": threshold} | OVERRIDES[mode]
    if mode == "architecture":
        # structure matters more than words for orientation
        out["w_centrality"] = min(1.0, out["w_centrality"] * 2)
        out["w_text"] = max(0.0, out["w_text"] - 0.10)
    return out
