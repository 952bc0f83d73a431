"""Settings file: scoring weights, budget, threshold. Absent means defaults, malformed is an error."""

from __future__ import annotations

import os
import tomllib

from loomctx import schema as S
from loomctx.sources.files import STATE_DIR

TEMPLATE = """# Scoring weights of context packs and defaults of the planner.
[scoring]
text = 0.40
hop = 0.25
edge_prior = 0.15
centrality = 0.10
role = 0.10

[plan]
budget = 12000
threshold = 0.0
# encoding = "PATH"   a file of byte-pair ranks; tokens are then counted, not estimated
"""


def load(root: str) -> dict:
    """{'weights': {...}, 'budget': int, 'threshold': float}, and 'encoding', a path, if it is set."""
    path = os.path.join(root, STATE_DIR, "config.toml")
    found: dict = {}
    if os.path.exists(path):
        with open(path, "rb") as f:
            found = tomllib.load(f)
    scoring, plan = found.get("scoring", {}), found.get("plan", {})
    return {"weights": {k: float(scoring.get(k, v)) for k, v in S.WEIGHTS.items()}, "budget": int(plan.get("budget", S.DEFAULT_BUDGET)), "threshold": float(plan.get("threshold", 0.0))} | ({"encoding": str(plan["encoding"])} if "encoding" in plan else {})


def init(root: str) -> list[str]:
    """Create the state folder, its settings template and the ignore entry, each only if missing; what was done."""
    done, state = [], os.path.join(root, STATE_DIR)
    os.makedirs(state, exist_ok=True)
    config, ignore = os.path.join(state, "config.toml"), os.path.join(root, ".gitignore")
    if not os.path.exists(config):
        with open(config, "w", encoding="utf-8") as f:
            f.write(TEMPLATE)
        done.append("config.toml")
    lines = open(ignore, encoding="utf-8").read().splitlines() if os.path.exists(ignore) else []
    if f"{STATE_DIR}/" not in lines:
        with open(ignore, "a", encoding="utf-8") as f:
            f.write(("\n" if lines and lines[-1] else "") + f"{STATE_DIR}/\n")
        done.append(".gitignore")
    return done
