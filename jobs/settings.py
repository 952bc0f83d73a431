"""Command lines of jobs: a JSON file of settings, each of which an option of the same name replaces."""

from __future__ import annotations

import argparse
import json
import logging


def settings(description: str | None, file: str, names: dict[str, type], arguments: list[str] | None = None) -> dict:
    """The settings named in ``names``; one that neither the file nor an option gives, or that the file has too much, is an error."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=file, help="JSON file of settings")
    for name, kind in names.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=kind)
    given = vars(parser.parse_args(arguments))
    with open(given.pop("config"), encoding="utf-8") as f:
        out = json.load(f)
    out |= {k: v for k, v in given.items() if v is not None}
    odd = set(out) ^ set(names)
    if odd:
        parser.error(f"missing or unknown settings: {', '.join(sorted(odd))}")
    return {k: names[k](v) for k, v in out.items()}
