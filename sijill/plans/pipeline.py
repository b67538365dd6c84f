"""Offline runs: stages in a fixed order, chosen by name, with a manifest that allows a run to be taken up again."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

STAGES = ("ingest", "merge", "citations", "qa", "triplets", "train")


def chosen(names: str | None) -> list[str]:
    """Stages of a comma-separated list in the order of ``STAGES``; all without a list."""
    if not names:
        return list(STAGES)
    wanted = {n.strip() for n in names.split(",") if n.strip()}
    if unknown := wanted - set(STAGES):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    return [s for s in STAGES if s in wanted]


class Manifest:
    """What a run has done, as a small JSON document of the driver."""

    def __init__(self, path: str, run: str):
        self.path = Path(path)
        self.doc = json.loads(self.path.read_text()) if self.path.exists() else {"run": run, "status": "running", "stages": {}, "notes": []}

    def save(self) -> None:
        self.path.write_text(json.dumps(self.doc, ensure_ascii=False, indent=1))

    def stage(self, name: str, status: str, **more) -> None:
        self.doc["stages"].setdefault(name, {}).update({"status": status, "at": time.time()} | more)
        self.save()


def run(stages: dict[str, Callable[[], dict]], names: str | None, manifest: Manifest) -> Manifest:
    """Run the chosen stages that aren't done yet. A failure is noted and raised again."""
    for name in chosen(names):
        if name not in stages or manifest.doc["stages"].get(name, {}).get("status") == "done":
            continue
        manifest.stage(name, "running")
        try:
            manifest.stage(name, "done", artifacts=stages[name]() or {})
        except Exception as e:
            manifest.stage(name, "failed", error=str(e))
            manifest.doc["status"] = "failed"
            manifest.save()
            raise
    manifest.doc["status"] = "done"
    manifest.save()
    return manifest
