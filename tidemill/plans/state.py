"""What is kept from run to run: watermarks and accepted schemas, in one JSON file."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime, timezone
from pathlib import Path


class State:
    """A small keyed store; each change is written beside the file and renamed over it."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.entries: dict[str, list[dict]] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, key: str) -> dict | None:
        """The last value; None if there is none or it was cleared."""
        history = self.entries.get(key)
        return history[-1]["value"] if history else None

    def set(self, key: str, value: dict | None, run_id: str, by: str = "run") -> None:
        self.entries.setdefault(key, []).append({"value": value, "run": run_id, "by": by, "at": datetime.now(timezone.utc).isoformat()})
        self._save()

    def rollback(self, key: str, run_id: str) -> dict | None:
        """Back to the value from before the last change; returns it."""
        history = self.entries.get(key, [])
        before = history[-2]["value"] if len(history) > 1 else None
        self.set(key, before, run_id, "rollback")
        return before

    def history(self, key: str) -> list[dict]:
        return [*self.entries.get(key, [])]

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=self.path.parent)
        with os.fdopen(handle, "w") as f:
            json.dump(self.entries, f, indent=1)
        os.replace(name, self.path)
