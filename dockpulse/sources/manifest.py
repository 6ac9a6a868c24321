"""Which snapshots a store holds: a chain of small entries and a pointer to the newest.

The pointer is replaced as a whole once a snapshot is complete. It leads to the newest snapshot,
whose entry leads to the one before, so finding either opens one or two files however many
snapshots were ever saved.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from dockpulse.sources.paths import Paths


class Manifest:
    def __init__(self, paths: Paths, folder: str):
        self._paths = paths
        self._folder = folder

    def _entry(self, snapshot_id: str) -> dict:
        text = self._paths.read(f"{self._folder}/{snapshot_id}.json")
        if text is None:
            raise FileNotFoundError(f"no entry of snapshot {snapshot_id} in {self._folder}")
        return json.loads(text)

    def _save(self, entry: dict) -> None:
        self._paths.write(f"{self._folder}/{entry['snapshot_id']}.json", json.dumps(entry))

    def newest(self) -> dict | None:
        text = self._paths.read(f"{self._folder}/newest")
        return json.loads(text) if text else None

    def backwards(self) -> Iterator[dict]:
        """Entries from the newest to the oldest."""
        entry = self.newest()
        while entry:
            yield entry
            entry = self._entry(entry["previous"]) if entry["previous"] else None

    def latest(self, before: str | None = None) -> str | None:
        for entry in self.backwards():
            if before is None or entry["snapshot_id"] < before:
                return entry["snapshot_id"]
        return None

    def add(self, snapshot_id: str) -> None:
        """Put a snapshot in its place in the chain; one that is there stays as it is."""
        later = None
        for entry in self.backwards():
            if entry["snapshot_id"] == snapshot_id:
                return
            if entry["snapshot_id"] < snapshot_id:
                break
            later = entry
        else:
            entry = None
        added = {"snapshot_id": snapshot_id, "previous": entry and entry["snapshot_id"]}
        self._save(added)
        if later is None:
            self._paths.write(f"{self._folder}/newest", json.dumps(added))
        else:
            self._relink({**later, "previous": snapshot_id})

    def _relink(self, entry: dict) -> None:
        self._save(entry)
        if self.newest()["snapshot_id"] == entry["snapshot_id"]:
            self._paths.write(f"{self._folder}/newest", json.dumps(entry))

    def cut(self, keep: int) -> list[str]:
        """Forget all but the newest ``keep`` snapshots; returns the ids of the others."""
        entries = list(self.backwards())
        if len(entries) <= keep:
            return []
        self._relink({**entries[keep - 1], "previous": None})
        gone = [entry["snapshot_id"] for entry in entries[keep:]]
        for snapshot_id in gone:
            self._paths.delete(f"{self._folder}/{snapshot_id}.json")
        return gone
