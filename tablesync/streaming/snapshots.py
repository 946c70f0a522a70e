"""Snapshots in the background: one at a time per table, so a large one doesn't hold up the stream."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor


class SnapshotManager:
    def __init__(self, most: int = 4):
        self.pool, self.running, self._lock = ThreadPoolExecutor(max_workers=most), {}, threading.Lock()

    def kick(self, table: str, work: Callable[[], None]) -> bool:
        """Starts work for a table unless it has some in flight; True if it was started."""
        with self._lock:
            if table in self.running:
                return False
            self.running[table] = self.pool.submit(work)
            return True

    def harvest(self, table: str) -> Future | None:
        """The finished work of a table, once."""
        with self._lock:
            f = self.running.get(table)
            if f is None or not f.done():
                return None
            return self.running.pop(table)

    def wait(self) -> None:
        for f in list(self.running.values()):
            f.exception()
