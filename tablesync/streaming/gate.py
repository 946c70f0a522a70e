"""Admission of flushes: at most so many at once, in order of arrival."""

from __future__ import annotations

import threading
import time
from collections import deque
from contextlib import contextmanager

KEPT, LEAST_MS = 64, 1000


class FlushGate:
    def __init__(self, most: int):
        self.most, self.running, self.queue = most, 0, deque()
        self.times: deque[float] = deque(maxlen=KEPT)
        self.waits, self.waited_ms, self.timeouts = 0, 0.0, 0
        self._turn = threading.Condition()

    def resize(self, most: int) -> None:
        with self._turn:
            self.most = most
            self._turn.notify_all()

    def timeout_ms(self) -> int:
        """The upper median of the last flushes' times, a second at least."""
        ordered = sorted(self.times)
        return max(LEAST_MS, int(ordered[len(ordered) // 2])) if ordered else LEAST_MS

    def average_wait_ms(self) -> int:
        return int(self.waited_ms // self.waits) if self.waits else 0

    def acquire(self, timeout_s: float | None = None) -> bool:
        ticket, began = object(), time.monotonic()
        with self._turn:
            self.queue.append(ticket)
            ok = self._turn.wait_for(lambda: self.queue[0] is ticket and self.running < self.most, timeout_s)
            self.queue.remove(ticket)
            if ok:
                self.running += 1
            else:
                self.timeouts += 1
            self.waits, self.waited_ms = self.waits + 1, self.waited_ms + 1000 * (time.monotonic() - began)
            self._turn.notify_all()
            return ok

    def release(self, took_ms: float) -> None:
        with self._turn:
            self.running -= 1
            self.times.append(took_ms)
            self._turn.notify_all()

    @contextmanager
    def flush(self):
        self.acquire()
        began = time.monotonic()
        try:
            yield
        finally:
            self.release(1000 * (time.monotonic() - began))
