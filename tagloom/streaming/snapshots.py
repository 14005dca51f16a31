"""Snapshots of a feed by time bucket: a stale one is served while the next is built."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Executor, Future, ThreadPoolExecutor
from threading import Lock


class Snapshots:
    """The last built result, one build at a time for a bucket and generation.

    build(bucket) makes a result: a path of a published table, say. clear() starts a new generation, which no build begun before
    can answer.
    """

    def __init__(self, build: Callable[[int], object], pool: Executor | None = None):
        self._build, self._pool, self._lock = build, pool or ThreadPoolExecutor(2), Lock()
        self._generation, self._bucket = 0, None
        self._kept: tuple[tuple[int, int], object] | None = None
        self._running: dict[tuple[int, int], Future] = {}

    def clear(self) -> None:
        with self._lock:
            self._generation += 1

    def read(self, bucket: int):
        """The bucket's result if it is there; else the last one, stale, while a build runs; else what the build gives.

        A build that fails leaves the stale result in place, and the next read tries again. Without one, its error is raised.
        """
        with self._lock:
            key, self._bucket = (self._generation, bucket), bucket
            kept = self._kept
            if kept and kept[0] == key:
                return kept[1]
            running = self._running.get(key)
            if running is None:
                running = self._running[key] = self._pool.submit(self._make, key)
        return kept[1] if kept else running.result()

    def _make(self, key: tuple[int, int]):
        try:
            result = self._build(key[1])
            with self._lock:
                if key == (self._generation, self._bucket):
                    self._kept = key, result
            return result
        finally:
            with self._lock:
                self._running.pop(key, None)
