"""Retries of calls to an upstream service; reads inside Spark are retried by its tasks."""

from __future__ import annotations

import time
from collections.abc import Callable

# Tries, first and longest wait in seconds, and the answers worth another try.
TRIES, FIRST_WAIT, LONGEST_WAIT = 10, 0.1, 5.0
AGAIN = (408, 429)


class UpstreamError(Exception):
    def __init__(self, status: int | None, message: str = ""):
        super().__init__(message or f"upstream answered {status}")
        self.status = status


def worth_retrying(error: Exception) -> bool:
    """Time-outs, too many requests, server errors, and answers that can't be read."""
    if isinstance(error, UpstreamError):
        return error.status is None or error.status in AGAIN or error.status >= 500
    return isinstance(error, (ConnectionError, TimeoutError, ValueError))


def waits(tries: int = TRIES) -> list[float]:
    return [min(FIRST_WAIT * 2**i, LONGEST_WAIT) for i in range(tries)]


def call(f: Callable, *args, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, **kwargs):
    """f's result, after as many retries as it takes, up to tries."""
    for wait in [*waits(tries), None]:
        try:
            return f(*args, **kwargs)
        except Exception as error:
            if wait is None or not worth_retrying(error):
                raise
            sleep(wait)
    raise AssertionError
