"""Limits, pauses and repetition around the supersteps: plain Python with clocks that can be given."""

from __future__ import annotations

import json
import logging
import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, TypeVar

R = TypeVar("R")
#: Fixed values, in milliseconds: polling, heartbeat, stale claims, the simple limiter and retry; redirects of one address at most.
POLL_MS, HEARTBEAT_MS, STALE_CLAIM_MS, SIMPLE_DELAY_MS, SIMPLE_RETRY_MS, MAX_REDIRECTS = 500, 60_000, 600_000, 100, 1_000, 10
#: How often the store's operations are tried, and the waits between attempts to record an outcome.
INFRA_TRIES, INFRA_BASE_MS, INFRA_MOST_MS, MARK_WAITS_MS = 5, 500, 30_000, (100, 400, 1_600)


def infra_wait_ms(failures: int) -> int:
    """Milliseconds after that many failures in a row."""
    return min(INFRA_BASE_MS * 2 ** (failures - 1), INFRA_MOST_MS)


def tried(operation: Callable[[], R], waits: tuple[int, ...], sleep: Callable[[float], None] = time.sleep, failed: Callable[[int, Exception], None] = lambda n, e: None) -> R:
    """The operation's result, at the latest after one more attempt than there are waits; the last error is raised."""
    for attempt, wait in enumerate((*waits, None), 1):
        try:
            return operation()
        except Exception as e:
            failed(attempt, e)
            if wait is None:
                raise
            sleep(wait / 1000)
    raise AssertionError


def infra(operation: Callable[[], R], sleep: Callable[[float], None] = time.sleep, failed: Callable[[int, Exception], None] = lambda n, e: None) -> R:
    """The store's operations: five attempts with growing waits."""
    return tried(operation, tuple(infra_wait_ms(k) for k in range(1, INFRA_TRIES)), sleep, failed)


def marked(operation: Callable[[], R], sleep: Callable[[float], None] = time.sleep, failed: Callable[[int, Exception], None] = lambda n, e: None) -> R:
    """The record of an outcome: three attempts."""
    return tried(operation, MARK_WAITS_MS[:2], sleep, failed)


@dataclass
class Limits:
    """Whether a session has run too long or got too much. Time counts from the session's begin, bytes from the run's."""

    max_runtime_seconds: float | None
    max_bytes: int | None
    started: float
    now: Callable[[], float] = time.time

    def reached(self, total_bytes: int) -> str | None:
        if self.max_runtime_seconds and self.now() - self.started >= self.max_runtime_seconds:
            return "runtime"
        return "bytes" if self.max_bytes and total_bytes >= self.max_bytes else None


@dataclass
class GlobalPause:
    """A base delay before every claim and one pause for all after a rate limit, until the latest time that was asked for."""

    base_ms: int = SIMPLE_DELAY_MS
    default_pause_ms: int = 5_000
    now: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    paused_until: float = 0.0

    def wait(self) -> None:
        self.sleep(self.base_ms / 1000)
        while (rest := self.paused_until - self.now()) > 0:
            self.sleep(rest)

    def limited(self, pause_ms: int | None) -> None:
        self.paused_until = max(self.paused_until, self.now() + (self.default_pause_ms if pause_ms is None else pause_ms) / 1000)


@dataclass
class SimplePause:
    """A constant delay; rate limits change nothing."""

    base_ms: int = SIMPLE_DELAY_MS
    sleep: Callable[[float], None] = time.sleep

    def wait(self) -> None:
        self.sleep(self.base_ms / 1000)

    def limited(self, pause_ms: int | None) -> None:
        pass


@dataclass
class Control:
    """Flags that end a run between supersteps."""

    shutdown: threading.Event = field(default_factory=threading.Event)
    limit: bool = False
    infra_failure: bool = False
    crash: bool = False

    def guarded(self, work: Callable[[], None], log: Events | None = None) -> None:
        """Runs work; what it raises becomes a flag."""
        try:
            work()
        except Exception as e:
            self.infra_failure = self.crash = True
            if log:
                log.emit("worker_crashed", error=str(e))


class Heartbeat:
    """Calls beat at an interval until closed; its errors are only logged."""

    def __init__(self, beat: Callable[[], None], log: Events | None = None, interval_ms: int = HEARTBEAT_MS):
        self.beat, self.log, self.interval, self.done = beat, log, interval_ms / 1000, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while not self.done.wait(self.interval):
            try:
                self.beat()
            except Exception as e:
                if self.log:
                    self.log.emit("heartbeat_failed", error=str(e))

    def close(self) -> None:
        self.done.set()
        self.thread.join(5)


class Events:
    """Structured events as JSON lines through `logging`, and kept as rows."""

    def __init__(self, name: str = "crawlweave", level: str = "info", now: Callable[[], float] = time.time):
        self.logger, self.now, self.rows = logging.getLogger(name), now, []
        self.logger.setLevel(level.upper())

    def emit(self, event: str, level: str = "info", **facts: Any) -> None:
        row = {"time": self.now(), "event": event, **facts}
        self.rows.append(row)
        self.logger.log(getattr(logging, level.upper()), json.dumps(row, default=str))

    def table(self, spark):
        """time, event and facts (JSON) of what has been emitted."""
        return spark.createDataFrame([(float(r["time"]), r["event"], json.dumps({k: v for k, v in r.items() if k not in ("time", "event")}, default=str)) for r in self.rows], "time double, event string, facts string")


def jitter() -> float:
    return random.random()
