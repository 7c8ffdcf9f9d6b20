"""The crawl's notions of state over streams: addresses seen once, a state machine of each address with timers, liveness of runs, a loop of
micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, attempt_count int, due_ms long"
CHANGE = "crawl_run_id string, normalized_url string, status string, attempt_count int, due_ms long"


def first_seen(found: DataFrame, within: str | None = None, time: str = "seen_at") -> DataFrame:
    """Each (crawl_run_id, normalized_url) once: for good, or within a delay of the event time, after which its state is dropped."""
    keys = ["crawl_run_id", "normalized_url"]
    return found.dropDuplicates(keys) if within is None else found.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def state_changes(outcomes: DataFrame, max_attempts: int = 5, base_ms: int = 5_000, most_ms: int = 300_000) -> DataFrame:
    """A change of state for each outcome(crawl_run_id, normalized_url, result) and each retry that falls due.

    result is ok, gone, blocked, rate_limited or anything else, which is tried again until attempts run out. A retry becomes queued by a
    timer of processing time; a rate limit uses up no attempt."""
    final = {"ok": "done", "gone": "permanent_failed", "blocked": "blocked"}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, due = state.get if state.exists else ("queued", 0, 0)
        rows = []
        if state.hasTimedOut:
            status = "queued" if status == "retryable_failed" else status
            rows.append((*key, status, attempts, due))
        else:
            for frame in frames:
                for result in frame["result"]:
                    if status in ("done", "permanent_failed", "blocked"):
                        continue
                    if result in final:
                        status, due = final[result], 0
                    elif result != "rate_limited" and attempts + 1 >= max_attempts:
                        status, due = "permanent_failed", 0
                    else:
                        wait = base_ms if result == "rate_limited" else min(base_ms * 2**attempts, most_ms)
                        attempts += result != "rate_limited"
                        status, due = "retryable_failed", state.getCurrentProcessingTimeMs() + wait
                    rows.append((*key, status, int(attempts), int(due)))
        state.update((status, int(attempts), int(due)))
        if status == "retryable_failed":
            state.setTimeoutDuration(max(1, due - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame(rows, columns=["crawl_run_id", "normalized_url", "status", "attempt_count", "due_ms"])

    keyed = outcomes.select("crawl_run_id", "normalized_url", "result").groupBy("crawl_run_id", "normalized_url")
    return keyed.applyInPandasWithState(step, CHANGE, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def liveness(beats: DataFrame, gap: str = "15 minutes", late: str = "1 minute") -> DataFrame:
    """Sessions of heartbeats(crawl_run_id, beat_at): a run whose session has ended was silent for longer than the gap."""
    window = F.session_window("beat_at", gap)
    return beats.withWatermark("beat_at", late).groupBy("crawl_run_id", window).agg(F.count("*").alias("beats")).select("crawl_run_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("silent_from"), "beats")


def driven(found: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls step with each micro-batch and its number, once for each number that is committed; without an interval it ends when nothing is left
    (never for state_changes, whose timers go on)."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
