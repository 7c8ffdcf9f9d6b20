"""The keyed state machine of addresses: claims, outcomes, recovery, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave import schema

STATUSES = schema.URL_STATUSES
MAX_ATTEMPTS = 5


def eligible(now: Column) -> Column:
    return F.col("status").isin("queued", "retryable_failed") & (F.col("next_attempt_at") <= now)


def claim(frontier: DataFrame, k: int, now: Column) -> DataFrame:
    """The k oldest eligible rows."""
    return frontier.where(eligible(now)).orderBy("seq").limit(k)


def recovered(frontier: DataFrame, older_than: Column | None = None) -> DataFrame:
    """In-progress rows (claimed before a time, if given) queued again; attempts stay."""
    stale = F.col("status") == "in_progress"
    if older_than is not None:
        stale = stale & (F.col("claimed_at") < older_than)
    stale = F.coalesce(stale, F.lit(False))
    return frontier.withColumns({"status": F.when(stale, "queued").otherwise(F.col("status")), "claimed_at": F.when(stale, None).otherwise(F.col("claimed_at"))})


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each value of a fixed list, also those that do not occur, with their place in the list."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, place int")
    return F.broadcast(names).join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, "place", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def termination(frontier: DataFrame, now: Column) -> DataFrame:
    """What still can happen, in one pass."""
    s = F.col("status")
    return frontier.agg(F.count_if(s == "in_progress").alias("in_progress"), F.count_if((s == "retryable_failed") & (F.col("next_attempt_at") > now)).alias("future_retryable"), F.count_if(s == "queued").alias("queued"))


def final_status(counts: Column, shutdown: bool | Column = False, limit: bool | Column = False, infra: bool | Column = False) -> Column:
    """counts: permanently failed and blocked rows together. A shutdown comes before a limit, that before a failure of the store."""
    flag = lambda x: F.lit(x) if isinstance(x, bool) else x
    return F.when(flag(shutdown), "paused").when(flag(limit), "limit_reached").when(flag(infra), "failed").when(counts > 0, "completed_with_failures").otherwise("completed")


def outcome(frontier: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """frontier with outcomes(id, action, http, content_type, error, error_type, retry, delay_ms, consumes, new_url) applied.

    Actions: done, skipped_unsupported, permanent_failed, blocked, redirected, requeued, retryable_failed. Columns that an action
    does not name keep their values."""
    o = outcomes.select("id", *[F.col(c).alias(f"o_{c}") for c in outcomes.columns if c != "id"])
    both = frontier.join(o, "id", "left")
    a = F.col("o_action")
    final = a.isin("done", "skipped_unsupported", "permanent_failed", "blocked", "redirected")
    pick = lambda cond, new, old: F.when(F.coalesce(cond, F.lit(False)), new).otherwise(F.col(old))
    out = both.withColumns({
        "status": F.when(a == "requeued", "queued").otherwise(F.coalesce(a, F.col("status"))),
        "http_status_code": pick(a.isNotNull() & (a != "skipped_unsupported"), F.col("o_http"), "http_status_code"),
        "content_type": pick(a.isin("done", "skipped_unsupported"), F.col("o_content_type"), "content_type"),
        "attempt_count": pick((a == "retryable_failed") & F.col("o_consumes"), F.col("attempt_count") + 1, "attempt_count"),
        "next_attempt_at": F.when(a == "retryable_failed", F.timestamp_add("MILLISECOND", F.col("o_delay_ms"), now)).when(a == "requeued", now).otherwise(F.col("next_attempt_at")),
        "last_error": pick(a.isin("retryable_failed", "permanent_failed", "blocked", "skipped_unsupported"), F.col("o_error"), "last_error"),
        "last_error_type": pick(a.isin("retryable_failed", "permanent_failed", "blocked", "skipped_unsupported"), F.col("o_error_type"), "last_error_type"),
        "url": pick(a == "requeued", F.col("o_new_url"), "url"),
        "redirect_count": pick(a == "requeued", F.col("redirect_count") + 1, "redirect_count"),
        "claimed_at": F.when(a.isin("retryable_failed", "requeued"), None).when(a.isNotNull(), F.coalesce("claimed_at", now)).otherwise(F.col("claimed_at")),
        "finished_at": F.when(a == "requeued", None).when(final, now).otherwise(F.col("finished_at")),
    })
    return out.select(frontier.columns)
