"""What a response or an error means, and when to try again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDIRECTS = (301, 302, 303, 307, 308)
#: Error codes by what they call for.
DB_TRANSIENT, DB_CONSTRAINT = ("57P01", "08006", "08001"), ("23505", "23503")
NETWORK = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "EAI_AGAIN")


def action(status: Column, has_body: Column) -> Column:
    out = F.when(status.isin(*REDIRECTS), "redirect").when(status == 200, F.when(has_body, "success_with_body").otherwise("empty_body"))
    for code, name in ((404, "not_found"), (403, "blocked"), (429, "rate_limited"), (500, "server_error")):
        out = out.when(status == code, name)
    return out.otherwise("unexpected")


def error_class(name: Column, code: Column) -> Column:
    """retryable and type of an error in processing."""
    bug = name.isin("TypeError", "ReferenceError")
    kind = F.when(bug, "processing_bug").when(code.isin(*DB_TRANSIENT), "db_transient").when(code.isin(*DB_CONSTRAINT), "db_constraint").when(code == "ENOSPC", "storage_error").otherwise("processing_error")
    return F.struct((~kind.isin("processing_bug", "db_constraint")).alias("retryable"), kind.alias("type"))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds from a number of seconds or an HTTP date; null if it is neither. now is a timestamp in UTC."""
    text = F.trim(value)
    stamp = F.regexp_replace(text, r"^[A-Za-z]+,?\s+", "")
    at = F.coalesce(F.try_to_timestamp(stamp, F.lit("dd MMM yyyy HH:mm:ss z")), F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text)))
    ms = F.unix_millis(at) - F.unix_millis(now)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint") * 1000).when(text.rlike(r"^-\d+$"), F.lit(None).cast("bigint")).otherwise(F.when(ms < 0, F.lit(0).cast("bigint")).otherwise(ms))


def backoff_ms(attempt: Column, base: int = 5_000, most: int = 300_000, jitter: float = 0.25, random: Column | None = None) -> Column:
    """min(base * 2**attempt, most), spread by the jitter; random is in [0, 1), 0.5 gives the middle."""
    middle = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(most)))
    return F.greatest(F.lit(0).cast("bigint"), F.floor(middle * (1 + (F.lit(0.5) if random is None else random) * 2 * jitter - jitter) + 0.5).cast("bigint"))


def retry(reason: Column, attempt: Column, most: Column, after_ms: Column, fallback_ms: int = 5_000, random: Column | None = None) -> Column:
    """retry, delay_ms, consumes: a rate limit never uses up an attempt."""
    consumes = reason != "rate_limited"
    stop = consumes & (attempt + 1 >= most)
    delay = F.when(~consumes, F.coalesce(after_ms, F.lit(fallback_ms).cast("bigint"))).otherwise(backoff_ms(attempt, random=random))
    return F.struct((~stop).alias("retry"), F.when(~stop, delay).alias("delay_ms"), consumes.alias("consumes"))
