"""Columns and allowed values of the four state tables, and the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "id string, seed_url string, normalized_seed_url string, scope_host string, scope_policy string, status string, max_urls int, max_depth int, max_bytes bigint, max_runtime_seconds int, concurrency int, output_dir string, total_bytes bigint, urls_enqueued int, started_at timestamp, finished_at timestamp, updated_at timestamp"
URLS = "id string, crawl_run_id string, url string, normalized_url string, url_hash string, host string, depth int, redirect_count int, status string, http_status_code int, content_type string, attempt_count int, max_attempts int, next_attempt_at timestamp, last_error string, last_error_type string, discovered_from_url_id string, claimed_at timestamp, finished_at timestamp, created_at timestamp, updated_at timestamp, seq bigint, fetches int"
CONTENTS = "id string, crawl_url_id string, crawl_run_id string, kind string, content_type string, file_path string, byte_size bigint, content_hash string, etag string, metadata string, metadata_status string, metadata_error string, created_at timestamp"
EDGES = "crawl_run_id string, from_url_id string, normalized_discovered_url string, source string, to_url_id string, in_scope boolean, skip_reason string, discovered_url string, ord struct<step:bigint,seq:bigint,place:int>"
TABLES = {"runs": RUNS, "urls": URLS, "contents": CONTENTS, "edges": EDGES}

#: What status, kind and reason columns may hold.
RUN_STATUSES = ("running", "paused", "completed", "completed_with_failures", "failed", "limit_reached", "cancelled")
URL_STATUSES = ("queued", "in_progress", "done", "retryable_failed", "permanent_failed", "skipped_unsupported", "blocked", "redirected")
KINDS = ("html", "image", "video", "pdf")
METADATA_STATUSES = ("ok", "partial", "failed")
SKIP_REASONS = ("scope", "depth", "limit")
ALLOWED = {"runs": {"status": RUN_STATUSES}, "urls": {"status": URL_STATUSES}, "contents": {"kind": KINDS, "metadata_status": METADATA_STATUSES}, "edges": {"skip_reason": SKIP_REASONS}}
KEYS = {"runs": ["id"], "urls": ["crawl_run_id", "normalized_url"], "contents": ["crawl_url_id"], "edges": ["crawl_run_id", "from_url_id", "normalized_discovered_url", "source"]}


def violations(df: DataFrame, table: str) -> DataFrame:
    """(rule, n) of every rule of the table that rows break: values that are not allowed, negative counters, keys that repeat or are null."""
    bad = {f"{c} is not allowed": F.col(c).isNotNull() & ~F.col(c).isin(*values) if c == "skip_reason" else F.col(c).isNull() | ~F.col(c).isin(*values) for c, values in ALLOWED[table].items() if c in df.columns}
    bad |= {f"{c} is negative": F.col(c) < 0 for c in ("urls_enqueued", "total_bytes", "attempt_count", "redirect_count", "depth") if c in df.columns}
    keys = [k for k in KEYS[table] if k in df.columns]
    bad |= {f"{k} is null": F.col(k).isNull() for k in keys}
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(rule) for rule, c in bad.items()])
    each = counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, bad)), F.array(*[F.col(f"`{r}`") for r in bad]))).alias("rule", "n"))
    twice = df.groupBy(*keys).agg(F.count("*").alias("m")).where("m > 1").agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).cast("long").alias("n")).select(F.lit(f"{', '.join(keys)} repeats").alias("rule"), "n")
    return each.unionByName(twice).where("n > 0")


def backfilled_edges(edges: DataFrame) -> DataFrame:
    """Edges of an older layout: missing keys and sources are filled, reasons follow the scope flag."""
    known = lambda c, d: F.coalesce(F.col(c), d).alias(c)
    fill = {"normalized_discovered_url": F.col("discovered_url"), "source": F.lit("unknown")}
    rest = [known(c, fill[c]) if c in fill else F.col(c) for c in edges.columns if c != "skip_reason"]
    return edges.select(*rest, F.when(F.col("in_scope"), F.lit(None).cast("string")).otherwise("scope").alias("skip_reason"))


def downgraded(tables: dict[str, DataFrame], level: int) -> dict[str, DataFrame]:
    """State tables as an older layout has them: below 5 no reasons or keys of edges, below 4 no counter of addresses, below 3 no output
    folder and `paused` as `cancelled`, below 2 no redirect counts, below 1 no tables."""
    if level < 1:
        return {}
    without = {5: {"edges": ["skip_reason"]}, 4: {"runs": ["urls_enqueued"]}, 3: {"runs": ["output_dir"]}, 2: {"urls": ["redirect_count"]}}
    gone = [w for n, w in without.items() if level < n]
    out = {name: df.drop(*reduce(lambda a, w: a + w.get(name, []), gone, [])) for name, df in tables.items()}
    if level < 3 and "runs" in out:
        out["runs"] = out["runs"].withColumn("status", F.when(F.col("status") == "paused", "cancelled").otherwise(F.col("status")))
    if level < 2 and "urls" in out:
        out["urls"] = out["urls"].withColumn("status", F.when(F.col("status") == "redirected", "done").otherwise(F.col("status")))
    return out
