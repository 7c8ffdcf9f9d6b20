"""What a run has come to: one report from its row and the counts of its addresses and contents, as a row, JSON or text."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import content
from crawlweave.schema import KINDS, URL_STATUSES

#: Fixed value: the order in which a report lists statuses.
ORDER = ("queued", "in_progress", "done", "retryable_failed", "permanent_failed", "blocked", "skipped_unsupported", "redirected")
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def report(runs: DataFrame, urls: DataFrame, contents: DataFrame) -> DataFrame:
    """A row for each run: its columns, url_<status> and content_<kind> counts, 0 where there are none; one pass over each table."""
    u = urls.groupBy(F.col("crawl_run_id").alias("id")).agg(*[F.count_if(F.col("status") == s).alias(f"url_{s}") for s in ORDER])
    c = contents.groupBy(F.col("crawl_run_id").alias("id")).agg(*[F.count_if(F.col("kind") == k).alias(f"content_{k}") for k in KINDS])
    return runs.join(u, "id", "left").join(c, "id", "left").fillna(0, [f"url_{s}" for s in URL_STATUSES] + [f"content_{k}" for k in KINDS])


def as_json(reports: DataFrame) -> DataFrame:
    """id and the report as JSON, with times in ISO-8601."""
    null = F.lit(None).cast("string")
    time = lambda c: F.date_format(c, ISO)
    body = F.struct(
        F.col("id").alias("runId"), F.col("seed_url").alias("seedUrl"), F.col("normalized_seed_url").alias("normalizedSeedUrl"),
        F.struct(F.col("scope_host").alias("host"), F.col("scope_policy").alias("policy")).alias("scope"), "status",
        time("started_at").alias("startedAt"), F.coalesce(time("finished_at"), null).alias("finishedAt"),
        F.struct(*[F.col(f"url_{s}").alias(s) for s in ORDER]).alias("urlStatusCounts"), F.struct(*[F.col(f"content_{k}").alias(k) for k in KINDS]).alias("contentKindCounts"),
        F.col("total_bytes").alias("bytesDownloaded"),
    )
    return reports.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def as_text(reports: DataFrame) -> DataFrame:
    """id and the report as lines."""
    time = lambda c: F.coalesce(F.date_format(c, ISO), F.lit("-"))
    line = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = lambda c: F.col(c).cast("string")
    lines = [
        line("Crawl Run ", F.col("id")), line("Seed: ", F.col("seed_url")), line("Scope: ", F.col("scope_host"), " (", F.col("scope_policy"), ")"),
        line("Status: ", F.col("status")), line("Started: ", time("started_at")), line("Finished: ", time("finished_at")), F.lit(""), F.lit("URL counts:"),
        *[line(f"  {s}: ", n(f"url_{s}")) for s in ORDER], F.lit(""), F.lit("Content counts:"), *[line(f"  {k}: ", n(f"content_{k}")) for k in KINDS], F.lit(""),
        line("Bytes downloaded: ", content.format_bytes(F.col("total_bytes")), " (", n("total_bytes"), " bytes)"),
    ]
    return reports.select("id", F.concat_ws("\n", *lines).alias("report"))


def of_run(runs: DataFrame, urls: DataFrame, contents: DataFrame, run_id: str, form: str = "text") -> str | dict[str, Any] | None:
    """The report of one run as text or as a dictionary; None if there is no such run."""
    one = report(runs.where(F.col("id") == run_id), urls.where(F.col("crawl_run_id") == run_id), contents.where(F.col("crawl_run_id") == run_id))
    row = (as_text if form == "text" else as_json)(one).first()
    return None if row is None else row["report"] if form == "text" else json.loads(row["report"])
