"""The lifecycle of runs: creation, resumption with its checks, takeover, heartbeat, ends."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave import schema
from crawlweave.functions import suffixes, urls, whatwg

#: Which runs may go on, and which have ended for good.
RESUMABLE, FINAL = ("paused", "failed"), ("completed", "completed_with_failures", "cancelled")
LIMITS = ("max_urls", "max_depth", "max_bytes", "max_runtime_seconds")


class RunError(ValueError):
    """A run that can't be created or resumed as asked."""


@dataclass
class Options:
    max_urls: int | None = None
    max_depth: int | None = None
    max_bytes: int | None = None
    max_runtime_seconds: int | None = None
    concurrency: int = 5
    output_dir: str = "output"
    scope_policy: str = "registrable_domain"
    max_attempts: int = 5


@dataclass
class Resume:
    """What a resumption sets. Only names in `given` were asked for; None is then unlimited."""

    values: dict[str, Any] = field(default_factory=dict)
    stale_after_ms: int | None = None

    @property
    def given(self) -> set[str]:
        return set(self.values)


def is_resumable(status: Column) -> Column:
    return status.isin(*RESUMABLE)


def is_final(status: Column) -> Column:
    return status.isin(*FINAL)


def is_terminal(status: Column) -> Column:
    """Neither resumable nor stopped by a limit."""
    return ~status.isin(*RESUMABLE, "limit_reached")


def created(spark: SparkSession, seed: str, options: Options, now: Column, run_id: str | None = None, rules: suffixes.Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for runs and one for urls, the seed at depth 0."""
    if options.concurrency < 1:
        raise RunError("concurrency must be at least 1")
    if options.max_urls is not None and options.max_urls < 1:
        raise RunError("max_urls must be at least 1, or none")
    if options.scope_policy not in ("registrable_domain", "exact_host"):
        raise RunError(f"scope policy {options.scope_policy} is not supported")
    key = whatwg.normalized(seed)
    if key is None:
        raise RunError(f"invalid seed address: {seed}")
    run = run_id or str(uuid.uuid4())
    host = whatwg.parsed(key).host
    scope = urls.registrable(F.lit(host), rules) if options.scope_policy == "registrable_domain" else F.lit(host)
    values = {"id": run, "seed_url": seed, "normalized_seed_url": key, "scope_policy": options.scope_policy, "status": "running", **{n: getattr(options, n) for n in LIMITS}, "concurrency": options.concurrency, "output_dir": options.output_dir, "total_bytes": 0, "urls_enqueued": 1}
    one = spark.range(1)
    runs = _row(one, schema.RUNS, values, {"scope_host": scope, "started_at": now, "updated_at": now})
    first = {"id": url_id(F.lit(run), F.lit(key)), "url_hash": F.sha2(F.lit(key), 256), "next_attempt_at": now, "created_at": now, "updated_at": now}
    seeds = _row(one, schema.URLS, {"crawl_run_id": run, "url": seed, "normalized_url": key, "host": host, "depth": 0, "redirect_count": 0, "status": "queued", "attempt_count": 0, "max_attempts": options.max_attempts, "seq": 0, "fetches": 0}, first)
    return runs, seeds


def url_id(run: Column, key: Column) -> Column:
    return F.sha2(F.concat(run, key), 256)


def _row(one: DataFrame, ddl: str, values: dict[str, Any], made: dict[str, Column]) -> DataFrame:
    pairs = [c.split(" ", 1) for c in ddl.split(", ")]
    return one.select(*[made.get(n, F.lit(values.get(n))).cast(t).alias(n) for n, t in pairs])


def limit_increased(run: dict[str, Any], asked: Resume) -> bool:
    """Whether a limit was asked for that is greater than the run's, or none; for the running time an equal one is enough, as it starts anew."""
    for name in LIMITS:
        if name in asked.given:
            new, old = asked.values[name], run[name]
            if old is not None and (new is None or new > old or name == "max_runtime_seconds" and new == old):
                return True
    return False


def check_resume(run: dict[str, Any] | None, run_id: str, asked: Resume) -> None:
    """Raises RunError where a run may not go on as asked."""
    if run is None:
        raise RunError(f"run not found: {run_id}")
    status = run["status"]
    if status in FINAL:
        raise RunError(f"run is terminal: {status}")
    if status == "limit_reached":
        if not limit_increased(run, asked):
            raise RunError("run reached a limit: resuming needs a greater limit")
    elif status != "running" and status not in RESUMABLE:
        raise RunError(f"run is not resumable: {status}")
    if run["concurrency"] < 1 or asked.values.get("concurrency", 1) < 1:
        raise RunError("concurrency must be at least 1")
    if asked.values.get("output_dir", run["output_dir"]) != run["output_dir"]:
        raise RunError(f"output folder mismatch: the run uses {run['output_dir']}, not {asked.values['output_dir']}")
    if status == "running" and (asked.stale_after_ms is None or asked.stale_after_ms < 1):
        raise RunError("stale_after_ms must be at least 1")


def marked_running(runs: DataFrame, run_id: str | None, asked: Resume, now: Column, expected: tuple[str, ...]) -> DataFrame:
    """runs with one run (or all) set running and its limits as asked, if its status is expected and, for a running one, its heartbeat is stale."""
    hit = (F.lit(True) if run_id is None else F.col("id") == run_id) & F.col("status").isin(*expected)
    if "running" in expected:
        hit = hit & (F.col("updated_at") < F.timestamp_add("MILLISECOND", F.lit(-(asked.stale_after_ms or 0)), now))
    values = {n: F.lit(v) for n, v in asked.values.items()} | {"status": F.lit("running"), "finished_at": F.lit(None), "updated_at": now}
    return runs.select(*[F.when(hit, values[c].cast(runs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in runs.columns], hit.alias("taken"))


def ended(runs: DataFrame, run_id: str, status: Column, now: Column) -> DataFrame:
    """A run's last status; a paused run has an end as well."""
    hit = F.col("id") == run_id
    return runs.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "finished_at": F.when(hit, now).otherwise(F.col("finished_at")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def beaten(runs: DataFrame, run_id: str, now: Column) -> DataFrame:
    """A heartbeat: only of a running run."""
    return runs.withColumn("updated_at", F.when((F.col("id") == run_id) & (F.col("status") == "running"), now).otherwise(F.col("updated_at")))


def counted(runs: DataFrame, run_id: str, urls_added: int, bytes_added: int, now: Column) -> DataFrame:
    hit = F.col("id") == run_id
    more = lambda c, n: F.when(hit, F.col(c) + F.lit(n).cast(runs.schema[c].dataType)).otherwise(F.col(c))
    return beaten(runs.withColumns({"urls_enqueued": more("urls_enqueued", urls_added), "total_bytes": more("total_bytes", bytes_added)}), run_id, now)


def recounted(runs: DataFrame, url_rows: DataFrame) -> DataFrame:
    """urls_enqueued from the addresses themselves."""
    n = url_rows.groupBy(F.col("crawl_run_id").alias("id")).agg(F.count("*").cast("int").alias("n"))
    return runs.join(n, "id", "left").withColumn("urls_enqueued", F.coalesce("n", F.lit(0))).select(runs.columns)


def deleted(tables: dict[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    """All four tables without a run."""
    return {name: df.where(F.col("id" if name == "runs" else "crawl_run_id") != run_id) for name, df in tables.items()}
