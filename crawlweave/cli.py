"""Command line: `python -m crawlweave.cli crawl --seed URL | --resume ID` and `status --run-id ID [--json]`. State lies in STORE_DIR."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import time
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crawlweave import config
from crawlweave.operators import runs as R
from crawlweave.operators import status as S
from crawlweave.pacing import GlobalPause
from crawlweave.plans import crawl as G
from crawlweave.runtime import ship
from crawlweave.sources.fetch import HttpService, MockSite
from crawlweave.sources.store import Store

STUB = "<!doctype html><title>Mock seed</title>"


def _as(parse: Callable):
    def run(text: str):
        try:
            return parse(text)
        except config.ConfigError as e:
            raise argparse.ArgumentTypeError(str(e)) from None

    return run


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="crawlweave")
    commands = top.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", argument_default=argparse.SUPPRESS)
    what = crawl.add_mutually_exclusive_group(required=True)
    what.add_argument("--seed", type=_as(config.seed))
    what.add_argument("--resume", type=_as(lambda t: config.run_uuid(t, strict=True)))
    for name, parse in (("max-urls", config.max_urls), ("max-depth", config.max_depth), ("max-bytes", config.max_amount), ("max-runtime-seconds", config.max_amount), ("concurrency", config.at_least_one), ("stale-after-ms", config.at_least_one)):
        crawl.add_argument(f"--{name}", type=_as(parse))
    crawl.add_argument("--output-dir")
    crawl.add_argument("--mock-fetch", action="store_true")
    status = commands.add_parser("status")
    status.add_argument("--run-id", required=True, type=_as(lambda t: config.run_uuid(t, strict=False)))
    status.add_argument("--json", action="store_true")
    return top


def options_of(asked: argparse.Namespace, c: config.Config) -> R.Options:
    """What a new run gets: values of the command line before those of the environment; a configured limit of 0 is none."""
    pick = lambda name, default: getattr(asked, name, default)
    whole = lambda x: None if x is None else int(x)
    return R.Options(whole(pick("max_urls", c.max_urls)), whole(pick("max_depth", c["MAX_DEPTH"])), whole(pick("max_bytes", c["MAX_BYTES"])), whole(pick("max_runtime_seconds", c["MAX_RUNTIME_SECONDS"])), int(pick("concurrency", c["CONCURRENCY"])), pick("output_dir", c["OUTPUT_DIR"]))


def resume_of(asked: argparse.Namespace, c: config.Config) -> R.Resume:
    """Only what was given on the command line."""
    names = (*R.LIMITS, "concurrency", "output_dir")
    values = {n: getattr(asked, n) for n in names if hasattr(asked, n)}
    return R.Resume({n: int(v) if isinstance(v, float) else v for n, v in values.items()}, int(getattr(asked, "stale_after_ms", c["RUN_STALE_AFTER_MS"])))


def main(argv: list[str] | None = None, env: Mapping[str, str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    """The exit code: 1 if a run failed, can't be had or is not known."""
    asked, c = parser().parse_args(argv), config.load(os.environ if env is None else env)
    spark = spark or SparkSession.builder.appName("crawlweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    store = Store(spark, c["STORE_DIR"])
    if asked.command == "status":
        found = S.of_run(store.read("runs"), store.read("urls"), store.read("contents"), asked.run_id, "json" if asked.json else "text") if store.version() else None
        if found is None:
            print(f"Crawl run not found: {asked.run_id}", file=sys.stderr)
            return 1
        out(json.dumps(found, indent=2) if asked.json else found)
        return 0
    now = F.lit(time.time()).cast("timestamp")
    try:
        run_id = getattr(asked, "resume", None)
        if run_id:
            G.resume(store, run_id, resume_of(asked, c), now)
        else:
            run_id = G.start(store, asked.seed, options_of(asked, c), now)
    except (R.RunError, G.Conflict) as e:
        print(e, file=sys.stderr)
        return 1
    run = store.read("runs").where(F.col("id") == run_id).first()
    if getattr(asked, "mock_fetch", False):
        source = MockSite(spark.createDataFrame([(run["seed_url"], 1, 200, {"content-type": "text/html"}, STUB)], G.SITE))
    else:
        source = HttpService(c["FETCH_API_BASE_URL"], c.body_strategy, concurrency=run["concurrency"])
    settings = G.Settings(batch=run["concurrency"], pause=GlobalPause(int(c["RATE_LIMIT_DELAY_MS"]), int(c["RATE_LIMIT_DEFAULT_PAUSE_MS"])))
    settings.log.logger.setLevel(c["LOG_LEVEL"].upper())
    stop = lambda *_: settings.control.shutdown.set()
    before = {s: signal.signal(s, stop) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        ended = G.advance(store, run_id, source, settings)
    finally:
        for s, f in before.items():
            signal.signal(s, f)
    out(S.of_run(store.read("runs"), store.read("urls"), store.read("contents"), run_id))
    return int(ended.status == "failed")


if __name__ == "__main__":
    sys.exit(main())
