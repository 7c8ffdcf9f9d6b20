"""The crawl as a bulk-synchronous recursive query: each superstep claims, fetches, classifies, reads contents, admits new addresses by rank,
folds edges and publishes all tables at once. A run can stop after any step and be resumed from the tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave import schema
from crawlweave.functions import content, http, suffixes, urls
from crawlweave.operators import edges as E
from crawlweave.operators import frontier as Q
from crawlweave.operators import runs as R
from crawlweave.pacing import MAX_REDIRECTS, Control, Events, GlobalPause, Limits, SimplePause
from crawlweave.plans import contents as C
from crawlweave.runtime import remove
from crawlweave.sources.fetch import MockSite, Source
from crawlweave.sources.store import Conflict, Store

SITE = "url string, call_no int, status_code int, headers map<string,string>, body string"


@dataclass
class Summary:
    status: str
    steps: int
    version: int
    run_id: str = ""
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class Settings:
    """What a session of a run needs besides its tables. The logical clock starts at now; without one it is the wall clock.

    batch is how many addresses are claimed between two looks at limits, pauses, max_steps and the wall clock (see `looks_between`)."""

    now: str | None = None
    batch: int = 1000
    max_steps: int | None = None
    handlers: tuple[C.Handler, ...] | None = C.HANDLERS
    output_root: str | None = None
    rules: suffixes.Rules | None = None
    retry: Callable[..., Column] = http.retry
    pause: GlobalPause | SimplePause | None = None
    control: Control = field(default_factory=Control)
    log: Events = field(default_factory=Events)


def start(store: Store, seed: str, options: R.Options, now: Column, run_id: str | None = None, rules: suffixes.Rules | None = None) -> str:
    """Adds a run and its seed to the tables; other runs stay."""
    spark = store.spark
    runs, first = R.created(spark, seed, options, now, run_id, rules)
    run_id = runs.first()["id"]
    version = store.version()
    if not version:
        empty = {name: spark.createDataFrame([], ddl) for name, ddl in schema.TABLES.items()}
        store.commit(empty | {"runs": runs, "urls": first}, 0)
    else:
        store.commit({"runs": store.read("runs").unionByName(runs), "urls": store.read("urls").unionByName(first)}, version)
    return run_id


def resume(store: Store, run_id: str, asked: R.Resume, now: Column) -> int:
    """Takes a run over: one of several that try wins. How many claimed addresses were queued again."""
    version = store.version()
    runs = store.read("runs", version)
    row = runs.where(F.col("id") == run_id).first()
    R.check_resume(row.asDict() if row else None, run_id, asked)
    lost = "run is already running or not " + ("stale enough" if row["status"] == "running" else "resumable")
    taken = R.marked_running(runs, run_id, asked, now, (row["status"],))
    if not taken.where("taken").head(1):
        raise R.RunError(lost)
    table = store.read("urls", version)
    own = F.col("crawl_run_id") == run_id
    claimed = table.where(own & (F.col("status") == "in_progress")).count()
    try:
        store.commit({"runs": taken.drop("taken"), "urls": Q.recovered(table.where(own)).unionByName(table.where(~own))}, version)
    except Conflict:
        raise R.RunError(lost) from None
    return claimed


def placed(rows: DataFrame, order: str) -> DataFrame:
    """rows in ranges of the order, with their range (_part) and place in it (_row); to be written before `ranked` reads it."""
    return rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def ranked(parts: DataFrame, base: int, name: str) -> tuple[DataFrame, int]:
    """Written placed rows with `name` counting from base in their order, without gaps, and how many there are: only the ranges' sizes reach the driver."""
    sizes = {r[0]: r[1] for r in parts.groupBy("_part").count().collect()}
    offsets, at = [], base
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(at)
        at += sizes.get(part, 0)
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [base]]), F.col("_part") + 1)
    return parts.withColumn(name, first + F.col("_row")).drop("_part", "_row"), at - base


def looks_between(run: dict, s: Settings) -> bool:
    """Whether something has to be looked at after every batch. If not, a superstep takes all addresses that are ready at once."""
    return s.now is None or s.pause is not None or s.max_steps is not None or run["max_urls"] is not None or run["max_bytes"] is not None


def advance(store: Store, run_id: str, source: Source, settings: Settings | None = None) -> Summary:
    """Steps to quiescence, a limit, a shutdown or max_steps (which pauses the run), and writes the run's end in any case."""
    s = settings or Settings()
    spark, log = store.spark, s.log
    run = store.read("runs").where(F.col("id") == run_id).first().asDict()
    clock = F.lit(s.now).cast("timestamp") if s.now else F.lit(time.time()).cast("timestamp")
    limits = Limits(run["max_runtime_seconds"] if not s.now else None, run["max_bytes"], time.time())
    step = shutdown = 0
    status = "failed"
    log.emit("run_started", run_id=run_id)
    try:
        while True:
            if s.control.shutdown.is_set() or s.max_steps is not None and step >= s.max_steps:
                shutdown = 1
                break
            run = store.read("runs").where(F.col("id") == run_id).first().asDict()
            if s.control.limit or limits.reached(run["total_bytes"]):
                s.control.limit = True
                break
            table = store.read("urls").where(F.col("crawl_run_id") == run_id)
            state = table.agg(F.count_if(Q.eligible(clock)).alias("ready"), F.min(F.when(F.col("status") == "retryable_failed", F.col("next_attempt_at"))).alias("later"), F.count("*").alias("known"), F.max("seq").alias("last")).first()
            if not state["ready"]:
                if state["later"] is None:
                    break
                log.emit("waiting_for_retry", until=state["later"])
                if not s.now:
                    time.sleep(max(0.0, state["later"].timestamp() - time.time()))
                clock = F.lit(state["later"])
                continue
            if s.pause:
                s.pause.wait()
            if not s.now:
                clock = F.lit(time.time()).cast("timestamp")
            step += 1
            _superstep(store, run, source, s, clock, state)
    except Exception as e:
        s.control.infra_failure = True
        log.emit("run_crashed", level="error", run_id=run_id, error=str(e)[:500])
        raise
    finally:
        now = clock if s.now else F.lit(time.time()).cast("timestamp")
        counts = {r["status"]: r["n"] for r in Q.zero_filled(store.read("urls").where(F.col("crawl_run_id") == run_id), "status", Q.STATUSES).collect()}
        bad = F.lit(counts["permanent_failed"] + counts["blocked"])
        end = Q.final_status(bad, shutdown=bool(shutdown), limit=s.control.limit, infra=s.control.infra_failure)
        version = store.commit({"runs": R.ended(store.read("runs"), run_id, end, now)}, store.version())
        status = store.read("runs").where(F.col("id") == run_id).first()["status"]
        log.emit("run_ended", run_id=run_id, status=status, steps=step)
    return Summary(status, step, version, run_id, counts)


def _superstep(store: Store, run: dict, source: Source, s: Settings, clock: Column, state) -> None:
    spark, run_id, version = store.spark, run["id"], store.version()
    all_urls, graph, kept, runs = (store.read(t, version) for t in ("urls", "edges", "contents", "runs"))
    table = all_urls.where(F.col("crawl_run_id") == run_id)
    folder = f"{store.folder}/steps/{version}"

    def cut(df: DataFrame, name: str) -> DataFrame:
        """A step's intermediate table, written so that nothing is fetched or read twice."""
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    task = Q.claim(table, s.batch, clock) if looks_between(run, s) else table.where(Q.eligible(clock))
    got = source(task.drop("http_status_code", "content_type")).withColumn("has_body", F.coalesce(F.octet_length("body") > 0, F.lit(False)))
    header = lambda name: content.header(F.col("headers"), name)
    got = got.withColumns({"content_type": F.coalesce(header("content-type"), F.lit(content.UNKNOWN_TYPE)), "etag": header("etag"), "location": header("location"), "after": http.retry_after_ms(header("retry-after"), clock), "mismatch": content.length_mismatch(header("content-length"), F.col("body"))})
    got = got.withColumns({"act": F.when(F.col("error_kind").isNotNull(), "transport").otherwise(http.action(F.col("status_code"), F.col("has_body"))), "file_path": C.file_path(run["output_dir"], F.col("content_type"), F.col("url_hash"))})
    got = got.withColumns({"body": F.when(F.col("act") == "success_with_body", F.col("body")), "turn": urls.discovered(F.when(F.col("act") == "redirect", F.col("location")), F.col("url"))}).drop("headers")
    read = cut(C.passed_over(got) if s.handlers is None else C.processed(got, s.handlers, s.output_root), "read")  # each address is fetched and each body read once
    got = read.drop("links").withColumns({"has_location": F.coalesce(F.trim("location") != "", F.lit(False)), "location": F.col("turn.url"), "target": F.col("turn.key"), "reason": F.when(F.col("act") == "transport", F.col("error_kind")).otherwise(F.col("act"))})
    got = got.withColumn("again", s.retry(F.col("reason"), F.col("attempt_count"), F.col("max_attempts"), F.col("after")))
    turned = F.when(~F.col("has_location"), "redirect_missing_location").when(F.col("redirect_count") >= MAX_REDIRECTS, "redirect_limit_exceeded").when(F.col("target").isNull(), "redirect_invalid_location")
    got = got.withColumn("bad_turn", F.when(F.col("act") == "redirect", turned))
    act, self_turn = F.col("act"), F.col("target") == F.col("normalized_url")
    result = (
        F.when(act == "success_with_body", F.when(F.col("kind").isNull(), "skipped_unsupported").otherwise("done"))
        .when(act == "not_found", "permanent_failed").when(act == "blocked", "blocked")
        .when(act == "redirect", F.when(F.col("bad_turn").isNotNull(), "permanent_failed").when(self_turn, "requeued").otherwise("redirected"))
        .otherwise(F.when(F.col("again.retry"), "retryable_failed").otherwise("permanent_failed"))
    )
    why = F.coalesce("bad_turn", F.when(act == "not_found", "http_status").when(act == "unexpected", "unexpected_status").when(act == "success_with_body", "unsupported_content_type").otherwise(F.col("reason")))
    code = F.when(act == "transport", F.col("error_status")).otherwise(F.col("status_code"))
    outcomes = got.select("id", result.alias("action"), code.alias("http"), "content_type", why.alias("error"), why.alias("error_type"), F.col("again.delay_ms").alias("delay_ms"), F.col("again.consumes").alias("consumes"), F.col("location").alias("new_url"))
    outcomes = outcomes.withColumn("http", F.when((F.col("action") == "permanent_failed"), F.coalesce("http", F.lit(0))).otherwise(F.col("http")))

    at = lambda place: F.struct(F.lit(version).cast("long").alias("step"), F.col("seq"), place.cast("int").alias("place"))
    found = read.where("links is not null").select(F.col("id").alias("from_url_id"), "depth", "seq", F.explode("links").alias("l"))
    found = found.select("from_url_id", (F.col("depth") + 1).alias("depth"), F.lit(0).alias("redirect_count"), F.col("l.source").alias("source"), F.col("l.discovered_url").alias("discovered_url"), F.col("l.key").alias("key"), at(F.col("l.place")).alias("at"))
    moved = got.where((act == "redirect") & F.col("bad_turn").isNull() & ~self_turn).select(F.col("id").alias("from_url_id"), "depth", (F.col("redirect_count") + 1).alias("redirect_count"), F.lit("redirect").alias("source"), F.col("location").alias("discovered_url"), F.col("target").alias("key"), at(F.lit(0)).alias("at"))
    scope = urls.registrable(urls.host(F.col("key")), s.rules) if run["scope_policy"] == "registrable_domain" else urls.host(F.col("key"))
    cand = cut(found.unionByName(moved).withColumn("in_scope", F.coalesce(scope == F.lit(run["scope_host"]), F.lit(False))), "candidates")
    deep = F.lit(False) if run["max_depth"] is None else F.col("depth") > run["max_depth"]
    fresh = cand.where(F.col("in_scope") & ~deep).join(table.select(F.col("normalized_url").alias("key")), "key", "left_anti")
    heads = E.first_by(fresh.select("key", "at", "from_url_id", "depth", "redirect_count", "discovered_url"), ["key"], ["at"])
    if run["max_urls"] is not None:
        heads = heads.orderBy("at").limit(max(0, run["max_urls"] - run["urls_enqueued"]))
    heads, added = ranked(cut(placed(heads, "at"), "heads"), state["last"] + 1, "seq")
    made = {"id": R.url_id(F.lit(run_id), F.col("key")), "crawl_run_id": F.lit(run_id), "url": F.col("discovered_url"), "normalized_url": F.col("key"), "url_hash": F.sha2("key", 256), "host": urls.host(F.col("key")), "status": F.lit("queued"), "attempt_count": F.lit(0), "max_attempts": F.lit(Q.MAX_ATTEMPTS), "next_attempt_at": clock, "discovered_from_url_id": F.col("from_url_id"), "created_at": clock, "updated_at": clock, "fetches": F.lit(0)}
    made |= {c: F.col(c) for c in ("depth", "redirect_count", "seq")}
    new = heads.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in all_urls.schema.fields])

    known = table.select(F.col("normalized_url").alias("key"), F.col("id").alias("to_url_id")).unionByName(new.select(F.col("normalized_url").alias("key"), F.col("id").alias("to_url_id")))
    seen = cand.join(known, "key", "left")
    reason = E.decided(F.col("in_scope"), F.col("depth"), run["max_depth"], F.col("to_url_id").isNotNull(), F.lit(False))
    seen = cut(seen.select(F.lit(run_id).alias("crawl_run_id"), "from_url_id", F.col("key").alias("normalized_discovered_url"), "source", F.when(reason.isNull(), F.col("to_url_id")).alias("to_url_id"), "in_scope", reason.alias("skip_reason"), "discovered_url", F.col("at").alias("ord")), "seen")
    facts = read.agg(F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("byte_size"))), F.lit(0)).alias("bytes"), F.count_if("mismatch").alias("mismatched"), F.max(F.when(act == "rate_limited", F.coalesce("after", F.lit(-1).cast("long")))).alias("pause")).first()
    hit = read.select("id").withColumn("hit", F.lit(1))
    after = Q.outcome(table, outcomes, clock).join(hit, "id", "left")
    after = after.withColumns({"fetches": F.col("fetches") + F.coalesce("hit", F.lit(0)), "updated_at": F.when(F.col("hit").isNotNull(), clock).otherwise(F.col("updated_at"))}).drop("hit")
    others = all_urls.where(F.col("crawl_run_id") != run_id)
    tables = {"urls": after.unionByName(new).unionByName(others.select(after.columns)), "runs": R.counted(runs, run_id, added, facts["bytes"], clock)}
    if seen.head(1):
        tables["edges"] = E.upserted(graph, seen, "ord").select(*graph.columns)
    fresh_contents = C.inserted(kept, C.content_rows(read, clock))
    if s.handlers is not None:
        tables["contents"] = kept.unionByName(fresh_contents)
    store.commit(tables, version)
    if run["max_urls"] is not None and seen.where("skip_reason = 'limit'").head(1):
        s.control.limit = True
    if facts["pause"] is not None:
        s.log.emit("rate_limited_pause", ms=facts["pause"])
        if s.pause:
            s.pause.limited(None if facts["pause"] < 0 else facts["pause"])
    if facts["mismatched"]:
        s.log.emit("content_length_mismatch", level="warning", n=facts["mismatched"])
    s.log.emit("step_committed", run_id=run_id, version=version + 1, bytes=facts["bytes"])
    remove(spark, folder)


def crawl(spark: SparkSession, site: DataFrame | Source, seed: str, folder: str, now: str = "2026-07-03 12:00:00", batch: int = 1000, max_steps: int | None = None, run_id: str = "run-1", settings: Settings | None = None, **options) -> Summary:
    """A whole run over a mock site (see MockSite) or another source with a logical clock, which is moved to the next retry when nothing else is left."""
    store = Store(spark, folder)
    s = settings or Settings()
    s.now, s.batch, s.max_steps = now, batch, max_steps
    start(store, seed, R.Options(**{"scope_policy": options.pop("policy", "registrable_domain")} | options), F.lit(now).cast("timestamp"), run_id, s.rules)
    if not isinstance(site, DataFrame):
        return advance(store, run_id, site, s)
    source = MockSite(site)
    try:
        return advance(store, run_id, source, s)
    finally:
        source.close()
