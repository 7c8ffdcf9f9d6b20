"""Runs, contents, fetching, reports, configuration, pacing, the command line and streams."""

import json
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from crawlweave import cli, config, pacing, schema
from crawlweave.functions import urls, whatwg
from crawlweave.operators import runs as R
from crawlweave.plans import contents as C
from crawlweave.plans import crawl as G
from crawlweave.sources import fetch
from crawlweave.sources.store import Conflict, Store
from crawlweave.streaming import frontier as SF

A = "https://example.com"
NOW = "2026-07-03 12:00:00"


@pytest.mark.parametrize(("text", "key"), [
    ("HTTP://Example.com:80/a/../b/%2e%2E/c//?b=2&a=1&a=0#x", A + "/c?a=0&a=1&b=2"), ("https://h:0443", "https://h/"), ("http://h:443/x/", "https://h/x"), ("https://h:80/", "https://h:80/"), ("http://h:8080/", "https://h:8080/"),
    ("http://münchen.de/ü?q=ä b&flag", "https://xn--mnchen-3ya.de/%C3%BC?flag=&q=%C3%A4+b"), ("http://0x7f.1/", "https://127.0.0.1/"), ("http://ex ample.com/", None), ("http:\\\\h\\a", "https://h/a"), ("mailto:x", None), ("/rel", None),
    ("https://u:p@h/x?z=~*", "https://u:p@h/x?z=%7E*"), ("http://[::0001]:8080/", "https://[::1]:8080/"), ("http://h:99999/", None), ("http://256.1.1.1/", None),
])
def test_keys(text, key):
    assert whatwg.normalized(text) == key
    assert key is None or whatwg.normalized(key) == key


def test_expressions_agree_with_the_parser(spark):
    texts = ["http://example.com", "https://Example.com:443/a/./b/../c/", "http://example.com:8080/ä?x=1&b=&a=%20", "https://example.com/%7e?q#f", "http://exa_mple.com:0080/", "http://1.2.3.4/", "http://münchen.de/", "http://a b/", "ftp://x/", "http://h/a\\b", "http://h/%2e%2e/x", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.k for r in df.select(urls.normalized_any(F.col("t")).alias("k")).collect()] == [whatwg.normalized(t) for t in texts]
    links = ["/b?x=1", "c", "?q", "", "//other.org/x", "https://Z.com", "mailto:x", "../../d/./e"]
    df = spark.createDataFrame([(h,) for h in links], "h string")
    base = "http://example.com:443/a/b?y=1"
    assert [r.k for r in df.select(urls.resolved(F.col("h"), F.lit(base)).alias("k")).collect()] == [whatwg.discovered(h, base)[0] for h in links]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII5B", 13, b"IHDR", w, h, 8, 2, 0, 0, 0) + struct.pack(">I", zlib.crc32(b""))


def test_contents(spark, tmp_path):
    pdf = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj 3 0 obj<</Type/Page>>endobj 4 0 obj<</Title(Doc)>>endobj"
    rows = [("1", "text/html", b'<title>T</title><a href="/x">a</a><a href="mailto:x">b</a>'), ("2", "image/png", png(3, 4)), ("3", "image/png", b"no"), ("4", "application/pdf", pdf), ("5", "application/pdf", b"not-a-valid-pdf"), ("6", "video/mp4", b"123"), ("7", "application/json", b"{}"), ("8", None, b"x"), ("9", "text/html", None)]
    df = spark.createDataFrame([(i, "run", A + "/" + i, t, f"output/k/{i}", None, b) for i, t, b in rows], "id string, crawl_run_id string, url string, content_type string, file_path string, etag string, body binary")
    out = C.content_rows(C.processed(df, root=f"file://{tmp_path}"), F.lit(NOW).cast("timestamp"))
    got = {r.crawl_url_id: (r.kind, json.loads(r.metadata), r.metadata_status, r.byte_size) for r in out.collect()}
    assert got == {
        "1": ("html", {"title": "T", "discoveredLinkCount": 1}, "ok", len(rows[0][2])), "2": ("image", {"width": 3, "height": 4, "fileSize": len(png(3, 4))}, "ok", len(png(3, 4))), "3": ("image", {"fileSize": 2}, "partial", 2),
        "4": ("pdf", {"pageCount": 1, "title": "Doc"}, "ok", len(pdf)), "5": ("pdf", {"fileSize": 15}, "failed", 15), "6": ("video", {"fileSize": 3, "durationSeconds": None}, "partial", 3),
    }
    assert (tmp_path / "output/k/2").read_bytes() == png(3, 4) and not (tmp_path / "output/k/7").exists()

    def broken(body, url):
        raise RuntimeError("no")

    own = (*C.HANDLERS, C.Handler("json", lambda m: m == "application/json", broken))
    row = C.processed(df.where("id = '7'"), own).first()
    assert (row.kind, row.metadata_status, row.metadata_error, row.metadata) == ("json", "failed", "no", "{}")
    old = out.where("crawl_url_id < '4'")
    assert {r.crawl_url_id for r in C.inserted(old, out).collect()} == {"4", "5", "6"}


def test_envelopes_and_service(spark):
    good = {"statusCode": 200, "headers": {"Content-Type": "text/plain"}, "body": "aGk="}
    assert fetch.envelope(json.dumps(good).encode()) == (200, good["headers"], b"aGk=")
    assert fetch.envelope(json.dumps(good | {"headers": {}}).encode()) == (200, {}, b"hi")
    assert fetch.envelope(json.dumps(good | {"body": None}).encode()) == (200, good["headers"], None)
    for bad in (good | {"statusCode": "200"}, good | {"headers": {"a": 1}}, good | {"headers": []}, good | {"body": 5}, [], None):
        assert fetch.envelope(json.dumps(bad).encode()) is None
    assert fetch.envelope(b"{") is None and fetch.envelope(json.dumps(good | {"body": "!"}).encode(), "base64") is None
    assert fetch.request_url("http://f/fetch", "http://a b/~?x=1&y") == "http://f/fetch?url=http%3A%2F%2Fa+b%2F%7E%3Fx%3D1%26y"

    def opened(address, seconds):
        if "slow" in address:
            raise TimeoutError
        if "down" in address:
            raise OSError
        return (429, b"") if "many" in address else (200, b"junk") if "junk" in address else (200, json.dumps(good).encode())

    df = spark.createDataFrame([(x, 0) for x in ("ok", "slow", "down", "many", "junk")], "url string, fetches int")
    got = {r.url: (r.status_code, r.error_kind, r.error_status) for r in fetch.HttpService("http://f", opened=opened)(df).collect()}
    assert got == {"ok": (200, None, None), "slow": (None, "timeout", None), "down": (None, "network", None), "many": (None, "transport_status", 429), "junk": (None, "invalid_envelope", None)}


def test_resume_checks():
    run = {"status": "paused", "concurrency": 2, "output_dir": "output", "max_urls": 10, "max_depth": None, "max_bytes": 5, "max_runtime_seconds": 60}
    R.check_resume(run, "x", R.Resume())
    for status, asked, error in [("completed", {}, "terminal"), ("limit_reached", {}, "greater limit"), ("limit_reached", {"max_urls": 10}, "greater limit"), ("limit_reached", {"max_depth": 3}, "greater limit"), ("running", {}, "stale"), ("paused", {"output_dir": "other"}, "mismatch"), ("paused", {"concurrency": 0}, "concurrency")]:
        with pytest.raises(R.RunError, match=error):
            R.check_resume(run | {"status": status}, "x", R.Resume(asked))
    for asked in ({"max_urls": 11}, {"max_urls": None}, {"max_bytes": 6}, {"max_runtime_seconds": 60}):
        R.check_resume(run | {"status": "limit_reached"}, "x", R.Resume(asked))
    R.check_resume(run | {"status": "running"}, "x", R.Resume({}, 1))
    with pytest.raises(R.RunError, match="not found"):
        R.check_resume(None, "x", R.Resume())


def test_store_conflicts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    df = spark.range(1)
    assert store.commit({"a": df}, 0) == 1
    with pytest.raises(Conflict):
        store.commit({"a": df}, 0)
    with pytest.raises(Conflict):
        store._publish(1, {})
    for v in range(1, 5):
        store.commit({"a": spark.range(v)}, v)
    assert store.drop_versions(2) == 3 and store.read("a").count() == 4 and store.read("a", 4).count() == 3


def test_command_line_limit_resume_and_status(spark, tmp_path, capsys):
    env = {"STORE_DIR": f"file://{tmp_path}/state", "RATE_LIMIT_DELAY_MS": "1"}
    out = []
    assert cli.main(["crawl", "--seed", A + "/", "--mock-fetch", "--max-depth", "unlimited"], env, spark, out.append) == 0
    assert "Status: completed\n" in out[0] and "  done: 1" in out[0] and "  html: 1" in out[0]
    run = out[0].split()[2]
    assert cli.main(["status", "--run-id", run, "--json"], env, spark, out.append) == 0
    got = json.loads(out[1])
    assert got["status"] == "completed" and got["urlStatusCounts"]["done"] == 1 and got["scope"] == {"host": "example.com", "policy": "registrable_domain"} and got["bytesDownloaded"] == len(cli.STUB)
    assert cli.main(["crawl", "--resume", run], env, spark, out.append) == 1
    assert cli.main(["status", "--run-id", "0" * 8 + "-0000-0000-0000-" + "0" * 12], env, spark, out.append) == 1
    for bad in (["crawl"], ["crawl", "--seed", "ftp://x"], ["crawl", "--seed", A, "--max-urls", "-1"], ["status", "--run-id", "x"], ["crawl", "--seed", A, "--resume", run]):
        with pytest.raises(SystemExit):
            cli.main(bad, env, spark, out.append)
    for table in schema.TABLES:
        assert schema.violations(Store(spark, env["STORE_DIR"]).read(table), table).count() == 0


def test_a_limit_is_raised_and_another_run_is_left_alone(spark, tmp_path):
    site = spark.createDataFrame([(A + "/", 1, 200, {"content-type": "text/html"}, '<a href="/a">x</a><a href="/b">x</a>'), (A + "/a", 1, 200, {"content-type": "text/html"}, "a"), (A + "/b", 1, 200, {"content-type": "text/html"}, "b")], G.SITE)
    folder = f"file://{tmp_path}/s"
    assert G.crawl(spark, site, A + "/", folder, max_urls=2, run_id="one").status == "limit_reached"
    store = Store(spark, folder)
    with pytest.raises(R.RunError):
        G.resume(store, "one", R.Resume(), F.lit(NOW).cast("timestamp"))
    G.resume(store, "one", R.Resume({"max_urls": None}), F.lit(NOW).cast("timestamp"))
    assert G.advance(store, "one", fetch.MockSite(site), G.Settings(now=NOW)).status == "completed"
    rows = {r.normalized_url: r.status for r in store.read("urls").collect()}
    assert rows[A + "/"] == rows[A + "/a"] == "done"
    assert store.read("contents").count() == len([x for x in rows.values() if x == "done"])


def test_configuration():
    c = config.load({})
    assert (c.max_urls, c["MAX_DEPTH"], c["RETRY_JITTER_RATIO"], c.body_strategy) == (1000, 5, 0.25, "auto")
    assert config.load({"MAX_URLS": ""}).max_urls is None and config.load({"MAX_URLS": "0"}).max_urls is None and config.load({"MAX_URLS": "7"}).max_urls == 7
    for env in ({"MAX_URLS": "-1"}, {"CONCURRENCY": "0"}, {"MAX_DEPTH": "x"}, {"FETCH_BODY_STRATEGY": "hex"}, {"RUN_STALE_AFTER_MS": "0"}):
        with pytest.raises(config.ConfigError):
            config.load(env)
    assert config.max_urls("none") is None and config.max_depth("0") == 0 and config.max_amount("1.5") == 1.5
    for parse, text in ((config.max_urls, "0.5"), (config.max_depth, "-1"), (config.max_amount, "0"), (config.at_least_one, "none")):
        with pytest.raises(config.ConfigError):
            parse(text)


def test_pacing():
    clock, slept = [100.0], []

    def sleep(s):
        slept.append(round(s, 3))
        clock[0] += s

    p = pacing.GlobalPause(150, 5_000, lambda: clock[0], sleep)
    p.limited(1_000)
    p.limited(None)
    p.limited(2_000)
    p.wait()
    assert slept == [0.15, 4.85]
    limits = pacing.Limits(10, 100, 0.0, lambda: 5.0)
    assert limits.reached(99) is None and limits.reached(100) == "bytes" and pacing.Limits(10, None, 0.0, lambda: 10.0).reached(0) == "runtime"
    assert [pacing.infra_wait_ms(k) for k in (1, 2, 7, 9)] == [500, 1_000, 30_000, 30_000]
    tries = []

    def failing():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        pacing.infra(failing, sleep)
    assert len(tries) == 5
    control = pacing.Control()
    control.guarded(failing)
    assert control.infra_failure and control.crash
    beats = []
    h = pacing.Heartbeat(lambda: beats.append(1), interval_ms=10)
    time.sleep(0.1)
    h.close()
    assert beats


def test_streams(spark, tmp_path):
    rows = [("r", "a", "ok"), ("r", "a", "ok"), ("r", "b", "error"), ("r", "c", "gone"), ("q", "a", "rate_limited")]
    spark.createDataFrame(rows, "crawl_run_id string, normalized_url string, result string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("crawl_run_id string, normalized_url string, result string").parquet(f"{tmp_path}/in")
    seen = []
    SF.driven(SF.first_seen(source), lambda df, n: seen.extend((r[0], r[1]) for r in df.collect()), f"{tmp_path}/c1").awaitTermination()
    assert sorted(seen) == [("q", "a"), ("r", "a"), ("r", "b"), ("r", "c")]
    states = []
    running = SF.driven(SF.state_changes(source), lambda df, n: states.extend(tuple(r)[:4] for r in df.collect()), f"{tmp_path}/c2", every="1 second")
    for _ in range(60):
        if len(states) >= 4:
            break
        time.sleep(1)
    running.stop()
    states = [x for x in states if x[2] != "queued"]
    assert sorted(states) == [("q", "a", "retryable_failed", 0), ("r", "a", "done", 0), ("r", "b", "retryable_failed", 1), ("r", "c", "permanent_failed", 0)]
    spark.sql("select 'r' crawl_run_id, timestamp'2026-07-03 12:00:00' + make_dt_interval(0, 0, x) beat_at from (select explode(array(0, 10, 40, 300)) x)").write.parquet(f"{tmp_path}/b")
    beats = spark.readStream.schema("crawl_run_id string, beat_at timestamp").parquet(f"{tmp_path}/b")
    ended = []
    SF.driven(SF.liveness(beats), lambda df, n: ended.extend(r.beats for r in df.collect()), f"{tmp_path}/c3").awaitTermination()
    assert sorted(ended)[-2:] == [1, 2]
