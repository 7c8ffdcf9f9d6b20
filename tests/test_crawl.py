"""The superstep loop over a mock site, against the expected states of the scenarios in FIXTURES.md."""

from pyspark.sql import functions as F

from crawlweave.operators import runs as R
from crawlweave.plans import crawl as C
from crawlweave.sources.fetch import MockSite
from crawlweave.sources.store import Store

A = "https://example.com"
HTML = {"content-type": "text/html; charset=utf-8"}


def crawled(spark, tmp_path, rows, **more):
    site = spark.createDataFrame(rows, C.SITE)
    folder = f"file://{tmp_path}/store"
    out = C.crawl(spark, site, A + "/", folder, **more)
    store = Store(spark, folder)
    rows = store.read("urls").collect()
    return out, {r["normalized_url"].removeprefix(A): r for r in rows}, store.read("edges").collect(), len(rows)


def test_outcomes(spark, tmp_path):
    links = "".join(f'<a href="{p}">x</a>' for p in ("/missing", "/blocked", "/flaky", "/throttled", "/slash", "/nowhere", "/away", "/chain", "/data", "https://other.org/", "/missing#again"))
    rows = [
        (A + "/", 1, 200, HTML, links),
        (A + "/blocked", 1, 403, {}, ""),
        (A + "/flaky", 1, 500, {}, ""), (A + "/flaky", 2, 500, {}, ""), (A + "/flaky", 3, 200, HTML, "x"),
        (A + "/throttled", 1, 429, {"retry-after": "1"}, ""), (A + "/throttled", 2, 200, HTML, "x"),
        (A + "/slash", 1, 301, {"location": "/slash/"}, ""), (A + "/slash/", 1, 200, HTML, "x"), (A + "/slash/", 2, 200, HTML, "x"),
        (A + "/nowhere", 1, 302, {}, ""),
        (A + "/away", 1, 301, {"location": "https://other.net/"}, ""),
        (A + "/chain", 1, 302, {"location": "/chain2"}, ""), (A + "/chain2", 1, 307, {"location": "/chain3"}, ""), (A + "/chain3", 1, 200, HTML, "x"),
        (A + "/data", 1, 200, {"content-type": "application/json"}, "{}"),
    ]
    out, by, edges, n = crawled(spark, tmp_path, rows)
    assert out.status == "completed_with_failures"
    assert n == len(by) == 12
    assert {k: r["status"] for k, r in by.items()} == {
        "/": "done", "/missing": "permanent_failed", "/blocked": "blocked", "/flaky": "done", "/throttled": "done", "/slash": "done", "/nowhere": "permanent_failed",
        "/away": "redirected", "/chain": "redirected", "/chain2": "redirected", "/chain3": "done", "/data": "skipped_unsupported",
    }
    assert (by["/flaky"]["attempt_count"], by["/throttled"]["attempt_count"]) == (2, 0)
    assert (by["/slash"]["url"], by["/slash"]["redirect_count"], by["/chain3"]["redirect_count"]) == (A + "/slash/", 1, 2)
    assert by["/nowhere"]["last_error_type"] == "redirect_missing_location"
    skipped = {e["normalized_discovered_url"]: (e["skip_reason"], e["to_url_id"]) for e in edges if e["skip_reason"]}
    assert skipped == {"https://other.org/": ("scope", None), "https://other.net/": ("scope", None)}
    assert len([e for e in edges if e["normalized_discovered_url"] == A + "/missing"]) == 1


def test_limit_and_missing_seed(spark, tmp_path):
    out, by, edges, n = crawled(spark, tmp_path / "cap", [(A + "/", 1, 200, HTML, '<a href="/a">x</a><a href="/">x</a>')], max_urls=1)
    assert (out.status, n) == ("limit_reached", 1)
    assert {e["normalized_discovered_url"]: e["skip_reason"] for e in edges} == {A + "/a": "limit", A + "/": None}
    out, by, edges, n = crawled(spark, tmp_path / "gone", [("https://example.com/x", 1, 200, HTML, "x")])
    assert (out.status, n, by["/"]["status"], edges) == ("completed_with_failures", 1, "permanent_failed", [])


def test_ready_addresses_are_taken_at_once(spark, tmp_path):
    """Supersteps follow the site's depth, not the number of addresses, and give what batches of two give, which a limit on addresses needs."""
    page = lambda *to: "".join(f'<a href="{p}">x</a>' for p in to)
    rows = [(A + "/", 1, 200, HTML, page("/1", "/2", "/3", "/4", "/5")), *[(f"{A}/{k}", 1, 200, HTML, page(f"/{k % 5 + 1}", "/6", f"/{k + 1}0")) for k in range(1, 6)], (A + "/6", 1, 302, {"location": "/60"}, ""), (A + "/60", 1, 200, HTML, page("/"))]
    got = []
    for name, more in (("whole", {}), ("batches", {"max_urls": 100})):
        out, by, edges, n = crawled(spark, tmp_path / name, rows, batch=2, **more)
        got.append(([(r["normalized_url"], r["seq"], r["depth"], r["redirect_count"], r["status"], r["discovered_from_url_id"]) for r in sorted(by.values(), key=lambda r: r["seq"])], sorted((e["from_url_id"], e["normalized_discovered_url"], e["source"], e["to_url_id"], e["discovered_url"]) for e in edges), out.status))
        assert (n, out.steps) == (12, 3 if name == "whole" else 7)
    assert got[0] == got[1]


def test_written_tables_are_read_without_a_job(spark, tmp_path):
    store, sc = Store(spark, f"file://{tmp_path}/s"), spark.sparkContext
    store.commit({"a": spark.range(3), "b": spark.range(2)}, 0)
    sc.setJobGroup("reads", "")
    a, b = store.read("a"), store.read("b")
    assert not sc.statusTracker().getJobIdsForGroup("reads")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert (a.count(), b.count(), Store(spark, store.folder).read("a").count()) == (3, 2, 3)


def test_a_resumed_run_takes_the_rest_at_once_from_the_same_source(spark, tmp_path):
    rows = [(A + "/", 1, 200, HTML, "".join(f'<a href="/{k}">x</a>' for k in range(7))), *[(f"{A}/{k}", 1, 200, HTML, "x") for k in range(7)]]
    store, source, now = Store(spark, f"file://{tmp_path}/s"), MockSite(spark.createDataFrame(rows, C.SITE)), "2026-07-03 12:00:00"
    first = C.crawl(spark, source, A + "/", store.folder, batch=2, max_steps=2)
    assert (first.status, first.steps, store.read("urls").where("status = 'done'").count()) == ("paused", 2, 3)
    C.resume(store, first.run_id, R.Resume(), F.lit(now).cast("timestamp"))
    second = C.advance(store, first.run_id, source, C.Settings(now=now, batch=2))
    source.close()
    assert (second.status, second.steps, second.counts["done"]) == ("completed", 1, 8)
