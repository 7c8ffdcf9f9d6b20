"""Queries over the driver's tables, one per operator of crawl state and content, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions import content, extract, http, urls
from crawlweave.operators import edges as E
from crawlweave.operators import frontier as Q
from crawlweave.runtime import ship, table

NOW = "2026-07-03 12:00:00"
CODES = (200, 200, 200, 200, 200, 404, 403, 429, 500, 302, 502)
TYPES = ("text/html; charset=utf-8", "text/html", "application/xhtml+xml", "image/png", "video/mp4", "application/pdf", "application/json")
SCOPE = "example.com"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _norm(u: str) -> str:
    path = f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    coded = f"rtrim(replace(replace(url_encode({path}), '%2F', '/'), '%2C', ','), '/')"
    query = f"regexp_extract({u}, '\\?([^#]*)', 1)"
    return f"('https://' || lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)) || CASE WHEN {coded} = '' THEN '/' ELSE {coded} END || CASE WHEN {query} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({query}, '&')), '&') END)"


# Pages as fetched: the same derived columns in both languages.
P = f"""p AS (SELECT page_id, url, html, {_norm("url")} AS key, CAST({_list(CODES)}[page_id % 11 + 1] AS INTEGER) AS status_code, {_list(TYPES)}[page_id % 7 + 1] AS content_type,
CAST(page_id % 6 AS INTEGER) AS attempt_count, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '10' ELSE 'Fri, 03 Jul 2026 12:00:10 GMT' END AS retry_after FROM pages)"""
# Links and edges.
L = f"""l0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) - 1 AS place FROM pages),
l AS (SELECT page_id, place, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || replace(href, '&amp;', '&') AS raw FROM l0),
e AS (SELECT l.page_id, place, {_norm("l.raw")} AS target FROM l)"""
_DOMAIN = "array_to_string(list_slice(string_split(regexp_extract({0}, '^https://([^/?#]*)', 1), '.'), -2, -1), '.')"
_STATUS = _list(Q.STATUSES)
U = f"""u AS (SELECT page_id AS seq, {_norm("url")} AS key, {_STATUS}[page_id % 8 + 1] AS status, CAST(page_id % 6 AS INTEGER) AS attempt_count,
TIMESTAMP '{NOW}' + to_minutes(page_id % 5 - 2) AS next_attempt_at, TIMESTAMP '{NOW}' - to_minutes(page_id % 40) AS claimed_at FROM pages)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    p = table(spark, sf_dir, "pages")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    return p.withColumns({"key": urls.normalized(F.col("url")), "status_code": pick(CODES, 11), "content_type": pick(TYPES, 7), "attempt_count": (F.col("page_id") % 6).cast("int"), "retry_after": F.when(F.col("page_id") % 3 == 1, "10").when(F.col("page_id") % 3 == 2, "Fri, 03 Jul 2026 12:00:10 GMT")})


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    now = F.lit(NOW).cast("timestamp_ntz")
    minutes = lambda x: F.make_dt_interval(F.lit(0), F.lit(0), x.cast("int"))
    return p.select(F.col("page_id").alias("seq"), urls.normalized(F.col("url")).alias("key"), F.element_at(F.array(*map(F.lit, Q.STATUSES)), (F.col("page_id") % 8 + 1).cast("int")).alias("status"), (F.col("page_id") % 6).cast("int").alias("attempt_count"), (now + minutes(F.col("page_id") % 5 - 2)).alias("next_attempt_at"), (now - minutes(F.col("page_id") % 40)).alias("claimed_at"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return E.links(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query(f"WITH {P}, {L} SELECT d.domain, CAST(d.pages AS BIGINT) AS pages, CAST(x.occurrences AS BIGINT) AS occurrences, CAST(x.edges AS BIGINT) AS edges, CAST(x.targets AS BIGINT) AS targets FROM (SELECT {_DOMAIN.format('key')} AS domain, count(*) AS pages FROM p GROUP BY 1) d JOIN (SELECT {_DOMAIN.format('p.key')} AS domain, count(*) AS occurrences, count(DISTINCT p.key || ' ' || target) AS edges, count(DISTINCT target) AS targets FROM e JOIN p USING (page_id) GROUP BY 1) x USING (domain)")
def site_graph_report(spark, sf_dir):
    """Pages, link occurrences, distinct edges and targets of each registrable domain.

    Edges are made distinct by hashes of their ends once; targets and edges are then counted from that."""
    p = pages(spark, sf_dir).select("page_id", "key").withColumn("domain", urls.registrable(urls.host(F.col("key"))))
    e = edges(spark, sf_dir).select("page_id", F.sha2("normalized_discovered_url", 256).alias("target")).join(p, "page_id")
    once = e.groupBy("domain", "target", F.sha2("key", 256).alias("source")).agg(F.count("*").alias("n"))
    each = once.groupBy("domain", "target").agg(F.sum("n").alias("n"), F.count("*").alias("edges"))
    x = each.groupBy("domain").agg(F.sum("n").alias("occurrences"), F.sum("edges").alias("edges"), F.count("*").alias("targets"))
    return p.groupBy("domain").agg(F.count("*").alias("pages")).join(x, "domain", "left").fillna(0, ["occurrences", "edges", "targets"])


@query(f"WITH {P} SELECT page_id, key AS normalized_url, sha256(key) AS url_hash, regexp_extract(key, '^https://([^/?#]*)', 1) AS host FROM p")
def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.col("key").alias("normalized_url"), urls.url_hash(F.col("key")).alias("url_hash"), urls.host(F.col("key")).alias("host"))


@query(f"WITH {P} SELECT page_id, {_DOMAIN.format('key')} AS registrable, {_DOMAIN.format('key')} = '{SCOPE}' AS in_scope, regexp_extract(key, '^https://([^/?#]*)', 1) = '{SCOPE}' AS in_exact_scope FROM p")
def scope_filter(spark, sf_dir):
    k = F.col("key")
    return pages(spark, sf_dir).select("page_id", urls.registrable(urls.host(k)).alias("registrable"), urls.in_scope(k, "registrable_domain", SCOPE).alias("in_scope"), urls.in_scope(k, "exact_host", SCOPE).alias("in_exact_scope"))


@query(f"WITH {P} SELECT key AS normalized_url, min(page_id) AS page_id, count(*) AS seen FROM p GROUP BY 1")
def frontier_dedup(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(F.col("key").alias("normalized_url")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("seen"))


@query(f"WITH {L} SELECT page_id, CAST(place AS BIGINT) AS place, 'a.href' AS source, target AS normalized_url FROM e")
def link_extract(spark, sf_dir):
    return edges(spark, sf_dir).select("page_id", F.col("place").cast("long").alias("place"), "source", F.col("normalized_discovered_url").alias("normalized_url"))


@query(f"WITH {L} SELECT pages.page_id, count(e.page_id) AS n_links FROM pages LEFT JOIN e ON e.page_id = pages.page_id GROUP BY 1")
def link_count(spark, sf_dir):
    """0 for a page without links."""
    found = edges(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"))


@query("SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')) AS title FROM pages")
def title_extract(spark, sf_dir):
    """As the SQL has it, a character reference without a semicolon stays as it is; crawls read it as HTML does."""
    ship(spark)
    return table(spark, sf_dir, "pages").select("page_id", extract.closed_title("html").alias("title"))


@query(r'''WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS tags FROM pages),
b AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS place FROM a),
t AS (SELECT page_id, place, trim(regexp_replace(regexp_replace(regexp_extract(tag, '(?s)^<a[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, CAST(place AS BIGINT) AS place, nullif(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '') AS anchor FROM t''')
def anchor_text(spark, sf_dir):
    return edges(spark, sf_dir).select("page_id", F.col("place").cast("long").alias("place"), "anchor")


@query(f"WITH {P}, {L} SELECT p.key AS from_key, e.target AS to_key, CAST(count(*) AS BIGINT) AS n FROM e JOIN p USING (page_id) GROUP BY 1, 2")
def edges_build(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", F.col("key").alias("from_key"))
    return edges(spark, sf_dir).join(p, "page_id").groupBy("from_key", F.col("normalized_discovered_url").alias("to_key")).agg(F.count("*").alias("n"))


@query(f"WITH {P}, {L} SELECT target, CAST(count(DISTINCT p.key) AS BIGINT) AS in_degree, CAST(count(*) AS BIGINT) AS occurrences FROM e JOIN p USING (page_id) GROUP BY 1")
def edges_in_degree(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "key")
    return edges(spark, sf_dir).join(p, "page_id").groupBy(F.col("normalized_discovered_url").alias("target")).agg(F.countDistinct("key").alias("in_degree"), F.count("*").alias("occurrences"))


@query(f"WITH {L}, r AS (SELECT page_id, target, place, row_number() OVER (PARTITION BY page_id, target ORDER BY (place % 2 = 0) DESC, place) AS rn FROM e) SELECT page_id, target, CAST(place AS BIGINT) AS place FROM r WHERE rn = 1")
def edges_rank_dedup(spark, sf_dir):
    e = edges(spark, sf_dir).select("page_id", F.col("normalized_discovered_url").alias("target"), F.col("place").cast("long").alias("place"))
    e = e.withColumn("to_url_id", F.when(F.col("place") % 2 == 0, F.col("target")))
    return E.best_of_duplicates(e, ["page_id", "target"], "to_url_id", "place").select("page_id", "target", "place")


@query(f"WITH {L}, s AS (SELECT page_id, place, {_DOMAIN.format('target')} = '{SCOPE}' AS in_scope, page_id % 4 AS depth, place % 3 = 0 AS known, place % 2 = 0 AS room FROM e) SELECT page_id, CAST(place AS BIGINT) AS place, in_scope, CASE WHEN NOT in_scope THEN 'scope' WHEN depth > 2 THEN 'depth' WHEN NOT known AND NOT room THEN 'limit' END AS skip_reason FROM s")
def edges_skip_reason(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("in_scope", urls.in_scope(F.col("normalized_discovered_url"), "registrable_domain", SCOPE))
    reason = E.decided(F.col("in_scope"), F.col("page_id") % 4, 2, F.col("place") % 3 == 0, F.col("place") % 2 == 0)
    return e.select("page_id", F.col("place").cast("long").alias("place"), "in_scope", reason.alias("skip_reason"))


@query(f"""WITH {L}, n AS (SELECT page_id, target, place, k, CASE WHEN (place + k) % 2 = 0 THEN target END AS t, (place + k) % 5 <> 0 AS in_scope, CASE WHEN (place + k) % 3 = 0 THEN 'limit' END AS skip
      FROM e, (SELECT unnest([0, 1]) AS k) WHERE k = 1 OR place % 2 = 0),
f AS (SELECT page_id, target, k, max(CASE WHEN t IS NOT NULL THEN t END) AS to_url_id, arg_max(in_scope, place) AS in_scope, arg_max_null(skip, place) AS skip_reason, min(place) AS place FROM n GROUP BY 1, 2, 3),
o AS (SELECT * FROM f WHERE k = 0), w AS (SELECT * FROM f WHERE k = 1 AND place % 3 <> 2)
SELECT page_id, target, coalesce(w.to_url_id, o.to_url_id) AS to_url_id, CASE WHEN w.k IS NULL THEN o.in_scope ELSE w.in_scope END AS in_scope,
CASE WHEN w.k IS NULL THEN o.skip_reason ELSE w.skip_reason END AS skip_reason, CAST(coalesce(o.place, w.place + 1000) AS BIGINT) AS place FROM o FULL JOIN w USING (page_id, target)""")
def edges_upsert(spark, sf_dir):
    """Even links as the table before; all links, but those first seen at every third place, as observed again with other targets, flags and reasons."""

    def seen(k: int) -> DataFrame:
        p = F.col("place") + k
        e = edges(spark, sf_dir).select(F.lit("run").alias("crawl_run_id"), F.col("page_id").cast("string").alias("from_url_id"), "normalized_discovered_url", "source", F.when(p % 2 == 0, F.col("normalized_discovered_url")).alias("to_url_id"), (p % 5 != 0).alias("in_scope"), F.when(p % 3 == 0, "limit").alias("skip_reason"), "discovered_url", (F.col("place") + 1000 * k).cast("long").alias("ord"))
        return e.where("ord % 2 = 0") if k == 0 else e

    new = E.folded(seen(1), "ord").where("(ord - 1000) % 3 <> 2")
    out = E.merged(E.folded(seen(0), "ord"), new, "ord")
    return out.select(F.col("from_url_id").cast("long").alias("page_id"), F.col("normalized_discovered_url").alias("target"), "to_url_id", "in_scope", "skip_reason", F.col("ord").alias("place"))


@query(f"WITH {P}, d AS (SELECT key, min(page_id) AS seq FROM p GROUP BY key) SELECT key, seq FROM d ORDER BY seq LIMIT 20")
def admit_cap(spark, sf_dir):
    return E.admitted(pages(spark, sf_dir).select("key", F.col("page_id").alias("seq")), "key", "seq", 20)


_ACTION = "CASE WHEN status_code IN (301, 302, 303, 307, 308) THEN 'redirect' WHEN status_code = 200 THEN CASE WHEN page_id % 13 = 0 THEN 'empty_body' ELSE 'success_with_body' END WHEN status_code = 404 THEN 'not_found' WHEN status_code = 403 THEN 'blocked' WHEN status_code = 429 THEN 'rate_limited' WHEN status_code = 500 THEN 'server_error' ELSE 'unexpected' END"


@query(f"WITH {P} SELECT page_id, status_code, {_ACTION} AS action FROM p")
def classify_response(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "status_code", http.action(F.col("status_code"), F.col("page_id") % 13 != 0).alias("action"))


@query("SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'processing_bug' WHEN 'click' THEN 'db_transient' WHEN 'view' THEN 'db_constraint' WHEN 'signup' THEN 'storage_error' ELSE 'processing_error' END AS type, event_type NOT IN ('error', 'view') AS retryable FROM events")
def classify_error(spark, sf_dir):
    t = F.col("event_type")
    c = http.error_class(F.when(t == "error", "TypeError").otherwise("Error"), F.when(t == "click", "57P01").when(t == "view", "23505").when(t == "signup", "ENOSPC").otherwise("ECONNRESET"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", c["type"].alias("type"), c["retryable"].alias("retryable"))


_AFTER = "CASE WHEN retry_after IS NULL THEN NULL ELSE 10000 END"


@query(f"WITH {P} SELECT page_id, CAST({_AFTER} AS BIGINT) AS retry_after_ms FROM p")
def retry_after(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", http.retry_after_ms(F.col("retry_after"), F.lit(NOW + " UTC").cast("timestamp")).alias("retry_after_ms"))


@query("SELECT event_id, CAST(least(5000 * power(2, event_id % 9), 300000) AS BIGINT) AS delay_ms FROM events")
def backoff_delay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", http.backoff_ms(F.col("event_id") % 9).alias("delay_ms"))


@query(f"WITH {P}, a AS (SELECT *, {_ACTION} AS action FROM p) SELECT page_id, NOT (action <> 'rate_limited' AND attempt_count + 1 >= 5) AS retry, CASE WHEN action = 'rate_limited' THEN CAST(coalesce({_AFTER}, 5000) AS BIGINT) WHEN attempt_count + 1 < 5 THEN CAST(least(5000 * power(2, attempt_count), 300000) AS BIGINT) END AS delay_ms, action <> 'rate_limited' AS consumes FROM a")
def retry_decide(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("action", http.action(F.col("status_code"), F.col("page_id") % 13 != 0))
    return p.select("page_id", http.retry(F.col("action"), F.col("attempt_count"), F.lit(5), http.retry_after_ms(F.col("retry_after"), F.lit(NOW + " UTC").cast("timestamp"))).alias("r")).select("page_id", "r.*")


@query(f"WITH {P} SELECT CAST(max(coalesce({_AFTER}, 5000)) AS BIGINT) AS pause_ms, CAST(count(*) AS BIGINT) AS n FROM p WHERE status_code = 429")
def rate_limit_pause(spark, sf_dir):
    after = http.retry_after_ms(F.col("retry_after"), F.lit(NOW + " UTC").cast("timestamp"))
    return pages(spark, sf_dir).where("status_code = 429").agg(F.max(F.coalesce(after, F.lit(5000).cast("long"))).alias("pause_ms"), F.count("*").alias("n"))


_MEDIA = "lower(trim(split_part(content_type, ';', 1)))"
_KIND = f"CASE WHEN {_MEDIA} IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN {_MEDIA} = 'image/png' THEN 'image' WHEN starts_with({_MEDIA}, 'video/') THEN 'video' WHEN {_MEDIA} = 'application/pdf' THEN 'pdf' END"


@query(f"WITH {P}, k AS (SELECT *, {_MEDIA} AS media, {_KIND} AS kind, sha256(key) AS h FROM p) SELECT page_id, media, kind, CASE kind WHEN 'html' THEN '.html' WHEN 'image' THEN '.png' WHEN 'video' THEN '.mp4' WHEN 'pdf' THEN '.pdf' ELSE '.bin' END AS extension, CASE WHEN kind IS NOT NULL THEN 'output/' || CASE kind WHEN 'html' THEN 'html' ELSE kind || 's' END || '/' || h[1:2] || '/' || h[3:4] || '/' || h || CASE kind WHEN 'html' THEN '.html' WHEN 'image' THEN '.png' WHEN 'video' THEN '.mp4' ELSE '.pdf' END END AS file_path FROM k")
def content_dispatch(spark, sf_dir):
    c = F.col("content_type")
    return pages(spark, sf_dir).select("page_id", content.media_type(c).alias("media"), content.kind(c).alias("kind"), content.extension(c).alias("extension"), content.output_path("output", c, urls.url_hash(F.col("key"))).alias("file_path"))


@query(f"WITH {P} SELECT page_id, content_type AS found FROM p")
def header_lookup(spark, sf_dir):
    headers = F.create_map(F.lit("X-Other"), F.lit("1"), F.lit("CONTENT-Type"), F.col("content_type"))
    return pages(spark, sf_dir).select("page_id", content.header(headers, "content-type").alias("found"))


@query("SELECT page_id, sha256(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS byte_size, page_id % 3 = 1 AS length_mismatch FROM pages")
def content_hash(spark, sf_dir):
    size = F.octet_length("html").cast("long")
    body = F.encode("html", "UTF-8")
    declared = F.when(F.col("page_id") % 3 == 0, size.cast("string")).when(F.col("page_id") % 3 == 1, (size + 1).cast("string")).otherwise("unknown")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(body, 256).alias("content_hash"), size.alias("byte_size"), content.length_mismatch(declared, body).alias("length_mismatch"))


@query("SELECT doc_id, sha256(text) AS utf8_hash, sha256(text) AS base64_hash, sha256(text) AS auto_hash, doc_id % 2 = 0 AS strict_ok FROM documents")
def body_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.base64(F.encode("text", "UTF-8")).alias("b"))
    d = d.withColumn("b", F.regexp_replace("b", r"\s", ""))
    broken = F.when(F.col("doc_id") % 2 == 0, F.col("b")).otherwise(F.concat("b", F.lit("!")))
    h = lambda x: F.sha2(x, 256)
    none = F.lit(None).cast("string")
    return d.select("doc_id", h(content.decoded(F.col("text"), none, "utf8")).alias("utf8_hash"), h(content.decoded(F.col("b"), none, "base64")).alias("base64_hash"), h(content.decoded(F.col("b"), F.lit("application/octet-stream"), "auto")).alias("auto_hash"), content.decoded(broken, none, "base64").isNotNull().alias("strict_ok"))


@query(f"WITH {U}, s AS (SELECT unnest({_STATUS}) AS status, unnest(range(8)) AS place) SELECT s.status, CAST(s.place AS INTEGER) AS place, CAST(count(u.key) AS BIGINT) AS n FROM s LEFT JOIN u ON u.status = s.status GROUP BY 1, 2")
def status_counts(spark, sf_dir):
    return Q.zero_filled(frontier(spark, sf_dir), "status", Q.STATUSES).select("status", F.col("place").cast("int").alias("place"), "n")


@query(f"WITH {P}, k AS (SELECT {_KIND} AS kind FROM p), s AS (SELECT unnest(['html', 'image', 'video', 'pdf']) AS kind) SELECT s.kind, CAST(count(k.kind) AS BIGINT) AS n FROM s LEFT JOIN k ON k.kind = s.kind GROUP BY 1")
def content_kind_counts(spark, sf_dir):
    return Q.zero_filled(pages(spark, sf_dir).select(content.kind(F.col("content_type")).alias("kind")), "kind", content.KINDS).select("kind", "n")


@query(f"WITH {U} SELECT CAST(count(*) FILTER (status = 'in_progress') AS BIGINT) AS in_progress, CAST(count(*) FILTER (status = 'retryable_failed' AND next_attempt_at > TIMESTAMP '{NOW}') AS BIGINT) AS future_retryable, CAST(count(*) FILTER (status = 'queued') AS BIGINT) AS queued FROM u")
def termination_counts(spark, sf_dir):
    return Q.termination(frontier(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@query(f"WITH {U} SELECT seq, key FROM u WHERE status IN ('queued', 'retryable_failed') AND next_attempt_at <= TIMESTAMP '{NOW}' ORDER BY seq LIMIT 25")
def claim_batch(spark, sf_dir):
    return Q.claim(frontier(spark, sf_dir), 25, F.lit(NOW).cast("timestamp_ntz")).select("seq", "key")


@query(f"WITH {U} SELECT seq, CASE WHEN status = 'in_progress' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN 'queued' ELSE status END AS status, CASE WHEN status = 'in_progress' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN NULL ELSE claimed_at END AS claimed_at FROM u")
def recover_stale(spark, sf_dir):
    return Q.recovered(frontier(spark, sf_dir), F.expr(f"timestamp_ntz'{NOW}' - interval 15 minutes")).select("seq", "status", "claimed_at")


@query(f"WITH {U} SELECT CASE WHEN count(*) FILTER (status IN ('permanent_failed', 'blocked')) > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM u")
def finalize_status(spark, sf_dir):
    return frontier(spark, sf_dir).agg(F.count_if(F.col("status").isin("permanent_failed", "blocked")).alias("n")).select(Q.final_status(F.col("n")).alias("status"))


def _sized(unit: int) -> str:
    """One digit, ties up: tenths of the unit by whole numbers."""
    return f"CAST((n * 10 + {unit} // 2) // {unit} // 10 AS VARCHAR) || '.' || CAST((n * 10 + {unit} // 2) // {unit} % 10 AS VARCHAR)"


@query(f"SELECT page_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN {_sized(1024)} || ' KB' ELSE {_sized(1024**2)} || ' MB' END AS text FROM (SELECT page_id, strlen(html) AS n FROM pages)")
def format_bytes(spark, sf_dir):
    """The size of every page; a tie of the one digit goes up."""
    return table(spark, sf_dir, "pages").select("page_id", content.format_bytes(F.octet_length("html").cast("long")).alias("text"))


@query(f"""WITH s AS (SELECT page_id, power, CAST(strlen(html) AS HUGEINT) * CAST(pow(1000, power) AS HUGEINT) AS n FROM pages, (SELECT unnest(range(5)) AS power))
SELECT page_id, CAST(power AS BIGINT) AS power, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN {_sized(1024)} || ' KB' WHEN n < 1073741824 THEN {_sized(1024**2)} || ' MB' WHEN n < 1099511627776 THEN {_sized(1024**3)} || ' GB' ELSE {_sized(1024**4)} || ' TB' END AS text FROM s""")
def format_bytes_units(spark, sf_dir):
    """The size of every page, and a thousand times as much up to four times over, so that all units occur. A tie of the one digit goes up."""
    n = F.octet_length("html").cast("long") * F.pow(F.lit(1000.0), F.col("power")).cast("long")
    return table(spark, sf_dir, "pages").withColumn("power", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select("page_id", "power", content.format_bytes(n).alias("text"))


@query(f"WITH {P}, c AS (SELECT page_id, {_KIND} AS kind, strlen(html) AS n FROM p WHERE status_code = 200) SELECT kind, CAST(count(*) AS BIGINT) AS contents, CAST(sum(n) AS BIGINT) AS bytes FROM c WHERE kind IS NOT NULL GROUP BY kind")
def contents_join_urls(spark, sf_dir):
    u = pages(spark, sf_dir).where("status_code = 200").select("page_id", "content_type")
    c = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("n"))
    return c.join(u, "page_id").select(content.kind(F.col("content_type")).alias("kind"), "n").where("kind is not null").groupBy("kind").agg(F.count("*").alias("contents"), F.sum("n").alias("bytes"))


@query(f"WITH {P} SELECT page_id, key FROM p WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def contents_insert_ignore(spark, sf_dir):
    new = pages(spark, sf_dir).select("page_id", "key")
    return new.join(table(spark, sf_dir, "pages").where("page_id % 3 = 0").select("page_id"), "page_id", "left_anti")


@query(f"WITH {P} SELECT {_DOMAIN.format('key')} AS crawl_run_id, CAST(count(*) AS BIGINT) AS urls_enqueued, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes FROM p GROUP BY 1")
def run_counters(spark, sf_dir):
    p = pages(spark, sf_dir).select(urls.registrable(urls.host(F.col("key"))).alias("crawl_run_id"), F.octet_length("html").cast("long").alias("n"))
    return p.groupBy("crawl_run_id").agg(F.count("*").alias("urls_enqueued"), F.sum("n").alias("total_bytes"))


@query(f"WITH {P} SELECT page_id, key FROM p WHERE {_DOMAIN.format('key')} NOT IN ('{SCOPE}')")
def run_cascade_delete(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "key", urls.registrable(urls.host(F.col("key"))).alias("run"))
    gone = spark.createDataFrame([(SCOPE,)], "run string")
    return p.join(F.broadcast(gone), "run", "left_anti").select("page_id", "key")
