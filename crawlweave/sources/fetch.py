"""Responses for addresses: from a table of a mock site, or from a fetch service over HTTP. Failures are columns, never exceptions.

A source takes rows with url and fetches (how often the address has been fetched) and adds status_code, headers, body, error_kind and
error_status."""

from __future__ import annotations

import base64
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import quote_plus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.functions import content
from crawlweave.runtime import dropped, written

ADDED = "status_code int, headers map<string,string>, body binary, error_kind string, error_status int"
#: What can go wrong on the way, and seconds until a request is given up.
KINDS, TIMEOUT = ("transport_status", "invalid_envelope", "timeout", "network"), 30.0


class Source(Protocol):
    def __call__(self, claimed: DataFrame) -> DataFrame: ...


class MockSite:
    """site(url, call_no, status_code, headers, body): the n-th fetch gets the n-th response, the last one repeats, an unknown address is a 404.

    The responses are written once, as every step reads them; `close` deletes them."""

    def __init__(self, site: DataFrame):
        calls = site.groupBy("url").agg(F.max("call_no").alias("calls"))
        body = F.encode("body", "UTF-8") if site.schema["body"].dataType == T.StringType() else F.col("body")
        self.site = written(site.join(calls, "url").select(F.col("url").alias("s_url"), "call_no", "calls", "status_code", "headers", body.alias("body")), "site")

    def __call__(self, claimed: DataFrame) -> DataFrame:
        got = claimed.join(self.site, (F.col("url") == F.col("s_url")) & (F.col("call_no") == F.least(F.col("fetches") + 1, F.col("calls"))), "left").drop("s_url", "call_no", "calls")
        return got.withColumns({"status_code": F.coalesce("status_code", F.lit(404)), "error_kind": F.lit(None).cast("string"), "error_status": F.lit(None).cast("int")})

    def close(self) -> None:
        dropped(self.site)


def request_url(base: str, url: str) -> str:
    """The service's address for a page: url is written as a form does."""
    return f"{base}{'&' if '?' in base else '?'}url={quote_plus(url, safe='*-._').replace('~', '%7E')}"


def request_column(base: str, url):
    return F.concat(F.lit(base + ("&" if "?" in base else "?") + "url="), F.url_encode(url))


def envelope(data: bytes, strategy: str = "auto") -> tuple[int, dict[str, str], bytes | None] | None:
    """Status, headers and body of the service's JSON; None if it is not of that form: a whole number, text headers, a body that decodes."""
    try:
        got = json.loads(data)
    except ValueError:
        return None
    if not isinstance(got, dict):
        return None
    status, headers, body = got.get("statusCode"), got.get("headers"), got.get("body")
    if isinstance(status, bool) or not isinstance(status, (int, float)) or int(status) != status:
        return None
    if not isinstance(headers, dict) or not all(isinstance(v, str) for v in headers.values()):
        return None
    if body is not None and not isinstance(body, str):
        return None
    try:
        kind = next((v for k, v in headers.items() if k.lower() == "content-type"), None)
        return int(status), headers, None if body is None else decoded(body, kind, strategy)
    except ValueError:
        return None


def decoded(body: str, content_type: str | None, strategy: str) -> bytes:
    """Bytes of a body string, as content.decoded does it; ValueError where base64 is asked for and it is none."""
    media = (content_type or "").split(";")[0].strip().lower()
    textual = media.startswith("text/") or media.endswith("+xml") or media in content.TEXTUAL
    strict = re.fullmatch(content.BASE64, body) is not None
    if strategy == "base64":
        if not strict:
            raise ValueError("not base64")
        return base64.b64decode(body)
    if strategy == "auto" and not textual and body.strip() and strict:
        return base64.b64decode(body)
    return body.encode("utf-8", "surrogatepass")


def _opened(address: str, timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(address, method="GET"), timeout=timeout) as r:  # noqa: S310  the service's address is configured
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


class HttpService:
    """A fetch service: one GET for each row, as many at a time as there are partitions. `opened` (address, seconds) -> (status, bytes) can be given."""

    def __init__(self, base: str, strategy: str = "auto", timeout: float = TIMEOUT, concurrency: int = 5, opened: Callable[[str, float], tuple[int, bytes]] = _opened):
        self.base, self.strategy, self.timeout, self.concurrency, self.opened = base, strategy, timeout, concurrency, opened

    def fetch(self, url: str) -> tuple:
        """status, headers, body, kind of failure, the transport's status."""
        try:
            status, data = self.opened(request_url(self.base, url), self.timeout)
        except TimeoutError:
            return None, None, None, "timeout", None
        except Exception as e:
            return None, None, None, "timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else "network", None
        if not 200 <= status < 300:
            return None, None, None, "transport_status", status
        got = envelope(data, self.strategy)
        return (*got, None, None) if got else (None, None, None, "invalid_envelope", None)

    def __call__(self, claimed: DataFrame) -> DataFrame:
        at = claimed.columns.index("url")
        kinds = [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int32()]
        names = [c.split(" ")[0] for c in ADDED.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [self.fetch(u) for u in batch.column(at).to_pylist()]
                made = [pa.array([list(r[k].items()) if k == 1 and r[k] is not None else r[k] for r in rows], kinds[k]) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

        schema = T.StructType([*claimed.schema.fields, *T._parse_datatype_string(ADDED).fields])
        return claimed.repartition(self.concurrency).mapInArrow(run, schema)
