"""From responses to contents: each body is saved, hashed and read by its handler in one pass over the rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.functions import content, extract, urls, whatwg

LINK = pa.struct([("place", pa.int32()), ("source", pa.string()), ("discovered_url", pa.string()), ("key", pa.string()), ("anchor", pa.string())])
MADE = "kind string, byte_size bigint, content_hash string, metadata string, metadata_status string, metadata_error string, links array<struct<place:int,source:string,discovered_url:string,key:string,anchor:string>>"


class Extract(NamedTuple):
    metadata: dict[str, Any]
    status: str = "ok"
    error: str | None = None
    links: list[dict[str, Any]] = []


@dataclass(frozen=True)
class Handler:
    """One kind of content: which media types it reads, and what it makes of a body and its address. A further kind is one more handler."""

    kind: str
    supports: Callable[[str], bool]
    extract: Callable[[bytes, str], Extract]


def _html(body: bytes, url: str, text: Callable[[str], str] = str) -> Extract:
    page = extract.read_html(text(body.decode("utf-8", "replace")))
    links = []
    for link in page["links"]:
        found, key, _ = whatwg.discovered(link["href"], url)
        if found is not None:
            links.append({"place": link["place"], "source": link["source"], "discovered_url": found, "key": key, "anchor": link["anchor"]})
    return Extract({"title": page["title"], "discoveredLinkCount": len(links)}, links=links)


def _media(kind: str) -> Callable[[bytes, str], Extract]:
    return lambda body, url: Extract(*extract.media_facts(kind, body))


HANDLERS = (
    Handler("html", lambda m: m in content.HTML_TYPES, _html),
    Handler("image", lambda m: m in content.IMAGE_TYPES, _media("image")),
    Handler("video", lambda m: m.startswith("video/"), _media("video")),
    Handler("pdf", lambda m: m == "application/pdf", _media("pdf")),
)


#: The same, but HTML is read with closed character references only, as the SQL of the queries does.
CLOSED = (Handler("html", HANDLERS[0].supports, lambda body, url: _html(body, url, extract.closed)), *HANDLERS[1:])


def handler_of(content_type: str, handlers: tuple[Handler, ...] = HANDLERS) -> Handler | None:
    """The first handler that supports the type."""
    media = content_type.split(";")[0].strip().lower()
    return next((h for h in handlers if h.supports(media)), None)


def saved(root: str, path: str, body: bytes) -> None:
    """Writes a body at its path under a folder that all executors reach, over what is there: doing it again changes nothing."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    at = f"{base.rstrip('/')}/{path}"
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(body)


def processed(rows: DataFrame, handlers: tuple[Handler, ...] = HANDLERS, root: str | None = None) -> DataFrame:
    """rows(url, content_type, file_path, body, ...) without body and with kind, byte_size, content_hash, metadata (JSON), metadata_status,
    metadata_error and links. A type without handler and a null body give nulls; a handler's error is a failed metadata status.

    With a root, bodies are saved at file_path below it."""
    own = [c for c in rows.columns if c != "body"]
    names = [c.split(" ")[0] for c in MADE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.list_(LINK)]
        for batch in batches:
            get = lambda name, b=batch: b.column(b.schema.get_field_index(name)).to_pylist()
            out = []
            for url, kind, path, body in zip(get("url"), get("content_type"), get("file_path"), get("body"), strict=True):
                handler = None if body is None else handler_of(kind or content.UNKNOWN_TYPE, handlers)
                if handler is None:
                    out.append((None,) * 7)
                    continue
                if root is not None and path is not None:
                    saved(root, path, body)
                try:
                    got = handler.extract(body, url)
                except Exception as e:
                    got = Extract({}, "failed", str(e) or type(e).__name__)
                out.append((handler.kind, len(body), hashlib.sha256(body).hexdigest(), json.dumps(got.metadata, ensure_ascii=False, separators=(",", ":")), got.status, got.error, got.links))
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in own], *made], names=[*own, *names])

    return rows.mapInArrow(run, T.StructType([*[f for f in rows.schema.fields if f.name != "body"], *T._parse_datatype_string(MADE).fields]))


def passed_over(rows: DataFrame) -> DataFrame:
    """As processed, for runs that keep no contents: every body counts as read, with its size only."""
    out = rows.withColumns({"kind": F.lit("html"), "byte_size": F.octet_length("body").cast("long")})
    for c in MADE.split(", ")[2:]:
        name, kind = c.split(" ", 1)
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out.drop("body")


def file_path(folder: str, content_type: Column, url_hash: Column) -> Column:
    return content.output_path(folder, content_type, url_hash)


def content_rows(done: DataFrame, now: Column) -> DataFrame:
    """Rows for the table of contents from processed rows(id, crawl_run_id, content_type, file_path, etag, ...)."""
    rows = done.where("kind is not null and metadata is not null")
    return rows.select(F.sha2(F.concat(F.lit("content"), "id"), 256).alias("id"), F.col("id").alias("crawl_url_id"), "crawl_run_id", "kind", "content_type", "file_path", "byte_size", "content_hash", "etag", "metadata", "metadata_status", "metadata_error", now.alias("created_at"))


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to append: the first write for an address wins."""
    return new.join(old.select("crawl_url_id"), "crawl_url_id", "left_anti").select(old.columns)


__all__ = ["CLOSED", "HANDLERS", "Extract", "Handler", "content_rows", "file_path", "handler_of", "inserted", "passed_over", "processed", "saved", "urls"]
