"""Headers, content types, kinds, output paths and body decoding as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types, their kinds, folders and file extensions.
HTML_TYPES = ("text/html", "application/xhtml+xml")
IMAGE_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp"}
VIDEO_TYPES = {"video/mp4": ".mp4", "video/webm": ".webm", "video/quicktime": ".mov"}
FOLDERS = {"html": "html", "image": "images", "video": "videos", "pdf": "pdfs"}
KINDS = ("html", "image", "video", "pdf")
UNKNOWN_TYPE = "application/octet-stream"
LINK_RELS = ("stylesheet", "icon", "apple-touch-icon", "manifest", "preload", "modulepreload")
TEXTUAL = ("application/json", "application/xml", "application/xhtml+xml", "application/javascript", "application/ecmascript")
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def header(headers: Column, name: str) -> Column:
    """The first header of that name, whatever its case; null if there is none."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def kind(content_type: Column) -> Column:
    m = media_type(content_type)
    return F.when(m.isin(*HTML_TYPES), "html").when(m.isin(*IMAGE_TYPES), "image").when(m.startswith("video/"), "video").when(m == "application/pdf", "pdf")


def extension(content_type: Column) -> Column:
    m, k = media_type(content_type), kind(content_type)
    out = F.when(k == "html", ".html").when(k == "pdf", ".pdf")
    for name, value in {**IMAGE_TYPES, **VIDEO_TYPES}.items():
        out = out.when(m == name, value)
    return out.when(k == "image", ".img").otherwise(".bin")


def output_path(folder: str, content_type: Column, url_hash: Column) -> Column:
    k = kind(content_type)
    sub = F.when(k == "html", FOLDERS["html"])
    for name in KINDS[1:]:
        sub = sub.when(k == name, FOLDERS[name])
    return F.when(k.isNotNull(), F.concat_ws("/", F.lit(folder), sub, F.substring(url_hash, 1, 2), F.substring(url_hash, 3, 2), F.concat(url_hash, extension(content_type))))


def textual(content_type: Column) -> Column:
    m = media_type(content_type)
    return m.startswith("text/") | m.endswith("+xml") | m.isin(*TEXTUAL)


def decoded(raw: Column, content_type: Column, strategy: str) -> Column:
    """Bytes of a body string. utf8: as they are; base64: strictly, null if it is not; auto: by type, then by shape."""
    plain, strict = F.encode(raw, "UTF-8"), F.when(raw.rlike(BASE64), F.try_to_binary(raw, F.lit("base64")))
    if strategy == "utf8":
        return plain
    if strategy == "base64":
        return strict
    return F.when(F.coalesce(textual(content_type), F.lit(False)), plain).otherwise(F.when(F.trim(raw) != "", F.coalesce(strict, plain)).otherwise(plain))


def allowed_rel(rel: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(F.trim(rel)), r"\s+"), F.array(*map(F.lit, LINK_RELS))), F.lit(False))


def srcset(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.get(F.split(F.trim(x), r"\s+"), F.lit(0))), lambda x: x != "")


def length_mismatch(declared: Column, body: Column) -> Column:
    n = F.regexp_extract(declared, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.coalesce((n >= 0) & body.isNotNull() & (n != F.octet_length(body)), F.lit(False))


def format_bytes(n: Column) -> Column:
    """1024-based units with one digit; ties go up, by whole numbers."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        size = F.lit(1024**power).cast("long")
        whole, rest = F.shiftright(n, 10 * power), n % size
        tenths = whole * 10 + F.shiftright(rest * 10 + F.lit(1024**power // 2).cast("long"), 10 * power)
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" " + unit))
        out = out.when(n < 1024 ** (power + 1), text) if unit != "TB" else out.otherwise(text)
    return out
