"""URL canonicalisation, hashing and scope as Catalyst expressions.

Parts are bound once (`let`), so an expression does not repeat how its parts were made. The expressions cover addresses with plain
ASCII hosts; `normalized_any` gives the others to the Python parser and is null where that rejects them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.functions import suffixes, whatwg
from crawlweave.functions.suffixes import let, registrable

__all__ = ["discovered", "encoded_path", "folded", "host", "in_scope", "let", "normalized", "normalized_any", "registrable", "resolved", "resolved_any", "scope_of", "scheme", "sorted_query", "supported", "url_hash"]

ABSOLUTE = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Addresses whose host, port and path need no more than these expressions do.
PLAIN = r"(?i)^https?://[a-z0-9_\-]+(?:\.[a-z0-9_\-]+)*\.?(?::[1-9]\d{0,3})?(?:[/?#](?![^?#]*(?:\\|%2e))[^\x00-\x1f]*)?$"
_NUMBER = r"(?i)^https?://(?:[^/?#]*\.)?(?:\d+|0x[0-9a-f]*)\.?(?::|[/?#]|$)"
_SAFE_PATH = r"^[!$%&'()*+,\-./0-9:;=@A-Z\[\\\]_a-z|~^]*$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ABSOLUTE, 1))


def supported(url: Column) -> Column:
    """Absolute, http or https, with a host."""
    return url.rlike(r"(?i)^\s*https?://[^/?#\s\\]+(?:[/?#\\]|$)")


def _authority(url: Column, key: bool = False) -> Column:
    """User, host in lower case and port, without the scheme's own port; a key is read as https, which loses 443 too."""
    raw = F.regexp_extract(url, ABSOLUTE, 2)

    def of(x: Column) -> Column:
        user, rest = F.regexp_extract(x, r"^(.*@)", 1), F.lower(F.regexp_replace(x, r"^.*@", ""))
        rest = F.regexp_replace(rest, r":0*(\d*)$", ":$1")
        own = F.when(scheme(url) == "http", F.regexp_replace(rest, ":80$", "")).otherwise(F.regexp_replace(rest, ":443$", ""))
        own = F.regexp_replace(own, ":443$", "") if key else own
        return F.concat(user, F.regexp_replace(own, ":$", ""))

    return let(raw, of)


def encoded_path(path: Column) -> Column:
    """Characters outside the URL path set as percent-escapes of their UTF-8 bytes."""
    escape = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    each = F.transform(F.split(path, ""), lambda c: F.when(c.rlike(_SAFE_PATH), c).otherwise(escape(c)))
    return F.when(path.rlike(_SAFE_PATH), path).otherwise(F.array_join(each, ""))


def folded(path: Column) -> Column:
    """Dot segments removed."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    step = lambda a, s: F.when(s == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    out = F.when(last.isin(".", ".."), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))).otherwise(path)


def sorted_query(query: Column) -> Column:
    """Parameters decoded, sorted by key and then value in collation order, written as a form; '' if there are none."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    ranked = F.transform(pairs, lambda x: F.struct(F.collate(x["k"], "UNICODE").alias("ck"), F.collate(x["v"], "UNICODE").alias("cv"), x["k"].alias("k"), x["v"].alias("v")))
    text = F.array_join(F.transform(F.array_sort(ranked), lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return F.when(F.coalesce(query, F.lit("")) == "", F.lit("")).otherwise(text)


def normalized(url: Column) -> Column:
    """The key that two spellings of an address share; null unless it is an absolute http(s) address."""
    path = let(F.regexp_replace(F.regexp_extract(url, ABSOLUTE, 3), r"\s+$", ""), folded)
    path = let(path, lambda p: let(F.regexp_replace(encoded_path(p), "/+$", ""), lambda x: F.when(x == "", F.lit("/")).otherwise(x)))
    query = let(F.regexp_replace(F.regexp_extract(url, ABSOLUTE, 4), r"^\?", ""), lambda q: let(sorted_query(q), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("?"), x))))
    return F.when(supported(url), F.concat(F.lit("https://"), _authority(url, key=True), path, query))


@F.pandas_udf(T.StringType())
def _python_key(urls: pd.Series) -> pd.Series:
    return urls.map(whatwg.normalized, na_action="ignore")


def normalized_any(url: Column) -> Column:
    """As normalized, by the standard to the letter: only addresses that are not plain reach Python, all others are null there."""
    plain = F.coalesce(url.rlike(PLAIN) & ~url.rlike(_NUMBER), F.lit(False))
    return F.coalesce(F.when(plain, normalized(url)), _python_key(F.when(~plain, url)))


def resolved(href: Column, base: Column) -> Column:
    """href seen from base, without fragment; null unless that is http(s). For plain addresses; whatwg.discovered has the whole standard."""
    absolute = lambda x: F.concat(scheme(x), F.lit("://"), _authority(x), let(F.regexp_extract(x, ABSOLUTE, 3), lambda p: F.when(p == "", F.lit("/")).otherwise(let(folded(p), encoded_path))), F.regexp_extract(x, ABSOLUTE, 4))

    def of(p: Column) -> Column:
        link, root, path = p["link"], p["root"], p["path"]
        place = F.regexp_extract(link, r"^([^?]*)", 1)
        query = F.regexp_extract(link, r"(\?.*)$", 1)
        folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
        same = F.concat(root, F.when(path == "", F.lit("/")).otherwise(encoded_path(path)))
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(supported(link), absolute(link)))
            .when(link.startswith("//"), let(F.concat(scheme(base), F.lit(":"), link), absolute))
            .when(link == "", F.concat(same, F.regexp_extract(base, ABSOLUTE, 4)))
            .when(place == "", F.concat(same, query))
            .otherwise(let(F.when(link.startswith("/"), place).otherwise(F.concat(folder, place)), lambda x: F.concat(root, let(folded(x), encoded_path), query)))
        )

    parts = F.struct(F.regexp_replace(F.trim(href), "#.*$", "").alias("link"), F.concat(scheme(base), F.lit("://"), _authority(base)).alias("root"), F.regexp_extract(base, ABSOLUTE, 3).alias("path"))
    return F.when(supported(base) & href.isNotNull(), let(parts, of))


@F.pandas_udf(T.StringType())
def _python_resolved(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or b is None else whatwg.discovered(h, b)[0] for h, b in zip(href, base, strict=True)], dtype=object)


def resolved_any(href: Column, base: Column) -> Column:
    """href seen from base by the standard to the letter, in Python: for the few rows that have one, such as redirects."""
    return _python_resolved(href, base)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "key", "rejected")]))
def _python_discovered(href: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if b is None else whatwg.discovered(h, b) for h, b in zip(href, base, strict=True)], columns=["url", "key", "rejected"], dtype=object)


def discovered(href: Column, base: Column) -> Column:
    """url, key, and why a link leads nowhere: unparseable or unsupported_scheme."""
    return _python_discovered(href, base)


def url_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def host(key: Column) -> Column:
    """The host of a normalised address, without user and port."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(key, ABSOLUTE, 2), r"^.*@", ""), r":\d+$", "")


def scope_of(seed_key: str, policy: str, rules: suffixes.Rules | None = None) -> Column:
    """The value that a run's scope is compared with: the seed's registrable domain or its host."""
    return registrable(host(F.lit(seed_key)), rules) if policy == "registrable_domain" else host(F.lit(seed_key))


def in_scope(key: Column, policy: str, value: str) -> Column:
    """policy: registrable_domain or exact_host."""
    if policy not in ("registrable_domain", "exact_host"):
        raise ValueError(f"scope policy {policy} is not supported")
    return F.coalesce((registrable(host(key)) if policy == "registrable_domain" else host(key)) == F.lit(value), F.lit(False))
