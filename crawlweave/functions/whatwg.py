"""Addresses by the WHATWG URL standard, in Python: for links, which Python parses anyway, and for what the expressions in urls.py leave out
(international names, numbers as hosts, escapes in hosts, user names)."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import parse_qsl, quote_from_bytes, unquote_to_bytes

#: What the standard leaves unescaped in each part (besides letters and digits), default ports, code points no host may have.
PATH_SAFE = "!$%&'()*+,-./:;=@[\\]^_|~"
QUERY_SAFE = "!$%&()*+,-./:;=?@[\\]^_`{|}~"
USER_SAFE = "!$%&'()*+,-._~"
FORM_SAFE = "*-._"
PORTS = {"http": "80", "https": "443"}
FORBIDDEN = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_DOT = re.compile(r"^(?:\.|%2e)$", re.I)
_DOTS = re.compile(r"^(?:\.|%2e){2}$", re.I)
UNPARSEABLE, UNSUPPORTED = "unparseable", "unsupported_scheme"


@dataclass(frozen=True)
class Address:
    scheme: str
    user: str  # with its @, or empty
    host: str
    port: str
    path: str
    query: str | None

    @property
    def href(self) -> str:
        return f"{self.scheme}://{self.user}{self.host}{':' + self.port if self.port else ''}{self.path}{'' if self.query is None else '?' + self.query}"


class Rejected(ValueError):
    """An address that is none, or of another scheme; the message says which."""


def _escaped(text: str, safe: str) -> str:
    return quote_from_bytes(text.encode("utf-8", "replace"), safe.encode())


def _number(part: str) -> int | None:
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16)
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part)
    except ValueError:
        return None


@lru_cache(4096)
def host_of(raw: str) -> str:
    """The host as the standard writes it: lower case, ASCII, numbers as dotted quads, shortest form of IPv6."""
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1] if raw.endswith(']') else 'x').compressed}]"
        except ValueError:
            raise Rejected(UNPARSEABLE) from None
    name = unquote_to_bytes(raw).decode("utf-8", "replace")
    if name.isascii():
        name = name.lower()
    else:
        name = unicodedata.normalize("NFKC", name).lower().translate({0x3002: ".", 0xFF0E: ".", 0xFF61: ".", 0xAD: None})
        try:
            name = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))
        except UnicodeError:
            raise Rejected(UNPARSEABLE) from None
    if not name or FORBIDDEN.search(name):
        raise Rejected(UNPARSEABLE)
    parts = name.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    if parts[-1].isdigit() or re.fullmatch(r"0x[0-9a-f]*", parts[-1]):
        values = [_number(p) for p in parts]
        if len(values) > 4 or None in values or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
            raise Rejected(UNPARSEABLE)
        whole = sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1])) + values[-1]
        return str(ipaddress.IPv4Address(whole))
    return name


def _folded(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if _DOTS.match(part):
            out = out[:-1] + [""] * last
        elif _DOT.match(part):
            out += [""] * last
        else:
            out.append(part)
    return "/" + "/".join(out)


def parsed(text: str, base: Address | None = None) -> Address:
    """An absolute http(s) address without fragment, or Rejected."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21))))).split("#", 1)[0]
    found = _SCHEME.match(text)
    scheme, rest = (found[1].lower(), text[found.end() :]) if found else (base.scheme if base else "", text)
    if found and scheme not in PORTS:
        raise Rejected(UNSUPPORTED)
    if not scheme:
        raise Rejected(UNPARSEABLE)
    place, _, query = rest.partition("?")
    query = _escaped(query, QUERY_SAFE) if "?" in rest else None
    place = place.replace("\\", "/")
    if base and scheme == base.scheme and not place.startswith("/" if found else "//"):
        # an address of the base's scheme without slashes is relative to it
        if place == "":
            return Address(scheme, base.user, base.host, base.port, base.path, query if query is not None else base.query)
        if not place.startswith("/"):
            place = base.path[: base.path.rfind("/") + 1] + place
        return Address(scheme, base.user, base.host, base.port, _folded(_escaped(place, PATH_SAFE)), query)
    if base and not found and not place.startswith("//"):
        return Address(scheme, base.user, base.host, base.port, _folded(_escaped(place, PATH_SAFE)), query)
    authority, slash, path = place.lstrip("/").partition("/")
    user, at, name = authority.rpartition("@")
    named = re.fullmatch(r"(\[.*\]|[^:]*)(?::(\d*))?", name)
    if not named:
        raise Rejected(UNPARSEABLE)
    port = named[2].lstrip("0") or ("0" if named[2] else "") if named[2] else ""
    if port and int(port) > 65535:
        raise Rejected(UNPARSEABLE)
    who, colon, word = user.partition(":")
    user = _escaped(who, USER_SAFE) + (":" + _escaped(word, USER_SAFE) if word else "")
    return Address(scheme, user + "@" if user else "", host_of(named[1]), "" if port == PORTS[scheme] else port, _folded(_escaped("/" + path, PATH_SAFE)), query)


def _order(text: str) -> tuple:
    """About the root collation: marks and signs, digits, letters; accents and then case (small first) only break ties."""
    flat = unicodedata.normalize("NFD", text)
    plain = [c for c in flat if not unicodedata.combining(c)]
    kind = lambda c: (2, c.casefold()) if c.isalpha() else (1, c) if c.isdigit() else (0, f"{_SIGNS.find(c):04}" if c in _SIGNS else c)
    return [kind(c) for c in plain], [c for c in flat if unicodedata.combining(c)], [c.isupper() for c in plain], text


#: The order of ASCII signs in the root collation.
_SIGNS = "\t\n\x0b\x0c\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def key_of(a: Address) -> str:
    """The key that spellings of an address share: https, no trailing slashes, parameters sorted and written as a form."""
    pairs = [(k, v) for k, v in parse_qsl(a.query or "", keep_blank_values=True, errors="replace")]
    pairs.sort(key=lambda x: (_order(x[0]), _order(x[1])))
    form = lambda x: quote_from_bytes(x.encode("utf-8", "replace"), FORM_SAFE.encode() + b" ").replace("~", "%7E").replace(" ", "+")
    query = "&".join(f"{form(k)}={form(v)}" for k, v in pairs)
    return Address("https", a.user, a.host, "" if a.port == "443" else a.port, a.path.rstrip("/") or "/", query or None).href


def normalized(text: str | None) -> str | None:
    try:
        return None if text is None else key_of(parsed(text))
    except Rejected:
        return None


@lru_cache(1024)
def _base(text: str) -> Address | None:
    try:
        return parsed(text)
    except Rejected:
        return None


def discovered(href: str | None, base: str) -> tuple[str | None, str | None, str | None]:
    """The address a link leads to, its key, and else the reason why it is none: unparseable or unsupported_scheme."""
    try:
        if href is None:
            raise Rejected(UNPARSEABLE)
        found = parsed(href, _base(base))
        return found.href, key_of(found), None
    except Rejected as e:
        return None, None, str(e)
