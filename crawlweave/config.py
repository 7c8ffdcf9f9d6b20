"""Settings from the environment and from command-line values, with the checks of both."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

from crawlweave.functions import whatwg

#: Names of environment variables and what holds where one is missing or empty.
TEXTS = {"DATABASE_URL": "", "FETCH_API_BASE_URL": "http://mock-api.mock.com/fetch", "LOG_LEVEL": "info", "OUTPUT_DIR": "output", "NODE_ENV": "development", "STORE_DIR": "crawl-state"}
NUMBERS = {"CONCURRENCY": 5, "MAX_DEPTH": 5, "MAX_BYTES": 104_857_600, "MAX_RUNTIME_SECONDS": 3600, "RUN_STALE_AFTER_MS": 900_000, "RETRY_BASE_DELAY_MS": 5_000, "RETRY_MAX_DELAY_MS": 300_000, "RETRY_JITTER_RATIO": 0.25, "RATE_LIMIT_DELAY_MS": 150, "RATE_LIMIT_DEFAULT_PAUSE_MS": 5_000}
MAX_URLS, STRATEGIES = 1000, ("auto", "base64", "utf8")
AT_LEAST_ONE = ("CONCURRENCY", "RUN_STALE_AFTER_MS")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    texts: dict[str, str]
    numbers: dict[str, float]
    max_urls: int | None
    body_strategy: str

    def __getitem__(self, name: str):
        return self.texts[name] if name in self.texts else self.numbers[name]


def number(text: str) -> float:
    """A finite number, whole where it is, or ConfigError."""
    try:
        value = float(int(text, 16) if text.strip().lower().startswith("0x") else text.strip() or 0)
    except ValueError:
        value = math.nan
    if not math.isfinite(value):
        raise ConfigError(f"not a number: {text}")
    return int(value) if value.is_integer() else value


def load(env: Mapping[str, str]) -> Config:
    texts = {n: env.get(n) or d for n, d in TEXTS.items()}
    numbers = {}
    for n, d in NUMBERS.items():
        try:
            numbers[n] = number(env[n]) if env.get(n) else d
        except ConfigError:
            raise ConfigError(f"invalid numeric environment variable {n}: {env[n]}") from None
    for n in AT_LEAST_ONE:
        if numbers[n] < 1:
            raise ConfigError(f"{n} must be at least 1")
    raw = env.get("MAX_URLS")
    try:
        most = MAX_URLS if raw is None else number(raw) if raw else 0
    except ConfigError:
        raise ConfigError(f"invalid numeric environment variable MAX_URLS: {raw}") from None
    if most < 0:
        raise ConfigError("MAX_URLS must be at least 1, or 0 or empty for unlimited")
    strategy = env.get("FETCH_BODY_STRATEGY") or "auto"
    if strategy not in STRATEGIES:
        raise ConfigError(f"invalid FETCH_BODY_STRATEGY: {strategy}")
    return Config(texts, numbers, most or None, strategy)


def limit(text: str, least: float, name: str, none: tuple[str, ...] = ("unlimited", "none"), above: bool = False):
    """A number of at least (or, if above, of more than) `least`; None for the words that mean unlimited."""
    if text in none:
        return None
    try:
        value = number(text)
        if not text.strip():
            raise ConfigError
    except ConfigError:
        value = -math.inf
    if value < least or above and value == least:
        raise ConfigError(f"{name} must be a number {'above' if above else 'of at least'} {least}" + (f", or one of {', '.join(x for x in none if x)}" if none else ""))
    return value


def max_urls(text: str):
    return limit(text, 1, "max-urls", ("", "0", "unlimited", "none"))


def max_depth(text: str):
    return limit(text, 0, "max-depth")


def max_amount(text: str):
    return limit(text, 0, "limit", above=True)


def at_least_one(text: str):
    return limit(text, 1, "value", ())


def seed(text: str) -> str:
    """The address as it is, if it is an absolute http(s) one."""
    if whatwg.normalized(text) is None:
        raise ConfigError("seed must be a valid HTTP or HTTPS address")
    return text


def run_uuid(text: str, strict: bool) -> str:
    """A run's id; a strict one has a version and variant of the standard."""
    pattern = r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}" if strict else r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    if not re.fullmatch(pattern, text, re.I):
        raise ConfigError("not a valid run id")
    return text
