"""Canonical request keys, validity of results and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import text as T
from factloom.operators.ordered import as_of

# Seconds a result stays valid.
MARKET_TTL, COLLECTION_TTL, DOCUMENT_TTL = 300, 3_600, 2_592_000
# Version of the result shape per endpoint; raising one retires older results of that endpoint.
KEY_VERSIONS = {
    "/api/search": "search-1", "/api/news": "news-1", "/api/images": "images-1", "/api/videos": "videos-1",
    "/api/places": "places-1", "/api/finance": "finance-1", "/api/finance/search": "finance-search-1",
    "/api/finance/movers": "finance-movers-1",
}
DEFAULT_VERSION = "extract-1"

# Known controls per endpoint in key order with their default (None: left out when absent).
CONTROLS = {
    "/api/extract": (("url", ""), ("format", "json"), ("focus", None)),
    "/api/search": (("q", ""), ("format", "json"), ("limit", "10"), ("language", "en-US"), ("country", "US"), ("site", None)),
    "/api/news": (("q", ""), ("format", "json"), ("limit", "10"), ("language", "en-US"), ("country", "US"), ("timeframe", "any")),
    "/api/images": (("q", ""), ("format", "json"), ("limit", "10"), ("usage", "all"), ("orientation", "any")),
    "/api/videos": (("q", ""), ("format", "json"), ("limit", "10"), ("language", "en-US"), ("country", "US"),
                    ("platform", "any"), ("sort", "relevance"), ("creator", None)),
    "/api/places": (("q", ""), ("format", "json"), ("limit", "5"), ("language", "en"), ("country", None), ("lat", None),
                    ("lon", None), ("type", "any")),
    "/api/finance": (("symbol", ""), ("format", "json"), ("timeframe", "1mo"), ("quote", None)),
    "/api/finance/search": (("q", ""), ("format", "json"), ("limit", "10"), ("instrument", "equity")),
    "/api/finance/movers": (("format", "json"), ("limit", "10"), ("list", "gainers")),
}
# Controls whose explicitly empty value is kept apart from an absent one.
KEPT_WHEN_EMPTY = {"site", "creator", "lat", "lon"}


def assign_ttl(source: Column, has_items: Column, entity_type: Column) -> Column:
    return (
        F.when(source == "yahoo-finance", MARKET_TTL).when(has_items, COLLECTION_TTL)
        .when(entity_type == "product", COLLECTION_TTL).otherwise(DOCUMENT_TTL).cast("long")
    )


def _number_text(value: Column) -> Column:
    number = value.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(F.trim(value) == "", value).when(whole, number.cast("long").cast("string")).when(
        number.isNotNull(), number.cast("string")).otherwise(F.trim(value))


def _control(params: Column, name: str, default: str | None) -> Column:
    """struct(name, value) or null: the normalized control."""
    from factloom.operators.pages import canonical_language

    given = F.try_element_at(params, F.lit(name))
    clean = {
        "q": lambda v: T.collapse(v), "creator": lambda v: T.collapse(v), "url": F.trim, "focus": F.trim,
        "symbol": lambda v: F.upper(F.trim(v)), "country": lambda v: F.upper(F.trim(v)), "quote": lambda v: F.upper(F.trim(v)),
        "site": lambda v: F.regexp_replace(F.lower(F.trim(v)), r"\.$", ""), "lat": _number_text, "lon": _number_text,
        "language": lambda v: F.coalesce(canonical_language(F.trim(v)), F.trim(v)),
    }.get(name, lambda v: v)
    value = clean(given)
    if name in ("q", "url", "symbol"):
        value = F.coalesce(value, F.lit(default))
    elif name == "language":
        value = F.when(given.isNull(), F.lit(default)).otherwise(value)
    elif default is not None:
        value = F.coalesce(F.when(given != "", value), F.lit(default))
    elif name not in KEPT_WHEN_EMPTY:
        value = F.when(value != "", value)
    return F.when(value.isNotNull(), F.concat(F.lit(name + "="), F.url_encode(value)))


def cache_key(endpoint: Column, params: Column) -> Column:
    """Canonical text key of a request: defaults filled, spelling normalized, unknown parameters dropped."""
    name = F.when(endpoint == "/api/maps", F.lit("/api/places")).when(endpoint == "/mcp-cache", F.lit("/api/extract")).otherwise(endpoint)
    key = F.lit(None).cast("string")
    for path, controls in CONTROLS.items():
        parts = F.array_compact(F.array(*[_control(params, n, d) for n, d in controls]))
        version = KEY_VERSIONS.get(path, DEFAULT_VERSION)
        text = F.concat(F.lit(path + "?"), F.array_join(parts, "&"), F.lit("#" + version))
        key = F.when(name == path, text).otherwise(key)
    return key


def key_digest(key: Column) -> Column:
    return F.sha2(key, 256)


def cache_lookup(requests: DataFrame, results: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """Requests with HIT when the latest result of the key, stored before, is still valid, else MISS.

    `requests` has key, ts; `results` has key, stored_at, ttl and ok. Failed results are never stored.
    """
    stored = results.filter("ok").select("key", "stored_at", "ttl")
    found = as_of(requests, stored, ["key"], "ts", "stored_at", ["ttl"], chunk_seconds)
    valid = F.col("ts") < F.col("matched_ts") + F.make_dt_interval(secs=F.col("ttl").cast("decimal(18,6)"))
    return found.withColumn("outcome", F.when(F.coalesce(valid, F.lit(False)), "HIT").otherwise("MISS")).drop("ttl").withColumnRenamed("matched_ts", "stored_at")
