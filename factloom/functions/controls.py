"""Request controls: each rule gives the normalized value and an error code instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import let
from factloom.functions import text as T
from factloom.functions import urls as U

# Default and most results per endpoint, and the choices of closed controls with their default.
LIMITS = {"search": (10, 10), "news": (10, 50), "images": (10, 20), "videos": (10, 20), "places": (5, 10), "finance": (10, 10)}
CHOICES = {
    "timeframe": (("any", "1h", "1d", "7d", "30d"), "any"),
    "usage": (("all", "commercial", "modify", "commercial-and-modify"), "all"),
    "orientation": (("any", "landscape", "portrait", "square"), "any"),
    "platform": (("any", "youtube"), "any"),
    "sort": (("relevance", "date"), "relevance"),
    "type": (("any", "house", "street", "locality", "city", "county", "state", "country", "other"), "any"),
    "list": (("gainers", "losers", "active"), "gainers"),
    "instrument": (("equity", "crypto"), "equity"),
    "history": (("1d", "5d", "1mo", "3mo", "6mo", "1y", "5y", "max"), "1mo"),
}
HOST_LABEL = r"(?:xn--)?[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def _checked(value: Column, valid: Column) -> Column:
    return F.struct(F.when(valid, value).alias("value"), F.when(~F.coalesce(valid, F.lit(False)), F.lit("invalid_request")).alias("error_code"))


def _optional(given: Column, checked: Column, default: Column | None = None) -> Column:
    """An absent control takes its default and is never an error."""
    absent = F.struct((default if default is not None else F.lit(None)).cast("string").alias("value"), F.lit(None).cast("string").alias("error_code"))
    return F.when(given.isNull(), absent).otherwise(checked)


def limit(c: Column, endpoint: str) -> Column:
    usual, most = LIMITS[endpoint]
    number = c.try_cast("double")
    ok = lambda n: n.between(1, most) & (n == F.floor(n))
    return _optional(c, let(number, lambda n: _checked(n.cast("int").cast("string"), ok(n))), F.lit(str(usual)))


def choice(c: Column, name: str) -> Column:
    allowed, usual = CHOICES[name]
    return _optional(c, let(F.trim(c), lambda v: _checked(v, v.isin(*allowed))), F.lit(usual))


def language(c: Column, default: str) -> Column:
    from factloom.operators.pages import canonical_language

    return _optional(c, let(canonical_language(F.trim(c)), lambda v: _checked(v, v.isNotNull())), F.lit(default))


def country(c: Column, default: str | None = None) -> Column:
    return _optional(c, let(F.upper(F.trim(c)), lambda v: _checked(v, v.rlike("^[A-Z]{2}$"))), F.lit(default))


def coordinate(c: Column, largest: int) -> Column:
    return _optional(c, let(c.try_cast("double"), lambda v: _checked(v.cast("string"), v.between(-largest, largest))))


def symbol(c: Column) -> Column:
    return let(F.upper(F.trim(F.coalesce(c, F.lit("")))), lambda v: _checked(v, v.rlike(r"^[A-Z0-9.^=-]{1,32}$")))


def quote_currency(c: Column) -> Column:
    return _optional(c, let(F.upper(F.trim(c)), lambda v: _checked(v, v.rlike("^[A-Z]{3}$"))))


def creator(c: Column) -> Column:
    return _optional(c, let(T.collapse(c), lambda v: _checked(v, F.char_length(v).between(1, 80))))


def site(c: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    return _optional(c, let(name, lambda v: _checked(v, (F.char_length(v) <= 253) & v.rlike(rf"^{HOST_LABEL}(?:\.{HOST_LABEL})+$"))))


def normalize_controls(requests: DataFrame, endpoint: str) -> DataFrame:
    """Normalizes the control columns that are there and adds `error_code` of the first bad one."""
    rules = {
        "query": lambda c: let(T.normalize_query(c), lambda q: F.struct(q["query"].alias("value"), q["error_code"].alias("error_code"))),
        "limit": lambda c: limit(c, endpoint), "language": lambda c: language(c, "en" if endpoint == "places" else "en-US"),
        "country": lambda c: country(c, None if endpoint == "places" else "US"), "site": site, "creator": creator, "symbol": symbol, "quote": quote_currency,
        "latitude": lambda c: coordinate(c, 90), "longitude": lambda c: coordinate(c, 180),
    }
    known = {n: (rules[n] if n in rules else (lambda c, n=n: choice(c, n))) for n in requests.columns if n in rules or n in CHOICES}
    checked = requests.withColumns({f"_{n}": rule(F.col(n)) for n, rule in known.items()})
    codes = [F.col(f"_{n}.error_code") for n in known]
    if {"latitude", "longitude"} <= set(known):
        codes.append(F.when(F.col("latitude").isNull() != F.col("longitude").isNull(), F.lit("invalid_request")))
    out = checked.withColumn("error_code", F.coalesce(*codes, F.lit(None).cast("string")))
    return out.withColumns({n: F.col(f"_{n}.value") for n in known}).drop(*[f"_{n}" for n in known])


def result_url(base_url: str, endpoint: str, params: list[tuple[str, Column, str | None]], caller: Column, own_host: bool = False) -> Column:
    """Public address of a result: the caller's web address, else the endpoint with its non-default parameters.

    `params` are (name, value, default). With `own_host` only addresses on the service itself are taken over.
    """
    usable = U.public_url(caller)
    if own_host:
        usable = let(usable, lambda u: F.when(U.host(u) == base_url.split("//", 1)[1], u))
    shown = [F.when(v.isNotNull() & (v != (F.lit(d) if d is not None else F.lit(""))), F.concat(F.lit(f"{n}="), F.url_encode(v))) for n, v, d in params]
    text = F.array_join(F.array_compact(F.array(*shown)), "&")
    return F.coalesce(usable, F.concat(F.lit(f"{base_url}/api/{endpoint}?"), text))
