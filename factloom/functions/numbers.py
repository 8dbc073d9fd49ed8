"""Rounding, money, counts, durations and geometry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

from factloom.functions import let

EPSILON = 2.220446049250313e-16
MAX_SAFE_INTEGER = 2**53 - 1

# Currencies without minor units.
ZERO_DIGIT_CURRENCIES = (
    "BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF",
)

# Text marks of a currency, tried in this order.
CURRENCY_MARKS = (
    ("EUR", r"\bEUR\b|€"), ("GBP", r"\bGBP\b|£"), ("JPY", r"\bJPY\b|¥"), ("CHF", r"\bCHF\b"),
    ("CAD", r"\bCAD\b|C\$"), ("AUD", r"\bAUD\b|A\$"), ("USD", r"\bUSD\b|\$"),
)


def round_half_up(c: Column, digits: int) -> Column:
    """Half toward plus infinity, on doubles."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + 0.5).cast("double") / scale


def market_round(c: Column, digits: int = 8) -> Column:
    """Rounding of market values: half up after adding the double epsilon."""
    return round_half_up(c + F.lit(EPSILON), digits)


def market_value(c: Column, digits: int = 8) -> Column:
    """Rounded non-negative finite number, else null."""
    return let(c, lambda v: F.when(~F.isnan(v) & (v >= 0) & (v < float("inf")), market_round(v, digits)))


def as_number(c: Column) -> Column:
    """Finite double of a text or number, else null."""
    return let(c.try_cast("double"), lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))


def as_count(c: Column) -> Column:
    """Safe non-negative integer, else null; fractions are rejected."""
    return let(as_number(c), lambda v: F.when(v.between(0, MAX_SAFE_INTEGER) & (v == F.floor(v)), v.cast("long")))


def as_positive(c: Column) -> Column:
    return let(as_count(c), lambda v: F.when(v > 0, v))


def as_text(c: Column) -> Column:
    from factloom.functions.text import blank_to_null, collapse

    return blank_to_null(collapse(c))


def currency_digits(currency: Column) -> Column:
    return F.when(currency.isin(*ZERO_DIGIT_CURRENCIES), F.lit(0)).otherwise(F.lit(2))


def _scale(digits: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(7)]), digits + 1).cast("long")


def minor_units(major: Column, currency: Column) -> Column:
    """Integer minor units of a decimal amount, rounded half up; null when negative or no amount."""
    scaled = major.try_cast(DecimalType(30, 8)) * _scale(currency_digits(currency))
    units = F.floor(scaled + F.lit("0.5").cast(DecimalType(3, 1)))
    return let(units, lambda u: F.when(u.between(0, MAX_SAFE_INTEGER), u.cast("long")))


def minor_units_truncated(major: Column, digits: Column) -> Column:
    """Minor units of a plain decimal text: the fraction is padded or cut, never rounded."""
    text = F.trim(major)
    whole = F.regexp_extract(text, r"^(\d+)", 1)
    fraction = F.regexp_extract(text, r"^\d+\.(\d+)$", 1)
    padded = F.substring(F.rpad(fraction, 6, "0"), F.lit(1), digits)
    units = F.concat(whole, padded).try_cast("long")
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), units)


def price_display(units: Column, digits: Column, currency: Column) -> Column:
    """`12.50 EUR`, or the bare amount when the currency is unknown."""
    exact = units.cast(DecimalType(20, 0)) / _scale(digits)
    amount = F.when(digits == 0, units.cast("string")).otherwise(exact.cast(DecimalType(22, 2)).cast("string"))
    return F.concat_ws(" ", amount, currency)


def decimal_amount(text: Column) -> Column:
    """First amount in a price text; the last separator is decimal when one or two digits follow."""
    raw = F.regexp_replace(F.regexp_extract(text, r"\d[\d\s.,'’]*", 0), r"[\s'’]", "")
    # The last separator in front of one or two closing digits is marked, the others vanish.
    marked = F.regexp_replace(raw, r"[.,](\d{1,2})$", "#$1")
    plain = F.regexp_replace(F.regexp_replace(marked, r"[.,]", ""), "#", ".")
    return plain.try_cast(DecimalType(30, 8))


def currency_from_text(advertised: Column, text: Column) -> Column:
    """An advertised three-letter code, else the first mark found in the price text."""
    def choose(v: Column) -> Column:
        guess = F.when(v["code"].rlike("^[A-Z]{3}$"), v["code"])
        for currency, pattern in CURRENCY_MARKS:
            guess = guess.when(v["text"].rlike(pattern), F.lit(currency))
        return guess

    return let(F.struct(F.upper(F.trim(advertised)).alias("code"), text.alias("text")), choose)


def duration_seconds(text: Column) -> Column:
    """Seconds of `m:ss` or `h:mm:ss`; null when a field is out of range."""
    parsed = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("long"))

    def total(parts: Column) -> Column:
        valid = (
            F.size(parts).between(2, 3)
            & F.forall(parts, lambda p: p.isNotNull() & (p >= 0))
            & F.forall(F.slice(parts, 2, 2), lambda p: p <= 59)
        )
        return F.when(valid, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 60 + F.coalesce(p, F.lit(0))))

    return let(parsed, total)


def exact_view_count(text: Column) -> Column:
    """Exact count in a label; shortened counts (1.2K) are unknown and `no views` is zero."""
    from factloom.functions.text import collapse

    def count(label: Column) -> Column:
        digits = F.regexp_extract(label, r"^(\d{1,3}(?:[,.\s]\d{3})+|\d+)(?:\D|$)", 1)
        shortened = label.rlike(r"(?i)\d[.,]\d+\s*[KMB]\b")
        return (
            F.when(label.rlike(r"(?i)^no\s+views?\b"), F.lit(0).cast("long"))
            .when(~shortened, F.regexp_replace(digits, r"\D", "").try_cast("long"))
        )

    return let(collapse(text), count)


def orientation(width: Column, height: Column) -> Column:
    known = (width > 0) & (height > 0)
    return (
        F.when(known & (width == height), F.lit("square"))
        .when(known & (width > height), F.lit("landscape"))
        .when(known, F.lit("portrait"))
    )


def bounding_box(bbox: Column, extent: Column) -> Column:
    """[west, south, east, north] from a GeoJSON box, else from a (west, north, east, south) extent."""
    def checked(box: Column) -> Column:
        west, south, east, north = (box[i] for i in range(4))
        fits = (west >= -180) & (east <= 180) & (south >= -90) & (north <= 90) & (west <= east) & (south <= north)
        return F.when(fits, box)

    direct = F.when(F.size(bbox) == 4, bbox)
    reordered = let(extent, lambda e: F.when(F.size(e) == 4, F.array(e[0], e[3], e[2], e[1])))
    return F.coalesce(let(direct, checked), let(reordered, checked))


def planar_distance(lat: Column, lon: Column, at_lat: Column, at_lon: Column) -> Column:
    """Squared distance on a plane whose longitudes shrink with the reference latitude; missing is infinite."""
    dlat = lat - at_lat
    dlon = (lon - at_lon) * F.cos(at_lat * F.lit(3.141592653589793) / 180)
    return F.coalesce(dlat * dlat + dlon * dlon, F.lit(float("inf")))
