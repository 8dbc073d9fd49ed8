"""Data-quality rules of the entity contract, as one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom import schema as S
from factloom.functions import urls as U

ISO_DATE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
# Allowed choices of attributes with a closed set.
CHOICES = {
    "orientation": ("landscape", "portrait", "square", "any"),
    "productType": ("physical", "software", "service"),
    "mediaType": ("text", "image", "video", "audio", "carousel", "mixed"),
    "historyTimeframe": ("1d", "5d", "1mo", "3mo", "6mo", "1y", "5y", "max"),
    "historyInterval": ("5m", "15m", "1d", "1wk", "1mo"),
    "timeframe": ("any", "1h", "1d", "7d", "30d"),
    "usage": ("all", "commercial", "modify", "commercial-and-modify"),
    "videoPlatform": ("any", "youtube"),
    "videoSort": ("relevance", "date"),
    "financeMoverList": ("gainers", "losers", "active"),
    "placeType": ("any", "house", "street", "locality", "city", "county", "state", "country", "other"),
}
COUNTS = (
    "wordCount", "price", "compareAtPrice", "reviewCount", "volume", "durationSeconds", "likeCount", "replyCount",
    "repostCount", "shareCount", "quoteCount", "viewCount", "followerCount", "followingCount", "postCount",
    "totalLikeCount", "resultCount",
)
URLS = ("licenseUrl", "creatorUrl", "website", "publisherUrl", "developerUrl", "authorImageUrl", "inReplyToUrl", "quotedPostUrl")
RANGES = {"latitude": (-90, 90), "longitude": (-180, 180)}
CAPS = {"history": 512, "events": 128}


def _rules(columns: set[str], attributes: set[str]) -> list[tuple[str, str, Column]]:
    """(path, code, broken) of every rule that applies to the given columns."""
    c = F.col
    rules = [
        ("type", "invalid_value", ~F.coalesce(c("type").isin(*S.ENTITY_TYPES), F.lit(False))),
        ("source", "invalid_value", ~F.coalesce(c("source").isin(*S.SOURCES), F.lit(False))),
        ("url", "invalid_format", ~F.coalesce(c("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), F.lit(False))),
        ("content", "invalid_type", c("content").isNull()),
    ]
    if "publishedAt" in columns:
        rules.append(("publishedAt", "invalid_format", ~c("publishedAt").rlike(ISO_DATE)))
    if "media" in columns:
        bad = F.exists("media", lambda m: ~F.coalesce(m["type"].isin("image", "video", "audio"), F.lit(False))
                       | ~F.coalesce(U.is_http(m["url"]), F.lit(False)) | (m["width"] <= 0) | (m["height"] <= 0))
        rules.append(("media", "invalid_value", F.coalesce(bad, F.lit(False))))
    for name in sorted(attributes):
        value, path = c(f"attributes.{name}"), f"attributes.{name}"
        allowed = [t for t, fields in S.ATTRIBUTES.items() if name in dict(fields)]
        kinds = ", ".join(f"'{t}'" for t in allowed)
        rules.append((path, "unrecognized_key", F.expr(f"{path} IS NOT NULL AND type NOT IN ({kinds})")))
        if name in CHOICES:
            rules.append((path, "invalid_value", ~value.isin(*CHOICES[name])))
        if name in COUNTS:
            rules.append((path, "too_small", value < 0))
            rules.append((path, "invalid_type", value != F.floor(value)))
        if name in URLS:
            rules.append((path, "invalid_format", ~U.is_http(value)))
        if name in RANGES:
            low, high = RANGES[name]
            rules.append((path, "out_of_range", ~value.between(low, high)))
        if name in CAPS:
            rules.append((path, "too_big", F.size(value) > CAPS[name]))
        if name == "currency":
            # Product currencies are strict codes; market units may be subunits such as GBp.
            strict, unit = value.rlike("^[A-Z]{3}$"), value.rlike(r"^[A-Za-z0-9._-]{1,12}$")
            rules.append((path, "invalid_format", F.when(c("type") == "product", ~strict).otherwise(~unit)))
        if name == "quoteCurrency":
            rules.append((path, "invalid_format", ~value.rlike("^[A-Z]{3}$")))
        if name == "countryCode":
            rules.append((path, "invalid_format", ~value.rlike("^[A-Z]{2}$")))
        if name in ("modifiedAt", "exchangeRateTimestamp"):
            rules.append((path, "invalid_format", ~value.rlike(ISO_DATE)))
        if name == "rating":
            rules.append((path, "too_small", value < 0))
        if name in ("ratingScale", "exchangeRate"):
            rules.append((path, "too_small", value <= 0))
        if name == "boundingBox":
            rules.append((path, "invalid_length", F.size(value) != 4))
        if name == "variants":
            bad = F.exists(value, lambda v: v["title"].isNull() | (v["price"] < 0) | (v["compareAtPrice"] < 0) | ~v["currency"].rlike("^[A-Z]{3}$"))
            rules.append((path, "invalid_value", F.coalesce(bad, F.lit(False))))
    return rules


def check_entities(df: DataFrame) -> DataFrame:
    """Adds `violations`, array<struct<path, code>> of the broken rules."""
    attributes = set(df.schema["attributes"].dataType.names) if "attributes" in df.columns else set()
    found = [
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))
        for path, code, broken in _rules(set(df.columns), attributes)
    ]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def validate_entities(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without violations, one row per violation with path and code)."""
    checked = check_entities(df)
    broken = checked.filter(F.size("violations") > 0).select("*", F.explode("violations").alias("violation"))
    return (
        checked.filter(F.size("violations") == 0).drop("violations"),
        broken.select(*[c for c in ("source", "url") if c in df.columns], "violation.path", "violation.code"),
    )


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a UNIQUE constraint would reject, with how often they occur."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def public_view(df: DataFrame) -> DataFrame:
    """The public form: internal lineage dropped, contract version added."""
    return df.drop("method").withColumn("schemaVersion", F.lit(1).cast("long"))
