"""The entity contract: closed value sets, Spark types and per-type attribute rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Sources of an entity.
SOURCES = (
    "web", "web-search", "image-search", "video-search", "place-search", "finance", "amazon", "app-store", "bluesky",
    "google-news", "google-play", "instagram", "mastodon", "reddit", "shopify", "woocommerce", "soundcloud", "spotify",
    "tiktok", "vimeo", "x", "yahoo-finance", "youtube",
)
# Entity types.
ENTITY_TYPES = ("document", "article", "product", "post", "profile", "video", "audio", "feed")
# How a row was obtained.
METHODS = (
    "native-markdown", "linkedom", "metadata", "blog-list-html", "product-list-html", "product-jsonld", "browser",
    "amazon-html", "amazon-search-html", "amazon-list-html", "app-store-lookup", "app-store-html", "app-store-chart",
    "bluesky-api", "bluesky-rss", "discovered-feed", "google-news-rss", "google-news-html", "google-news-browser",
    "google-play-html", "instagram-embed", "instagram-profile", "mastodon-oembed", "oembed", "wordpress-json",
    "reddit-rss", "shopify-json", "soundcloud-oembed", "spotify-oembed", "tiktok-hydration", "tiktok-profile-embed",
    "tiktok-oembed", "vimeo-oembed", "x-oembed", "react-tweet", "finance-search-json", "finance-movers-json",
    "yahoo-finance-chart", "youtube-atom", "youtube-oembed", "web-search-rss", "web-search-html",
    "image-search-openverse", "image-search-wikimedia", "video-search-json", "video-search-html", "place-search-photon",
    "woocommerce-json",
)
# Error codes.
ERROR_CODES = (
    "invalid_request", "invalid_url", "unsafe_url", "not_found", "unsupported_content_type", "content_too_large",
    "rate_limited", "source_blocked", "extraction_failed", "upstream_error", "timeout",
)

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
TEXTS = T.ArrayType(S)


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


MEDIA = _struct([("type", S), ("url", S), ("alt", S), ("width", L), ("height", L)])
VARIANT = _struct([
    ("id", S), ("title", S), ("sku", S), ("gtin", S), ("price", L), ("currency", S), ("priceDisplay", S),
    ("compareAtPrice", L), ("compareAtPriceDisplay", S), ("available", B),
])
HISTORY_POINT = _struct([
    ("timestamp", S), ("open", D), ("high", D), ("low", D), ("close", D), ("adjustedClose", D), ("volume", L),
])
MARKET_EVENT = _struct([
    ("type", S), ("timestamp", S), ("amount", D), ("numerator", D), ("denominator", D), ("splitRatio", S),
])

_PAGE = [("language", S), ("modifiedAt", S), ("wordCount", L)]
# The attributes each entity type may carry, with their types.
ATTRIBUTES = {
    "document": _PAGE + [
        ("description", S), ("license", S), ("licenseUrl", S), ("creatorUrl", S), ("fileType", S), ("tags", TEXTS),
        ("orientation", S), ("latitude", D), ("longitude", D), ("address", S), ("street", S), ("houseNumber", S),
        ("postalCode", S), ("locality", S), ("region", S), ("country", S), ("boundingBox", T.ArrayType(D)),
        ("category", S), ("website", S), ("phoneNumber", S), ("openingHours", S), ("countryCode", S),
        ("tickerSymbol", S), ("exchange", S), ("currency", S), ("instrumentType", S), ("sector", S), ("industry", S),
        ("listingCurrency", S), ("quoteCurrency", S), ("exchangeRate", D), ("exchangeRateTimestamp", S),
        ("marketPrice", D), ("previousClose", D), ("change", D), ("changePercent", D), ("dayHigh", D), ("dayLow", D),
        ("fiftyTwoWeekHigh", D), ("fiftyTwoWeekLow", D), ("volume", L), ("timezone", S), ("historyTimeframe", S),
        ("historyInterval", S), ("marketState", S), ("history", T.ArrayType(HISTORY_POINT)),
        ("events", T.ArrayType(MARKET_EVENT)),
    ],
    "article": _PAGE + [("publisher", S), ("publisherUrl", S), ("description", S)],
    "product": [
        ("productType", S), ("brand", S), ("seller", S), ("category", S), ("sku", S), ("gtin", S), ("tags", TEXTS),
        ("price", L), ("currency", S), ("priceDisplay", S), ("compareAtPrice", L), ("compareAtPriceDisplay", S),
        ("availability", S), ("rating", D), ("ratingScale", D), ("reviewCount", L), ("features", TEXTS),
        ("variants", T.ArrayType(VARIANT)), ("softwareVersion", S), ("operatingSystem", S), ("contentRating", S),
        ("developerUrl", S),
    ],
    "post": [
        ("handle", S), ("authorImageUrl", S), ("language", S), ("verified", B), ("contentWarning", S), ("mediaType", S),
        ("durationSeconds", L), ("hashtags", TEXTS), ("coauthors", TEXTS), ("locationName", S), ("sponsored", B),
        ("edited", B), ("sensitive", B), ("inReplyToUrl", S), ("quotedPostUrl", S), ("likeCount", L), ("replyCount", L),
        ("repostCount", L), ("shareCount", L), ("quoteCount", L), ("viewCount", L),
    ],
    "profile": [
        ("handle", S), ("biography", S), ("verified", B), ("pronouns", TEXTS), ("followerCount", L),
        ("followingCount", L), ("postCount", L), ("totalLikeCount", L),
    ],
    "video": [("durationSeconds", L), ("viewCount", L), ("publishedAtDisplay", S)],
    "audio": [("durationSeconds", L), ("viewCount", L), ("publishedAtDisplay", S)],
    "feed": [
        ("feedType", S), ("query", S), ("description", S), ("language", S), ("country", S), ("timeframe", S),
        ("usage", S), ("orientation", S), ("videoPlatform", S), ("videoSort", S), ("videoCreator", S),
        ("financeMoverList", S), ("site", S), ("placeType", S), ("latitude", D), ("longitude", D), ("resultCount", L),
        ("attribution", S),
    ],
}


def _all_attributes() -> T.StructType:
    merged: dict[str, T.DataType] = {}
    for fields in ATTRIBUTES.values():
        merged.update(dict(fields))
    return _struct(sorted(merged.items()))


ATTRIBUTES_TYPE = _all_attributes()

ENTITY = _struct([
    ("type", S), ("source", S), ("id", S), ("url", S), ("title", S), ("author", S), ("publishedAt", S), ("content", S),
    ("media", T.ArrayType(MEDIA)), ("attributes", ATTRIBUTES_TYPE), ("method", S),
])
# Feeds and profiles keep their items in a child table, since a Spark type cannot contain itself.
FEED_ITEM = _struct([("feed_id", S), ("position", L)] + [(f.name, f.dataType) for f in ENTITY.fields if f.name != "method"])


def contract_json() -> str:
    """The public contract as a Spark schema document."""
    return ENTITY.json()


# Billing tables; CHECK and UNIQUE constraints are data-quality rules.
BILLING_TABLES = {
    "accounts": _struct([
        ("user_id", S), ("customer_ref", S), ("subscription_ref", S), ("subscription_status", S),
        ("welcome_eligible", L), ("welcome_granted_at", L), ("created_at", L), ("updated_at", L),
    ]),
    "api_keys": _struct([
        ("id", S), ("user_id", S), ("key_hash", S), ("key_hint", S), ("name", S), ("created_at", L), ("revoked_at", L),
    ]),
    "checkout_intents": _struct([
        ("id", S), ("user_id", S), ("checkout_ref", S), ("payment_ref", S), ("mode", S), ("amount_cents", L),
        ("credits", L), ("status", S), ("funding_kind", S), ("created_at", L), ("updated_at", L),
    ]),
    "settings": _struct([("key", S), ("value", S), ("updated_at", L)]),
    "billing_ledger": _struct([
        ("id", S), ("user_id", S), ("kind", S), ("credits", L), ("amount_cents", L), ("payment_ref", S),
        ("external_ref", S), ("description", S), ("occurred_at", L), ("created_at", L),
    ]),
    "usage_alerts": _struct([
        ("id", S), ("user_id", S), ("percent", L), ("status", S), ("created_at", L), ("sent_at", L), ("last_error", S),
    ]),
    "pending_reversals": _struct([("payment_ref", S), ("kind", S), ("occurred_at", L), ("created_at", L)]),
    "webhook_events": _struct([
        ("event_id", S), ("event_type", S), ("status", S), ("attempts", L), ("received_at", L), ("processed_at", L),
        ("last_error", S),
    ]),
    "auto_topup_settings": _struct([
        ("user_id", S), ("enabled", L), ("trigger_credits", L), ("amount_cents", L), ("monthly_limit_cents", L),
        ("status", S), ("failure_count", L), ("next_retry_at", L), ("created_at", L), ("updated_at", L),
    ]),
    "auto_topup_authorizations": _struct([
        ("id", S), ("user_id", S), ("checkout_ref", S), ("status", S), ("created_at", L), ("updated_at", L),
    ]),
    "auto_topup_attempts": _struct([
        ("id", S), ("user_id", S), ("subscription_ref", S), ("payment_ref", S), ("period", S), ("amount_cents", L),
        ("credits", L), ("status", S), ("failure_code", S), ("created_at", L), ("updated_at", L),
    ]),
    "payment_reversal_state": _struct([
        ("payment_ref", S), ("refund_final", L), ("dispute_active", L), ("last_dispute_at", L), ("updated_at", L),
    ]),
}

METER_EVENT = _struct([("account", S), ("reservation_id", S), ("kind", S), ("credits", L), ("ts", T.TimestampType())])
PAYMENT_EVENT = _struct([
    ("event_id", S), ("type", S), ("payment_ref", S), ("user_id", S), ("amount_cents", L), ("credits", L),
    ("ts", T.TimestampType()),
])
