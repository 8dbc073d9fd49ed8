"""URL parts, safety rules, canonical keys, site keys, source classes and identifiers.

All functions stay on the JVM. Hosts outside ASCII are first rewritten by `encode_international_hosts`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from factloom.functions import let
from factloom.functions.text import blank_to_null, collapse

MAX_URL_LENGTH = 2048

# Hosts and suffixes that are never public targets.
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata.google", "instance-data")
BLOCKED_SUFFIXES = (".localhost", ".local", ".internal", ".home", ".lan")
# Special-use top-level names of the public registry, and the example domains still allowed.
SPECIAL_USE_SUFFIXES = (
    "test", "example", "invalid", "localhost", "local", "onion", "alt", "internal", "home.arpa",
    "example.com", "example.net", "example.org",
)
ALLOWED_EXAMPLES = ("example.com", "example.net", "example.org")

# Two-level suffixes below which a site has three labels.
TWO_LEVEL_SUFFIXES = (
    "ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.sg",
    "com.tr", "com.tw", "com.ua", "gov.uk", "net.au", "ne.jp", "org.au", "org.uk",
)

# Tracking parameters that do not identify a page.
TRACKING_PARAMETER = r"(?i)^(?:utm_.+|fbclid|gclid|dclid|mc_cid|mc_eid)$"

# Sections of publisher sites and the routes that list posts.
BLOG_SECTIONS = (
    "articles", "blog", "insights", "journal", "marketing", "news", "press", "resources", "sales", "service",
    "updates", "website",
)
LISTING_SEGMENTS = ("category", "page", "tag", "topics")

# Marketplace hosts with their currency.
MARKETPLACE_CURRENCIES = (
    ("amazon.ae", "AED"), ("amazon.ca", "CAD"), ("amazon.cn", "CNY"), ("amazon.co.jp", "JPY"),
    ("amazon.co.uk", "GBP"), ("amazon.com", "USD"), ("amazon.com.au", "AUD"), ("amazon.com.be", "EUR"),
    ("amazon.com.br", "BRL"), ("amazon.com.mx", "MXN"), ("amazon.com.tr", "TRY"), ("amazon.de", "EUR"),
    ("amazon.eg", "EGP"), ("amazon.es", "EUR"), ("amazon.fr", "EUR"), ("amazon.ie", "EUR"), ("amazon.in", "INR"),
    ("amazon.it", "EUR"), ("amazon.nl", "EUR"), ("amazon.pl", "PLN"), ("amazon.sa", "SAR"), ("amazon.se", "SEK"),
    ("amazon.sg", "SGD"),
)

_PARTS = r"^(?i:([a-z][a-z0-9+.-]*)):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def host(url: Column) -> Column:
    """Lower-cased host name without user, port or brackets."""
    bare = F.regexp_replace(F.regexp_replace(_authority(url), "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(bare), r"^\[|\]$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_authority(url), "^.*@", ""), r":(\d+)$", 1)


def path(url: Column) -> Column:
    # An empty path is the root; the address carries the slash it lacks.
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 3), "^$", "/")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def last_segment(url: Column) -> Column:
    return F.get(F.reverse(segments(url)), F.lit(0))


def parameter(url: Column, name: str) -> Column:
    """Decoded first value of a query parameter, null when absent or malformed."""
    value = lambda q: F.when(q.rlike(rf"&{name}="), F.try_url_decode(F.regexp_extract(q, rf"&{name}=([^&]*)", 1)))
    return let(F.concat(F.lit("&"), query(url)), value)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.regexp_replace(F.lower(_authority(url)), "^.*@", ""))


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def public_url(url: Column) -> Column:
    """The trimmed absolute web address, else null."""
    return let(F.trim(url), lambda u: F.when(is_http(u), u))


def absolute_url(href: Column, base: Column) -> Column:
    """A link resolved against its page; null for other schemes."""
    bound = F.struct(F.trim(href).alias("link"), base.alias("base"), origin(base).alias("origin"))

    def resolve(v: Column) -> Column:
        link, page = v["link"], v["base"]
        folder = F.regexp_replace(path(page), r"[^/]*$", "")
        return (
            F.when(link.rlike(r"^(?i)https?://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(link.startswith("//"), F.concat(scheme(page), F.lit(":"), link))
            .when(link.startswith("/"), F.concat(v["origin"], link))
            .when(link.startswith("?"), F.concat(F.regexp_replace(page, r"[?#].*$", ""), link))
            .when(link.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), link))
            .when(link == "", page)
            .otherwise(F.concat(v["origin"], folder, F.regexp_replace(link, r"^\./", "")))
        )

    return let(let(bound, resolve), lambda u: F.when(u.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), _folded(u)).otherwise(u))


def _folded(url: Column) -> Column:
    """The address with `.` and `..` segments of its path resolved, whatever their number."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)/?([^?#]*)(.*)$"
    segments = F.split(F.regexp_extract(url, parts, 2), "/")
    climb = lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), climb)
    # A path that ends in such a segment ends in a slash.
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.regexp_extract(url, parts, 1), F.lit("/"), F.array_join(ends, "/"), F.regexp_extract(url, parts, 3))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


@pandas_udf(StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    def encode(value: str) -> str:
        try:
            return value.encode("idna").decode()
        except UnicodeError:
            return value

    return hosts.map(encode, na_action="ignore")


def encode_international_hosts(df: DataFrame, column: str) -> DataFrame:
    """Rewrite hosts outside ASCII in their encoded form; other rows never leave the JVM."""
    url = F.col(column)
    foreign = F.coalesce(_authority(url).rlike(r"[^\x00-\x7F]"), F.lit(False))
    changed = (
        df.filter(foreign)
        .withColumn("_host", _idna(host(url)))
        .withColumn(column, F.concat(scheme(url), F.lit("://"), F.col("_host"),
                                     F.regexp_replace(url, r"^[^:]+://[^/?#]*", "")))
        .drop("_host")
    )
    return df.filter(~foreign).unionByName(changed)


def _ipv4_part(part: Column) -> Column:
    return (
        F.when(part.rlike(r"^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substring(part, 3, 20)), 16, 10))
        .when(part.rlike(r"^0[0-7]+$"), F.conv(part, 8, 10))
        .when(part.rlike(r"^\d+$"), part)
        .try_cast("decimal(20,0)")
    )


def address_kind(name: Column) -> Column:
    """`ip` for any spelling of an address, `broken` for a numeric host that is none, else null."""
    labels = F.split(F.regexp_replace(name, r"\.$", ""), r"\.")
    bound = F.struct(
        name.contains(":").alias("v6"), F.element_at(labels, -1).rlike(r"^(?:\d+|0x[0-9a-f]*)$").alias("numeric"),
        F.size(labels).alias("n"), F.transform(labels, _ipv4_part).alias("values"))

    def kind(v: Column) -> Column:
        # The last number fills all bytes that are left.
        limit = F.element_at(F.array(*[F.lit(256**k).cast("decimal(20,0)") for k in (4, 3, 2, 1)]), F.least(v["n"], F.lit(4)))
        fits = (
            (v["n"] <= 4)
            & F.forall(v["values"], lambda x: x.isNotNull())
            & (F.size(F.filter(v["values"], lambda x, i: (x > 255) & (i < v["n"] - 1))) == 0)
            & (F.element_at(v["values"], -1) < limit)
        )
        return (
            F.when(v["v6"] | (v["numeric"] & F.coalesce(fits, F.lit(False))), F.lit("ip"))
            .when(v["numeric"], F.lit("broken"))
        )

    return let(bound, kind)


def registrable_domain(name: Column) -> Column:
    """Site domain of a host, null for bare suffixes. Uses the listed two-level suffixes only."""
    def domain(labels: Column) -> Column:
        two = F.array_join(F.slice(labels, -2, 2), ".")
        return (
            F.when(F.size(labels) < 2, F.lit(None).cast("string"))
            .when(two.isin(*TWO_LEVEL_SUFFIXES), F.when(F.size(labels) >= 3, F.array_join(F.slice(labels, -3, 3), ".")))
            .otherwise(two)
        )

    return let(F.split(name, r"\."), domain)


def validate_url(url: Column, own_hosts: tuple[str, ...] = ()) -> Column:
    """struct(url, error_code): the normalized target, or `invalid_url` / `unsafe_url`.

    The first failing rule decides the code. `own_hosts` are the hosts of the service itself.
    """
    def parts(u: Column) -> Column:
        name = F.regexp_replace(host(u), r"\.$", "")
        return F.struct(
            u.alias("url"), scheme(u).alias("scheme"), name.alias("name"), port(u).alias("port"), path(u).alias("path"),
            query(u).alias("query"), F.regexp_replace(F.regexp_extract(_authority(u), r"^(.*)@", 1), ":", "").alias("user"))

    def named(p: Column) -> Column:
        return F.struct(p.alias("p"), address_kind(p["name"]).alias("kind"), registrable_domain(p["name"]).alias("domain"))

    def decide(v: Column) -> Column:
        p = v["p"]
        name, web_port = p["name"], p["port"]
        good_labels = F.forall(F.split(name, r"\."), lambda label: label.rlike(r"^(?!-)[a-z0-9-]{1,63}(?<!-)$"))
        below = lambda suffixes: F.exists(F.array(*[F.lit(s) for s in suffixes]), lambda s: name.endswith(s))
        special = name.isin(*SPECIAL_USE_SUFFIXES) | below(["." + s for s in SPECIAL_USE_SUFFIXES])
        example = F.coalesce(v["domain"].isin(*ALLOWED_EXAMPLES), F.lit(False))
        blocked = name.isin(*BLOCKED_HOSTS, *own_hosts) | below(BLOCKED_SUFFIXES)
        invalid, unsafe = F.lit("invalid_url"), F.lit("unsafe_url")
        code = (
            F.when(p["url"].isNull() | ~F.char_length(p["url"]).between(1, MAX_URL_LENGTH) | (p["scheme"] == ""), invalid)
            .when(~p["scheme"].isin("http", "https"), unsafe)
            .when((name == "") | name.rlike(r"[\s<>^|%]") | F.coalesce(v["kind"] == "broken", F.lit(False)), invalid)
            .when((p["user"] != "") | ((web_port != "") & ~web_port.isin("80", "443")) | F.coalesce(v["kind"] == "ip", F.lit(False)), unsafe)
            .when((F.char_length(name) > 253) | ~good_labels | v["domain"].isNull(), invalid)
            .when((special & ~example) | blocked, unsafe)
        )
        usual = F.when(p["scheme"] == "http", F.lit("80")).otherwise(F.lit("443"))
        shown_port = F.when((web_port == "") | (web_port == usual), F.lit("")).otherwise(F.concat(F.lit(":"), web_port))
        question = F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"]))
        return F.struct(code.alias("code"), F.concat(p["scheme"], F.lit("://"), name, shown_port, p["path"], question).alias("url"))

    decided = let(let(let(url, parts), named), decide)
    return let(decided, lambda d: F.struct(F.when(d["code"].isNull(), d["url"]).alias("url"), d["code"].alias("error_code")))


def canonical_url_key(url: Column) -> Column:
    """Host, path and sorted query without fragment, tracking parameters and trailing slashes."""
    default_port = ((scheme(url) == "http") & (port(url) == "80")) | ((scheme(url) == "https") & (port(url) == "443"))
    shown_port = F.when((port(url) == "") | default_port, F.lit("")).otherwise(F.concat(F.lit(":"), port(url)))
    trimmed = F.regexp_replace(path(url), r"/+$", "")
    clean_path = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(TRACKING_PARAMETER))
    ranked = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p"))))
    kept = F.array_join(F.transform(ranked, lambda r: r["p"]), "&")
    question = F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))
    return F.when(is_http(url), F.concat(host(url), shown_port, clean_path, question))


def site_key(name: Column) -> Column:
    """Last two labels of a host, three below a two-level suffix."""
    def key(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
        return F.when((F.size(labels) > 2) & last(2).isin(*TWO_LEVEL_SUFFIXES), last(3)).otherwise(last(2))

    return let(F.split(F.regexp_replace(F.lower(name), r"\.$", ""), r"\."), key)


def valid_domain(name: Column) -> Column:
    labels = F.split(name, r"\.")
    return (
        (F.char_length(name) <= 253)
        & name.contains(".")
        & name.rlike(r"^(?i)[a-z0-9.-]+$")
        & F.forall(labels, lambda l: F.char_length(l).between(1, 63) & ~l.startswith("-") & ~l.endswith("-"))
    )


def matches_site(url: Column, site: Column) -> Column:
    """Host equals the site or lies below it; a null site matches all."""
    return site.isNull() | (host(url) == site) | host(url).endswith(F.concat(F.lit("."), site))


def is_blog_listing(url: Column) -> Column:
    """Recognizable index pages of blogs and publishers."""
    parts = F.transform(segments(url), F.lower)
    publisher = host(url).rlike(r"^(?:blog|news|press)\.")
    first = F.get(parts, F.lit(0))
    n = F.size(parts)
    return (
        F.when(n == 0, publisher)
        .when(n == 1, first.isin(*BLOG_SECTIONS) | (publisher & first.isin(*LISTING_SEGMENTS)))
        .when((n == 2) & publisher & first.isin(*LISTING_SEGMENTS), F.lit(True))
        .when(n == 3, first.isin(*BLOG_SECTIONS) & (parts[1] == "page") & parts[2].rlike(r"^\d+$"))
        .otherwise(F.lit(False))
    )


def is_x(url: Column) -> Column:
    return host(url).isin("x.com", "www.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com")


def is_reddit(url: Column) -> Column:
    return (host(url) == "reddit.com") | host(url).endswith(".reddit.com")


def is_youtube(url: Column) -> Column:
    return host(url).isin("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be")


def is_google_news(url: Column) -> Column:
    p = path(url)
    searched = F.trim(F.coalesce(parameter(url, "q"), F.lit(""))) != ""
    return (host(url) == "news.google.com") & (
        (p == "/")
        | p.rlike(r"^(?i)/topstories/?$")
        | (p.rlike(r"^(?i)/search/?$") & searched)
        | p.rlike(r"^(?i)/topics/[a-z0-9_-]+/?$")
    )


def market_symbol(url: Column) -> Column:
    """Ticker of a quote or history page."""
    known = host(url).rlike(r"^(?:[a-z]{2}(?:-[a-z]{2})?\.)?finance\.yahoo\.com$")
    raw = F.regexp_extract(path(url), r"^(?i)/quote/([^/]+)(?:/history)?/?$", 1)
    symbol = F.upper(F.trim(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B"))))
    return F.when(known & (raw != "") & symbol.rlike(r"^[A-Z0-9.^=-]{1,32}$"), symbol)


def is_vimeo(url: Column) -> Column:
    return host(url).isin("vimeo.com", "www.vimeo.com", "player.vimeo.com") & path(url).rlike(
        r"^(?i)/(?:\d+|video/\d+|album/\d+/video/\d+|channels/[^/]+/\d+|groups/[^/]+/videos/\d+|ondemand/[^/]+/\d+)/?$"
    )


def is_soundcloud(url: Column) -> Column:
    first = F.lower(F.get(segments(url), F.lit(0)))
    return (
        host(url).isin("soundcloud.com", "www.soundcloud.com", "m.soundcloud.com")
        & first.isNotNull()
        & ~first.isin("discover", "search", "stream", "upload", "you")
    )


def is_spotify(url: Column) -> Column:
    resource = r"^(?i)/(?:intl-[a-z]{2}/)?(?:track|album|artist|episode|show|playlist)/[a-z0-9]+/?$"
    return ((host(url) == "spotify.link") & (path(url) != "/")) | (
        (host(url) == "open.spotify.com") & path(url).rlike(resource)
    )


def is_mastodon_shaped(url: Column) -> Column:
    return path(url).rlike(r"^/@[^/]+/\d+/?$")


def is_tiktok(url: Column) -> Column:
    p = path(url)
    return host(url).isin("vm.tiktok.com", "vt.tiktok.com") | (
        host(url).isin("tiktok.com", "www.tiktok.com", "m.tiktok.com")
        & (p.rlike(r"^(?i)/@[^/]+(?:/(?:video|photo)/\d+)?/?$") | p.rlike(r"^(?i)/t/[^/]+/?$"))
    )


# First path segments that are no profile names.
INSTAGRAM_RESERVED = (
    "about", "accounts", "api", "developer", "direct", "directory", "explore", "legal", "nametag", "reels", "static",
    "stories", "tv",
)


def is_instagram(url: Column) -> Column:
    profile = F.lower(F.regexp_extract(path(url), r"^/([A-Za-z0-9._]{1,30})/?$", 1))
    return host(url).isin("instagram.com", "www.instagram.com", "m.instagram.com") & (
        path(url).rlike(r"^(?i)/(?:p|reel)/[a-z0-9_-]+/?$") | ((profile != "") & ~profile.isin(*INSTAGRAM_RESERVED))
    )


def is_bluesky_post(url: Column) -> Column:
    return host(url).isin("bsky.app", "www.bsky.app") & path(url).rlike(r"^(?i)/profile/[^/]+/post/[^/]+/?$")


def is_bluesky_profile(url: Column) -> Column:
    return host(url).isin("bsky.app", "www.bsky.app") & path(url).rlike(r"^(?i)/profile/[^/]+/?$")


def _marketplace_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_marketplace(url: Column) -> Column:
    return _marketplace_host(url).isin(*[h for h, _ in MARKETPLACE_CURRENCIES])


def marketplace_currency(url: Column) -> Column:
    name = _marketplace_host(url)
    code = F.lit(None).cast("string")
    for known, currency in MARKETPLACE_CURRENCIES:
        code = F.when(name == known, F.lit(currency)).otherwise(code)
    return code


def product_id(url: Column) -> Column:
    """Ten-character product code of a marketplace address."""
    found = F.regexp_extract(path(url), r"(?i)/(?:dp|gp/product|gp/aw/d|gp/offer-listing)/([a-z0-9]{10})(?:/|$)", 1)
    return F.when(is_marketplace(url), blank_to_null(F.upper(found)))


def product_search(url: Column) -> Column:
    words = collapse(F.coalesce(parameter(url, "k"), F.lit("")))
    on_search = is_marketplace(url) & path(url).rlike(r"(?i)(?:^|/)s/?$")
    return F.when(on_search & F.char_length(words).between(1, 200), words)


def product_list(url: Column) -> Column:
    """struct(kind, id) of a public wish list or shop."""
    wish = F.regexp_extract(path(url), r"^(?i)/hz/wishlist/ls/([a-z0-9_-]{5,80})/?$", 1)
    shop = F.regexp_extract(path(url), r"^(?i)/shop/([a-z0-9._-]{1,80})(?:/.*)?$", 1)
    pick = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("id"))
    return F.when(is_marketplace(url), F.when(wish != "", pick("wishlist", wish)).when(shop != "", pick("storefront", shop)))


def app_store_id(url: Column) -> Column:
    found = F.regexp_extract(path(url), r"(?i)/id(\d{5,20})(?:/|$)", 1)
    return F.when(host(url).isin("apps.apple.com", "www.apps.apple.com"), blank_to_null(found))


def play_package(url: Column) -> Column:
    package = F.trim(F.coalesce(parameter(url, "id"), F.lit("")))
    valid = package.rlike(r"^(?=.{3,255}$)[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)+$")
    return F.when((host(url) == "play.google.com") & path(url).rlike(r"^(?i)/store/apps/details/?$") & valid, package)


def youtube_id(url: Column) -> Column:
    short = F.when(host(url) == "youtu.be", F.get(segments(url), F.lit(0)))
    long = F.when((host(url) == "youtube.com") | host(url).endswith(".youtube.com"), parameter(url, "v"))
    found = F.coalesce(short, long)
    return F.when(found.rlike(r"^[\w-]{11}$"), found)


def tweet_id(url: Column) -> Column:
    return F.when(is_x(url), blank_to_null(F.regexp_extract(path(url), r"^(?i)/[^/]+/status/(\d+)", 1)))


def instagram_shortcode(url: Column) -> Column:
    return F.when(is_instagram(url), blank_to_null(F.regexp_extract(path(url), r"^(?i)/(?:p|reel)/([a-z0-9_-]+)/?$", 1)))


def bluesky_actor(url: Column) -> Column:
    found = F.regexp_extract(path(url), r"^(?i)/profile/([^/]+)(?:/post/[^/]+)?/?$", 1)
    return F.when(is_bluesky_post(url) | is_bluesky_profile(url), F.try_url_decode(found))


def bluesky_post_key(url: Column) -> Column:
    found = F.regexp_extract(path(url), r"^(?i)/profile/[^/]+/post/([^/]+)/?$", 1)
    return F.when(is_bluesky_post(url), F.try_url_decode(found))


def spotify_id(url: Column) -> Column:
    return F.when(is_spotify(url), blank_to_null(F.regexp_extract(path(url), r"/([A-Za-z0-9]+)/?$", 1)))


def vimeo_id(url: Column) -> Column:
    return F.when(is_vimeo(url), blank_to_null(F.regexp_extract(path(url), r"/(\d+)/?$", 1)))


def classify_source(url: Column) -> Column:
    """The first matching source class; everything else is an ordinary web page."""
    rules = (
        ("amazon", product_id(url).isNotNull()),
        ("amazon", product_search(url).isNotNull()),
        ("amazon", product_list(url).isNotNull()),
        ("app-store", app_store_id(url).isNotNull()),
        ("google-play", play_package(url).isNotNull()),
        ("google-news", is_google_news(url)),
        ("bluesky", is_bluesky_post(url)),
        ("bluesky", is_bluesky_profile(url)),
        ("instagram", is_instagram(url)),
        ("vimeo", is_vimeo(url)),
        ("soundcloud", is_soundcloud(url)),
        ("spotify", is_spotify(url)),
        ("tiktok", is_tiktok(url)),
        ("x", is_x(url)),
        ("yahoo-finance", market_symbol(url).isNotNull()),
        ("reddit", is_reddit(url)),
        ("youtube", is_youtube(url)),
        ("mastodon", is_mastodon_shaped(url)),
    )
    chosen = F.lit("web")
    for source, matched in reversed(rules):
        chosen = F.when(F.coalesce(matched, F.lit(False)), F.lit(source)).otherwise(chosen)
    return chosen


def extract_ids(url: Column) -> Column:
    """The identifier that the source class carries in its address."""
    return F.coalesce(
        product_id(url), product_search(url), product_list(url)["id"], app_store_id(url), play_package(url),
        bluesky_post_key(url), bluesky_actor(url), instagram_shortcode(url), vimeo_id(url), spotify_id(url),
        tweet_id(url), market_symbol(url), youtube_id(url),
        F.when(is_soundcloud(url), last_segment(url)),
        F.when(is_mastodon_shaped(url), F.regexp_extract(path(url), r"/(\d+)/?$", 1)),
    )


def news_edition(language: Column, country: Column, requested: Column) -> Column:
    base = F.lower(F.split(language, "-")[0])
    return F.when(requested.rlike(r"^[A-Z]{2}:[a-z]{2,3}$"), requested).otherwise(F.concat_ws(":", country, base))


def canonical_entity_url(url: Column) -> Column:
    """The stable address of an entity, by source class."""
    source = classify_source(url)
    language = F.coalesce(F.when(parameter(url, "hl").rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), parameter(url, "hl")), F.lit("en-US"))
    country = F.coalesce(F.when(parameter(url, "gl").rlike(r"^[A-Za-z]{2}$"), F.upper(parameter(url, "gl"))), F.lit("US"))
    topic = F.regexp_extract(path(url), r"^(?i)/topics/([a-z0-9_-]+)/?$", 1)
    searched = path(url).rlike(r"^(?i)/search/?$")
    news_path = (
        F.when(searched, F.concat(F.lit("/search?q="), F.url_encode(collapse(parameter(url, "q"))), F.lit("&")))
        .when(topic != "", F.concat(F.lit("/topics/"), topic, F.lit("?")))
        .otherwise(F.lit("/?"))
    )
    edition = news_edition(language, country, parameter(url, "ceid"))
    news = F.concat(
        F.lit("https://news.google.com"), news_path, F.lit("hl="), F.url_encode(language),
        F.lit("&gl="), country, F.lit("&ceid="), F.url_encode(edition),
    )
    kind = F.lower(F.regexp_extract(path(url), r"^/([^/]+)/", 1))
    return (
        F.when(product_id(url).isNotNull(), F.concat(origin(url), F.lit("/dp/"), product_id(url)))
        .when(tweet_id(url).isNotNull(), F.concat(F.lit("https://x.com/i/status/"), tweet_id(url)))
        .when(instagram_shortcode(url).isNotNull(),
              F.concat(F.lit("https://www.instagram.com/"), kind, F.lit("/"), instagram_shortcode(url), F.lit("/")))
        .when(youtube_id(url).isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), youtube_id(url)))
        .when(app_store_id(url).isNotNull(), F.regexp_replace(url, r"[?#].*$", ""))
        .when(play_package(url).isNotNull(),
              F.concat(F.lit("https://play.google.com/store/apps/details?id="), play_package(url)))
        .when(source == "google-news", news)
        .otherwise(without_fragment(url))
    )


def storefront_kind(html: Column) -> Column:
    """Which shop software a page shows."""
    shopify = html.rlike(r"(?i)(?:cdn\.shopify\.com|/cdn/shop/|\bShopify\.theme\b|\bshopify-section\b|\bshopify-features\b)")
    woo = html.rlike(r"""(?i)(?:wp-content/plugins/woocommerce|\bwoocommerce(?:-|_)|\bwc-(?:block|store-api|ajax)|generator["'][^>]*WooCommerce)""")
    return F.when(shopify, F.lit("shopify")).when(woo, F.lit("woocommerce"))


def storefront_route(url: Column, html: Column) -> Column:
    """struct(shop, kind, handle): the shop software and what the address shows, null for other pages."""
    shop = F.when(host(url).endswith(".myshopify.com"), F.lit("shopify")).otherwise(storefront_kind(html))
    parts = segments(url)
    localized = F.coalesce(F.get(parts, F.lit(0)).rlike(r"^(?i)[a-z]{2}(?:-[a-z]{2})?$"), F.lit(False))
    route = F.when(localized, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    at = lambda i: F.get(route, F.lit(i))
    n = F.size(route)
    answer = lambda kind, handle: F.struct(shop.alias("shop"), F.lit(kind).alias("kind"), handle.alias("handle"))
    none = F.lit(None).cast("string")
    direct = (n == 2) & (at(0) == "products")
    nested = (n == 4) & (at(0) == "collections") & (at(2) == "products")
    shopify = (
        F.when(direct, answer("product", F.try_url_decode(at(1))))
        .when(nested, answer("product", F.try_url_decode(at(3))))
        .when(n.between(2, 3) & (at(0) == "collections"), answer("collection", F.try_url_decode(at(1))))
        .when((n == 0) | ((n == 1) & (at(0) == "collections")), answer("catalog", none))
    )
    body_class = F.regexp_extract(html, r"""(?i)<body\b[^>]*\bclass\s*=\s*["']([^"']*)""", 1)
    post = blank_to_null(F.regexp_extract(body_class, r"\bpostid-(\d+)\b", 1))
    slug = F.coalesce(F.get(parts, F.array_position(parts, F.lit("product")).cast("int")), last_segment(url))
    wanted = collapse(F.coalesce(parameter(url, "s"), F.lit("")))
    term = blank_to_null(F.regexp_extract(body_class, r"\bterm-(\d+)\b", 1))
    category = body_class.rlike(r"\btax-product_cat\b") | F.array_contains(parts, "product-category")
    shop_path = F.regexp_replace(path(url), "/+$", "")
    woo = (
        F.when(body_class.rlike(r"\bsingle-product\b") | F.array_contains(parts, "product"),
               answer("product", F.coalesce(post, F.try_url_decode(slug))))
        .when(F.char_length(wanted).between(1, 200), answer("search", wanted))
        .when(category, F.when(term.isNotNull(), answer("category", term)))
        .when((shop_path == "") | shop_path.rlike(r"(?i)/(?:[a-z]{2}(?:-[a-z]{2})?/)?shop$"), answer("catalog", none))
    )
    return F.when(shop == "shopify", shopify).when(shop == "woocommerce", woo)
