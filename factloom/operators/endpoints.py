"""Where the content of an address is published: kinds of addresses and the endpoints asked for them, in order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factloom.functions import urls as U
from factloom.functions.text import blank_to_null
from factloom.operators.discovery import MAX_GUESSES, inferred_feeds

# What a kind of address is read from: (step, order within the step, reader, address). A later step is asked only if no earlier one answered.
Attempt = tuple[int, int, str, Column]
PAGE_STEP = 3


def _video(url: Column) -> Column:
    """Id of a video address, shorts and embeds included."""
    return F.coalesce(U.youtube_id(url), F.when(U.is_youtube(url), blank_to_null(F.regexp_extract(U.path(url), r"^/(?:shorts|embed)/([A-Za-z0-9_-]{6,})", 1))))


def address_kind(url: Column) -> Column:
    """The kind of an address: the first that matches, `web` for ordinary pages."""
    profile = U.path(url).rlike(r"(?i)^/@[^/]+/?$")
    rules = (
        ("amazon-product", U.product_id(url).isNotNull()),
        ("amazon-search", U.product_search(url).isNotNull()),
        ("amazon-list", U.product_list(url).isNotNull()),
        ("app-store", U.app_store_id(url).isNotNull()),
        ("google-play", U.play_package(url).isNotNull()),
        ("google-news", U.is_google_news(url)),
        ("bluesky-post", U.is_bluesky_post(url)),
        ("bluesky-profile", U.is_bluesky_profile(url)),
        ("instagram-post", U.instagram_shortcode(url).isNotNull()),
        ("instagram-profile", U.is_instagram(url)),
        ("vimeo", U.is_vimeo(url)),
        ("soundcloud", U.is_soundcloud(url)),
        ("spotify", U.is_spotify(url)),
        ("tiktok-profile", U.is_tiktok(url) & profile),
        ("tiktok-post", U.is_tiktok(url)),
        ("x", U.is_x(url)),
        ("yahoo-finance", U.market_symbol(url).isNotNull()),
        ("reddit", U.is_reddit(url)),
        ("youtube-video", _video(url).isNotNull()),
        ("youtube-feed", U.is_youtube(url)),
        ("mastodon", U.is_mastodon_shaped(url)),
    )
    kind = F.lit("web")
    for name, matched in reversed(rules):
        kind = F.when(F.coalesce(matched, F.lit(False)), F.lit(name)).otherwise(kind)
    return kind


def kind_error(url: Column, kind: Column) -> Column:
    """`invalid_url` for addresses of a known host that name nothing one can read."""
    unreadable = ((kind == "x") & U.tweet_id(url).isNull()) | ((kind == "youtube-feed") & youtube_feed(url).isNull() & ~U.path(url).rlike(r"^/@[^/]+"))
    return F.when(unreadable, F.lit("invalid_url"))


def youtube_feed(url: Column) -> Column:
    at = lambda name, value: F.concat(F.lit(f"https://www.youtube.com/feeds/videos.xml?{name}="), F.url_encode(value))
    named = lambda part: blank_to_null(F.regexp_extract(U.path(url), rf"^/{part}/([^/]+)", 1))
    return F.coalesce(at("playlist_id", blank_to_null(U.parameter(url, "list"))), at("channel_id", named("channel")), at("user", named("user")))


def channel_feed(html: Column) -> Column:
    """Feed of the channel that a page shows."""
    marks = (r'"channelId"\s*:\s*"(UC[A-Za-z0-9_-]+)"', r'itemprop="channelId"\s+content="(UC[A-Za-z0-9_-]+)"', r'youtube\.com/channel/(UC[A-Za-z0-9_-]+)',
             r'"browseId"\s*:\s*"(UC[A-Za-z0-9_-]+)"')
    found = F.coalesce(*[blank_to_null(F.regexp_extract(html, m, 1)) for m in marks])
    return F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?channel_id="), found)


def storefront_address(url: Column, route: Column) -> Column:
    """Public product JSON of a shop page, from its `storefront_route`. The REST root of the second kind of shop is taken at the site's root."""
    kind, handle = route["kind"], route["handle"]
    first = F.get(U.segments(url), F.lit(0))
    local = F.when(F.coalesce(first.rlike(r"^(?i)[a-z]{2}(?:-[a-z]{2})?$"), F.lit(False)), F.concat(F.lit("/"), first)).otherwise(F.lit(""))
    at = lambda path: F.concat(U.origin(url), path)
    named = F.url_encode(handle)
    shopify = (
        F.when(kind == "product", at(F.concat(local, F.lit("/products/"), named, F.lit(".js"))))
        .when(kind == "collection", at(F.concat(local, F.lit("/collections/"), named, F.lit("/products.json?limit=50"))))
        .otherwise(at(F.concat(local, F.lit("/products.json?limit=50")))))
    api = F.lit("/wp-json/wc/store/v1/products")
    woo = (
        F.when((kind == "product") & handle.rlike(r"^\d+$"), at(F.concat(api, F.lit("/"), handle)))
        .when(kind == "product", at(F.concat(api, F.lit("?slug="), named, F.lit("&per_page=1"))))
        .when(kind == "search", at(F.concat(api, F.lit("?search="), named, F.lit("&per_page=50"))))
        .when(kind == "category", at(F.concat(api, F.lit("?category="), handle, F.lit("&per_page=50"))))
        .otherwise(at(F.concat(api, F.lit("?per_page=50")))))
    return F.when(route["shop"] == "shopify", shopify).when(route["shop"] == "woocommerce", woo)


def attempts(url: Column, kind: Column) -> Column:
    """array<struct(step, at, reader, address)>: all endpoints known from the address alone."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    q = F.url_encode
    code, word, post = U.product_id(url), U.product_search(url), U.canonical_entity_url(url)
    country = F.coalesce(F.lower(F.when(F.get(U.segments(url), F.lit(0)).rlike("^[A-Za-z]{2}$"), F.get(U.segments(url), F.lit(0)))), F.lit("us"))
    language = F.coalesce(blank_to_null(F.trim(U.parameter(url, "hl"))), F.lit("en"))
    region = F.when(U.parameter(url, "gl").rlike("^[A-Za-z]{2}$"), text("&gl=", F.upper(U.parameter(url, "gl"))))
    video = F.regexp_extract(U.path(url), r"/video/(\d+)", 1)
    source = F.when((U.host(url) == "player.vimeo.com") & (video != ""), text("https://vimeo.com/", video)).otherwise(url)
    secret = U.parameter(url, "h")
    thread = F.regexp_replace(F.regexp_replace(U.path(url), "/+$", ""), r"(?i)\.rss$", "")
    name = F.regexp_extract(U.path(url), r"^/@?([^/]+)", 1)
    status = F.regexp_extract(url, r"/(\d+)/?$", 1)
    uri = text("at://", U.bluesky_actor(url), "/app.bsky.feed.post/", U.bluesky_post_key(url))
    # Ordinary pages come after all that known networks answer: the page, what it names itself (the step after), guessed feeds, a browser's view.
    web: list[Attempt] = [(PAGE_STEP, 0, "page", url)] + [(PAGE_STEP + 2, i, "inferred", F.get(inferred_feeds(url), F.lit(i))) for i in range(MAX_GUESSES)]
    # Public endpoints.
    chains: dict[str, list[Attempt]] = {
        "amazon-product": [(0, 0, "market-product", text(U.origin(url), "/gp/aw/d/", code))],
        "amazon-search": [(0, 0, "market-search", text(U.origin(url), "/gp/aw/s?k=", q(word)))],
        "amazon-list": [(0, 0, "market-list", text(U.origin(url), U.path(url)))],
        "app-store": [(0, 0, "app-lookup", text("https://itunes.apple.com/lookup?id=", U.app_store_id(url), "&country=", country, "&entity=software")), (1, 0, "app-page", url),
                      (2, 0, "app-chart", text("https://rss.marketingtools.apple.com/api/v2/", country, "/apps/top-free/100/apps.json")),
                      (2, 1, "app-chart", text("https://rss.marketingtools.apple.com/api/v2/", country, "/apps/top-paid/100/apps.json"))],
        "google-play": [(0, 0, "play-page", text("https://play.google.com/store/apps/details?id=", U.play_package(url), "&hl=", language, F.coalesce(region, F.lit(""))))],
        "google-news": [(0, 0, "news-feed", F.regexp_replace(U.canonical_entity_url(url), r"^(https://news\.google\.com)/?", "$1/rss/"))],
        "bluesky-post": [(0, 0, "bluesky-post", text("https://public.api.bsky.app/xrpc/app.bsky.feed.getPostThread?uri=", q(uri), "&depth=0&parentHeight=0"))],
        "bluesky-profile": [(0, 0, "bluesky-profile", text("https://bsky.app/profile/", q(U.bluesky_actor(url)), "/rss"))],
        "instagram-post": [(0, 0, "instagram-post", text(post, "embed/captioned/")), (1, 0, "embed", text("https://graph.facebook.com/v25.0/instagram_oembed?url=", q(post)))],
        "instagram-profile": [(0, 0, "instagram-profile", text("https://www.instagram.com/", name, "/embed/"))],
        "vimeo": [(0, 0, "oembed", text("https://vimeo.com/api/oembed.json?url=", q(F.when(secret.isNotNull(), text(source, "?h=", secret)).otherwise(source))))],
        "soundcloud": [(0, 0, "oembed", text("https://soundcloud.com/oembed?format=json&url=", q(url)))],
        "spotify": [(0, 0, "oembed", text("https://open.spotify.com/oembed?url=", q(url)))],
        "tiktok-profile": [(0, 0, "tiktok-creator", text("https://www.tiktok.com/embed/@", q(name), "?lang=en-US")), (1, 0, "tiktok-page", url),
                           (2, 0, "embed", text("https://www.tiktok.com/oembed?url=", q(url)))],
        "tiktok-post": [(0, 0, "tiktok-page", url), (1, 0, "embed", text("https://www.tiktok.com/oembed?url=", q(url)))],
        "x": [(0, 0, "embed", text("https://publish.x.com/oembed?url=", q(url), "&omit_script=true&dnt=true")),
              (1, 0, "x-post", text("https://cdn.syndication.twimg.com/tweet-result?id=", U.tweet_id(url)))],
        "yahoo-finance": [(0, 0, "chart", text("https://query1.finance.yahoo.com/v8/finance/chart/", q(U.market_symbol(url)),
                                               "?interval=1d&range=1mo&events=div%2Csplits&includeAdjustedClose=true"))],
        "reddit": [(0, 0, "reddit", F.when(thread == "", F.lit("https://www.reddit.com/.rss")).otherwise(text("https://www.reddit.com", thread, "/.rss")))],
        "youtube-video": [(0, 0, "embed", text("https://www.youtube.com/oembed?url=", q(text("https://www.youtube.com/watch?v=", _video(url))), "&format=json"))],
        "youtube-feed": [(0, 0, "youtube-feed", youtube_feed(url)), (0, 1, "youtube-page", F.when(youtube_feed(url).isNull(), url))],
        # A path of that shape is a post only where the site describes it as one; else it is an ordinary page.
        "mastodon": [(0, 0, "mastodon", text(U.origin(url), "/api/v1/statuses/", status)), (0, 1, "embed", text(U.origin(url), "/api/oembed?url=", q(url)))] + web,
        "web": web,
    }
    none = F.array().cast("array<struct<step:int,at:int,reader:string,address:string>>")
    chosen = none
    for name_, chain in chains.items():
        rows = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(at).alias("at"), F.lit(reader).alias("reader"), address.alias("address")) for s, at, reader, address in chain])
        chosen = F.when(kind == name_, F.filter(rows, lambda r: r["address"].isNotNull())).otherwise(chosen)
    return chosen
