"""Embed descriptions of networks, market charts, app charts, creator embeds, and the parent rows of feeds, profiles and product lists.

Input rows have payload_id, url (the requested address) and body; readers of several networks also need `kind`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import let, rows_of
from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import from_epoch_seconds, iso, parse_date
from factloom.functions.dom import fragment_markdown
from factloom.operators.listings import json_items
from factloom.operators.market import EVENT_LIMIT, HISTORY_LIMIT, normalize_symbol
from factloom.sources.embeds import context_json, embedded_json
from factloom.sources.entities import EMPTY_MEDIA, entity_rows, image

J = F.get_json_object
e = T.escape_markdown


def _link(label: str, url: Column) -> Column:
    return F.concat(F.lit(f"[{label}]("), url, F.lit(")"))


def _per(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def normalize_network_embeds(payloads: DataFrame) -> DataFrame:
    """Embed descriptions of posts and videos: kinds x, tiktok, instagram, youtube, mastodon. Descriptions without public content give no row."""
    page, kind, body = F.col("url"), F.col("kind"), F.col("body")
    field = lambda name: T.as_value(F.trim(J(body, f"$.{name}")))
    df = payloads.filter(F.try_parse_json("body").isNotNull()).withColumn("markup", T.as_value(fragment_markdown(F.coalesce(field("html"), F.lit("")), page)))
    df = df.withColumn("by", field("author_name")).withColumn("picture", field("thumbnail_url")).withColumn("given", field("title"))
    user = F.coalesce(T.blank_to_null(F.regexp_extract(J(body, "$.author_url"), r"(?i)(?:x|twitter)\.com/([^/?#]+)", 1)),
                      T.blank_to_null(F.regexp_extract(U.path(page), r"(?i)^/([^/]+)/status/", 1)), F.lit("user"))
    df = df.withColumn("user", F.when(kind == "x", user))
    enough = F.when(kind == "x", F.col("markup").isNotNull()).when(kind == "tiktok", F.col("markup").isNotNull() | F.col("by").isNotNull()).when(
        kind == "instagram", field("html").isNotNull()).otherwise(F.lit(True))
    df = df.filter(enough)
    profile = (kind == "tiktok") & U.path(page).rlike(r"(?i)^/@[^/]+/?$")
    post_id = F.regexp_extract(U.path(page), r"/(?:video|photo)/(\d+)", 1)
    df = df.withColumn("id", _per(kind, {
        "x": U.tweet_id(page), "instagram": U.instagram_shortcode(page), "youtube": U.youtube_id(page), "mastodon": T.blank_to_null(F.regexp_extract(page, r"/(\d+)/?$", 1)),
        "tiktok": F.when(profile, F.regexp_extract(U.path(page), r"^/@([^/]+)", 1)).otherwise(T.blank_to_null(post_id))}))
    df = df.withColumn("target", F.coalesce(_per(kind, {
        "x": F.concat(F.lit("https://x.com/"), "user", F.lit("/status/"), "id"), "instagram": U.canonical_entity_url(page), "youtube": U.canonical_entity_url(page)}), page))
    handle = F.concat(F.lit("@"), "user")
    df = df.withColumn("author", _per(kind, {
        "x": F.when(F.col("by").isNotNull(), F.concat("by", F.lit(" ("), handle, F.lit(")"))).otherwise(handle),
        "tiktok": F.col("by"), "youtube": F.col("by"), "mastodon": F.col("by")}))
    df = df.withColumn("title", _per(kind, {
        "x": F.concat(F.lit("Post by "), handle), "tiktok": F.coalesce("given", F.lit("TikTok post")), "instagram": F.lit("Instagram post"),
        "youtube": F.coalesce("given", F.lit("YouTube video")),
        "mastodon": F.coalesce("given", F.concat(F.lit("Mastodon post by "), F.coalesce("by", F.lit("unknown author"))))}))
    head = F.when(kind == "x", F.concat(F.lit("# Post by "), e(F.col("author")))).otherwise(F.concat(F.lit("# "), e(F.col("title"))))
    shown = F.when(kind == "youtube", F.concat(F.lit("By "), e(F.col("author"))))
    thumb = F.when(kind == "youtube", F.concat(F.lit("![Video thumbnail]("), "picture", F.lit(")")))
    view = _per(kind, {name: _link(f"{verb} on {label}", F.col("target")) for name, verb, label in (
        ("x", "View", "X"), ("tiktok", "View", "TikTok"), ("instagram", "View", "Instagram"), ("youtube", "Watch", "YouTube"), ("mastodon", "View", "Mastodon"))})
    text = F.when(kind.isin("x", "tiktok", "mastodon"), F.col("markup"))
    alt = F.when(kind == "youtube", F.lit("Video thumbnail")).when(kind == "mastodon", F.concat("title", F.lit(" thumbnail"))).otherwise(F.col("title"))
    return entity_rows(
        df, ["payload_id"], type=F.when(profile, "profile").when(kind == "youtube", "video").otherwise("post"), source=kind,
        method=_per(kind, {"x": F.lit("x-oembed"), "tiktok": F.lit("tiktok-oembed"), "instagram": F.lit("instagram-embed"), "youtube": F.lit("youtube-oembed"),
                           "mastodon": F.lit("mastodon-oembed")}),
        id=F.col("id"), url=F.col("target"), title=F.col("title"), author=F.col("author"), content=T.join_present("\n\n", head, shown, text, thumb, view),
        media=image(F.when(~kind.isin("x", "instagram"), F.col("picture")), alt),
        attributes={"handle": F.when(kind == "x", handle).when(kind == "tiktok", F.col("by"))})


_CHART = (
    "chart struct<result:array<struct<meta:struct<symbol:string,currency:string,longName:string,shortName:string,fullExchangeName:string,exchangeName:string,instrumentType:string,"
    "regularMarketPrice:double,regularMarketTime:double,chartPreviousClose:double,previousClose:double,regularMarketDayHigh:double,regularMarketDayLow:double,"
    "fiftyTwoWeekHigh:double,fiftyTwoWeekLow:double,regularMarketVolume:double,exchangeTimezoneName:string,timezone:string,marketState:string>,"
    "timestamp:array<double>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>,events:struct<dividends:map<string,struct<date:double,amount:double>>,"
    "splits:map<string,struct<date:double,numerator:double,denominator:double,splitRatio:string>>>>>>"
)


def normalize_charts(payloads: DataFrame, timeframe: str = "1mo", interval: str = "1d", source: str = "yahoo-finance") -> DataFrame:
    """Market charts: reported price, previous close, change, price history and events of one symbol. Parsed once, all columns of one row."""
    r = F.col("r")
    df = payloads.withColumn("r", F.get(F.from_json("body", _CHART)["chart"]["result"], F.lit(0)))
    df = df.withColumn("symbol", F.coalesce(U.market_symbol(F.col("url")), normalize_symbol(r["meta"]["symbol"]))).filter(r.isNotNull() & F.col("symbol").isNotNull())
    quote = F.get(r["indicators"]["quote"], F.lit(0))
    adjusted = F.get(r["indicators"]["adjclose"], F.lit(0))["adjclose"]
    value = lambda series, i: N.market_value(F.get(series, i))
    points = F.transform(r["timestamp"], lambda t, i: F.struct(
        iso(from_epoch_seconds(t)).alias("timestamp"), *[value(quote[n], i).alias(n) for n in ("open", "high", "low", "close")],
        value(adjusted, i).alias("adjustedClose"), N.as_count(F.get(quote["volume"], i)).alias("volume")))
    filled = F.filter(points, lambda p: p["timestamp"].isNotNull() & F.coalesce(p["open"], p["high"], p["low"], p["close"], p["adjustedClose"], p["volume"].cast("double")).isNotNull())
    last = lambda rows, limit: let(rows, lambda f: F.slice(f, F.greatest(F.size(f) - limit + 1, F.lit(1)), limit))
    df = df.withColumn("history", last(filled, HISTORY_LIMIT))
    none = F.lit(None)
    dividends = F.transform(F.map_values(r["events"]["dividends"]), lambda d: F.struct(
        F.lit("dividend").alias("type"), iso(from_epoch_seconds(d["date"])).alias("timestamp"), N.market_value(d["amount"]).alias("amount"),
        none.cast("double").alias("numerator"), none.cast("double").alias("denominator"), none.cast("string").alias("splitRatio")))
    positive = lambda c: F.when(c > 0, N.market_round(c))
    splits = F.transform(F.map_values(r["events"]["splits"]), lambda s: F.struct(
        F.lit("split").alias("type"), iso(from_epoch_seconds(s["date"])).alias("timestamp"), none.cast("double").alias("amount"),
        positive(s["numerator"]).alias("numerator"), positive(s["denominator"]).alias("denominator"), T.as_value(F.trim(s["splitRatio"])).alias("splitRatio")))
    empty = F.array().cast("array<struct<type:string,timestamp:string,amount:double,numerator:double,denominator:double,splitRatio:string>>")
    dated = F.filter(F.concat(F.coalesce(dividends, empty), F.coalesce(splits, empty)), lambda v: v["timestamp"].isNotNull())
    ordered = F.transform(F.array_sort(F.transform(dated, lambda v: F.struct(v["timestamp"].alias("at"), v["type"].alias("kind"), v.alias("v")))), lambda s: s["v"])
    closes = F.transform(F.filter("history", lambda p: p["close"].isNotNull()), lambda p: p["close"])
    meta = r["meta"]
    df = df.withColumn("events", last(ordered, EVENT_LIMIT)).withColumn("closes", closes)
    reported = lambda name: N.market_value(meta[name])
    df = df.withColumn("price", F.coalesce(reported("regularMarketPrice"), F.try_element_at("closes", F.lit(-1)))).withColumn(
        "before", F.coalesce(F.try_element_at("closes", F.lit(-2)), reported("chartPreviousClose"), reported("previousClose")))
    df = df.withColumn("change", N.market_round(F.col("price") - F.col("before")))
    percent = F.when(F.col("before") != 0, N.market_round(F.col("change") / F.col("before") * 100, 6))
    name = F.coalesce(T.as_value(F.trim(meta["longName"])), T.as_value(F.trim(meta["shortName"])), F.col("symbol"))
    unit = let(T.as_value(F.trim(meta["currency"])), lambda c: F.when(c.rlike(r"^[A-Za-z0-9._-]{1,12}$"), c))
    exchange = F.coalesce(T.as_value(F.trim(meta["fullExchangeName"])), T.as_value(F.trim(meta["exchangeName"])))
    df = df.withColumns({"title": F.concat(name, F.lit(" ("), "symbol", F.lit(")")), "unit": unit, "percent": percent, "exchange": exchange,
                         "at": from_epoch_seconds(meta["regularMarketTime"]), "volume": N.as_count(meta["regularMarketVolume"])})
    df = df.withColumns({c: reported(n) for c, n in (("low", "regularMarketDayLow"), ("high", "regularMarketDayHigh"), ("year_low", "fiftyTwoWeekLow"), ("year_high", "fiftyTwoWeekHigh"))})
    # Grouped digits with up to six decimals, trailing zeros dropped.
    shown = lambda c: F.regexp_replace(F.regexp_replace(F.format_number(c.cast("double"), 6), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    cell = lambda c: F.coalesce(shown(c), F.lit("—"))
    suffix = F.coalesce(F.concat(F.lit(" "), e(F.col("unit"))), F.lit(""))
    signed = lambda c: F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), shown(c))
    span = lambda label, low, high: F.concat(F.lit(f"{label}: "), shown(F.col(low)), F.lit("–"), shown(F.col(high)), suffix)
    row = lambda p: F.concat(F.lit("| "), F.array_join(F.array(F.substring(p["timestamp"], 1, 10), *[cell(p[n]) for n in ("open", "high", "low", "close", "adjustedClose", "volume")]), " | "), F.lit(" |"))
    heading = "Recent daily prices" if (timeframe, interval) == ("1mo", "1d") else f"Price history ({timeframe}, {interval})"
    table = F.when(F.size("history") > 0, F.concat(
        F.lit(f"## {heading}\n\n| Date | Open | High | Low | Close | Adjusted close | Volume |\n| --- | ---: | ---: | ---: | ---: | ---: | ---: |\n"),
        F.array_join(F.transform("history", row), "\n")))
    told = F.transform("events", lambda v: F.concat(F.lit("- "), F.substring(v["timestamp"], 1, 10), F.when(
        v["type"] == "dividend", F.concat(F.lit(" — Dividend"), F.coalesce(F.concat(F.lit(": "), shown(v["amount"]), suffix), F.lit("")))).otherwise(
            F.concat(F.lit(" — Split"), F.coalesce(F.concat(F.lit(": "), e(v["splitRatio"])), F.lit(""))))))
    content = T.join_present(
        "\n\n", F.concat(F.lit("# "), e(F.col("title"))), F.concat(F.lit("Price: "), shown(F.col("price")), suffix),
        F.concat(F.lit("Change: "), signed(F.col("change")), F.lit(" ("), signed(F.col("percent")), F.lit("%)")), F.concat(F.lit("Exchange: "), e(F.col("exchange"))),
        F.concat(F.lit("Market time: "), iso(F.col("at"))), span("Day range", "low", "high"), span("52-week range", "year_low", "year_high"),
        F.concat(F.lit("Volume: "), shown(F.col("volume"))), table,
        F.when((F.size("history") > 0) & (F.size("events") > 0), F.concat(F.lit("## Market events\n"), F.array_join(told, "\n"))))
    return entity_rows(
        df, ["payload_id"], type="document", source=source, method="yahoo-finance-chart", id=F.col("symbol"),
        url=F.concat(F.lit("https://finance.yahoo.com/quote/"), F.url_encode("symbol"), F.lit("/")), title=F.col("title"), published_at=F.col("at"), content=content, attributes={
            "tickerSymbol": F.col("symbol"), "historyTimeframe": F.lit(timeframe), "historyInterval": F.lit(interval), "history": F.col("history"),
            "events": F.when(F.size("events") > 0, F.col("events")), "exchange": F.col("exchange"), "currency": F.col("unit"),
            "instrumentType": T.as_value(F.trim(meta["instrumentType"])), "marketPrice": F.col("price"), "previousClose": F.col("before"), "change": F.col("change"),
            "changePercent": F.col("percent"), "dayHigh": F.col("high"), "dayLow": F.col("low"), "fiftyTwoWeekHigh": F.col("year_high"), "fiftyTwoWeekLow": F.col("year_low"),
            "volume": F.col("volume"), "timezone": F.coalesce(T.as_value(F.trim(meta["exchangeTimezoneName"])), T.as_value(F.trim(meta["timezone"]))),
            "marketState": T.as_value(F.trim(meta["marketState"]))})


def normalize_app_charts(payloads: DataFrame) -> DataFrame:
    """The requested app's line in a chart of free or paid apps; `address` names the chart."""
    page = F.col("url")
    df = payloads.withColumn("wanted", U.app_store_id(page))
    found = F.get(F.filter(json_items(J("body", "$.feed.results")), lambda a: J(a, "$.id") == F.col("wanted")), F.lit(0))
    df = df.withColumn("app", found).withColumn("title", T.as_value(F.trim(J("app", "$.name")))).filter(F.col("title").isNotNull())
    author, free = T.as_value(F.trim(J("app", "$.artistName"))), F.col("address").contains("/top-free/")
    icon = U.public_url(J("app", "$.artworkUrl100"))
    return entity_rows(
        df, ["payload_id"], type="product", source="app-store", method="app-store-chart", id=F.col("wanted"), title=F.col("title"), author=author,
        url=F.regexp_replace(F.coalesce(U.public_url(J("app", "$.url")), page), r"[?#].*$", ""), published_at=parse_date(J("app", "$.releaseDate")),
        content=T.join_present("\n\n", F.concat(F.lit("# "), e(F.col("title"))), F.concat(F.lit("Developer: "), e(author)), F.when(free, F.lit("Price: Free"))),
        media=image(icon, F.concat("title", F.lit(" app icon"))), attributes={
            "productType": F.lit("software"), "brand": author, "availability": F.lit("available"), "priceDisplay": F.when(free, F.lit("Free"))})


def creator_posts(payloads: DataFrame) -> DataFrame:
    """Recent posts of the creator that an embed page shows, with what it says of the creator; a creator without posts has one row at position -1."""
    state = F.from_json(J(embedded_json(F.col("body"), "__FRONTITY_CONNECT_STATE__"), "$.source.data"), "map<string,string>")
    model = F.get(F.filter(F.map_values(state), lambda v: J(v, "$.userInfo").startswith("{") & J(v, "$.videoList").startswith("[")), F.lit(0))
    named = T.blank_to_null(F.regexp_extract(U.path(F.col("url")), r"^/@([^/]+)", 1))
    df = payloads.withColumn("model", model).filter(F.col("model").isNotNull()).withColumn("handle", F.coalesce(T.as_value(F.trim(J("model", "$.userInfo.uniqueId"))), named))
    shown = T.as_value(F.trim(J("model", "$.userInfo.nickname")))
    df = df.withColumn("author", F.when(shown.isNotNull(), F.concat(shown, F.lit(" (@"), "handle", F.lit(")"))).otherwise(F.concat(F.lit("@"), "handle")))
    count = lambda name: N.as_count(J("model", f"$.userInfo.{name}"))
    df = df.withColumn("profile", F.struct(
        F.coalesce(T.as_value(J("model", "$.userInfo.id")), F.col("handle")).alias("id"), F.col("handle"), F.coalesce(shown, F.concat(F.lit("@"), "handle")).alias("title"),
        F.col("author"), T.as_value(F.trim(J("model", "$.userInfo.signature"))).alias("biography"), U.public_url(J("model", "$.userInfo.avatarThumbUrl")).alias("avatar"),
        (J("model", "$.userInfo.verified") == "true").alias("verified"), count("followerCount").alias("followers"), count("followingCount").alias("following"),
        count("videoCount").alias("posts"), count("heartCount").alias("likes")))
    videos = F.slice(F.filter(json_items(J("model", "$.videoList")), lambda v: T.as_value(J(v, "$.id")).isNotNull()), 1, 10)
    rows = df.select("payload_id", F.col("url").alias("page_url"), "profile", F.posexplode_outer(videos).alias("position", "video"))
    rows = rows.withColumn("position", F.coalesce(F.col("position"), F.lit(-1)).cast("long"))
    v = F.col("video")
    target = F.concat(F.lit("https://www.tiktok.com/@"), "profile.handle", F.lit("/video/"), J(v, "$.id"))
    said = T.as_value(F.trim(J(v, "$.desc")))
    cover = F.coalesce(T.as_value(J(v, "$.coverUrl")), T.as_value(J(v, "$.originCoverUrl")), T.as_value(J(v, "$.dynamicCoverUrl")))
    return entity_rows(
        rows, ["payload_id", "page_url", "profile", "position"], type="post", source="tiktok", method="tiktok-profile-embed", id=J(v, "$.id"), url=target,
        title=F.coalesce(F.substring(T.as_value(T.first_line(said)), 1, 120), F.concat(F.lit("TikTok post by @"), "profile.handle")), author=F.col("profile.author"),
        content=T.join_present("\n\n", e(said), _link("View on TikTok", target)),
        media=image(cover, F.coalesce(said, F.lit("TikTok post")), N.as_positive(J(v, "$.width")), N.as_positive(J(v, "$.height"))),
        attributes={"handle": F.concat(F.lit("@"), "profile.handle"), "mediaType": F.lit("video"), "viewCount": N.as_count(J(v, "$.playCount"))})


def with_profile(payloads: DataFrame, posts: DataFrame) -> DataFrame:
    """Adds `profile` to the recent posts of a profile page; a profile without posts has one row at position -1."""
    context = J(context_json(F.col("body")), "$.context")
    df = payloads.withColumn("context", context).filter(F.col("context").isNotNull())
    handle = F.coalesce(T.as_value(F.trim(J("context", "$.username"))), U.last_segment(F.col("url")))
    shown = T.as_value(F.trim(J("context", "$.full_name")))
    count = lambda name: N.as_count(J("context", f"$.{name}"))
    flag = lambda *names: F.coalesce(*[F.when(J("context", f"$.{n}").isin("true", "false"), J("context", f"$.{n}") == "true") for n in names])
    known = df.select("payload_id", F.col("url").alias("page_url"), F.struct(
        handle.alias("id"), handle.alias("handle"), F.coalesce(shown, F.concat(F.lit("@"), handle)).alias("title"),
        F.when(shown.isNotNull(), F.concat(shown, F.lit(" (@"), handle, F.lit(")"))).otherwise(F.concat(F.lit("@"), handle)).alias("author"),
        F.lit(None).cast("string").alias("biography"), U.public_url(J("context", "$.profile_pic_url")).alias("avatar"), flag("verified", "is_verified").alias("verified"),
        count("followers_count").alias("followers"), F.lit(None).cast("long").alias("following"), count("posts_count").alias("posts"), F.lit(None).cast("long").alias("likes")).alias("profile"))
    return known.join(posts, "payload_id", "left").withColumn("position", F.coalesce("position", F.lit(-1).cast("long")))


ITEM = ("position", "type", "source", "id", "url", "title", "author", "publishedAt", "content", "media", "attributes")


def _gathered(items: DataFrame, keep: dict[str, Column], line: Callable[[Column], Column], separator: str) -> DataFrame:
    """One row per payload with its items in order: `body` (their lines joined), `n`, `first_at`, and the first value of the kept columns.

    The items of one payload come from one body, so a group is never larger than that.
    """
    rows = items.withColumn("_line", F.when(F.col("position") >= 0, line(F.struct(*items.columns))))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("position", "_line"))), lambda s: s["_line"])
    return rows.groupBy("payload_id").agg(
        F.array_join(lines, separator).alias("body"), F.count_if(F.col("position") >= 0).alias("n"), F.min_by("publishedAt", "position").alias("first_at"),
        *[F.first(c).alias(name) for name, c in keep.items()])


def _headed(label: str, level: str = "##") -> Callable[[Column], Column]:
    return lambda i: F.concat(F.lit(f"{level} ["), e(F.coalesce(i["title"], F.lit(label))), F.lit("]("), i["url"], F.lit(")"))


RULE = "\n\n---\n\n"


def _said(text: str, value: Column) -> Column:
    return F.concat(F.lit(text), value)


def feed_parents(items: DataFrame, kind: str) -> DataFrame:
    """Feeds and profiles as one row each, from the rows that the feed parsers give: kinds web, reddit, youtube, google-news, bluesky."""
    page = F.col("page_url")
    head = {c: F.col(c) for c in ("page_url", "feed_title", "feed_description", "feed_author", "feed_updated")}
    line = {
        "web": lambda i: T.join_present("\n\n", _headed("Entry")(i), T.as_value(i["content"])),
        "reddit": lambda i: T.join_present("\n\n", _headed("Untitled post")(i), _said("By ", e(i["author"])), T.as_value(i["content"])),
        "youtube": lambda i: T.join_present("\n\n", _headed("Untitled video")(i), _said("By ", e(i["author"])), T.as_value(i["content"])),
        "google-news": lambda i: T.join_present("\n\n", _headed("News article")(i), _said("Publisher: ", e(i["author"])), T.as_value(i["content"])),
        "bluesky": lambda i: T.join_present("\n\n", F.concat(F.lit("## [Post]("), i["url"], F.lit(")")), _said("Published ", i["publishedAt"]), T.as_value(i["content"])),
    }[kind]
    extra = {"by": F.col("author")} if kind == "bluesky" else {}
    df = _gathered(items, head | extra, line, RULE)
    query = T.as_value(T.collapse(U.parameter(page, "q")))
    listed, path = U.parameter(page, "list"), U.path(page)
    fallback = {"web": F.lit(None).cast("string"), "reddit": F.lit("Reddit feed"), "youtube": F.lit("YouTube feed"), "google-news": F.lit("Google News"),
                "bluesky": F.concat(F.lit("@"), U.bluesky_actor(page), F.lit(" - Bluesky"))}[kind]
    df = df.withColumn("title", F.coalesce("feed_title", fallback))
    intro = e(F.col("feed_description")) if kind == "bluesky" else F.lit(None).cast("string")
    content = T.join_present(RULE, T.as_value(T.join_present("\n\n", _said("# ", e(F.col("title"))), intro)), T.as_value(F.col("body")))
    topic = T.blank_to_null(F.regexp_extract(path, r"(?i)^/topics/([a-z0-9_-]+)/?$", 1))
    language = F.coalesce(F.when(U.parameter(page, "hl").rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), U.parameter(page, "hl")), F.lit("en-US"))
    country = F.coalesce(F.when(U.parameter(page, "gl").rlike(r"^[A-Za-z]{2}$"), F.upper(U.parameter(page, "gl"))), F.lit("US"))
    rules = {
        "web": dict(type="feed", source="web", method="discovered-feed", published_at=F.col("first_at").cast("timestamp"), attributes={"feedType": F.lit("publisher"), "description": F.col("feed_description")}),
        "reddit": dict(type="feed", source="reddit", method="reddit-rss", published_at=parse_date(F.col("feed_updated")), id=T.blank_to_null(F.regexp_extract(path, r"(?i)^/(?:r|u|user)/([^/]+)", 1)),
                       attributes={"feedType": F.when(path.rlike("(?i)/r/"), "community").otherwise("profile")}),
        "youtube": dict(type="feed", source="youtube", method="youtube-atom", published_at=parse_date(F.col("feed_updated")), author=F.col("feed_author"),
                        id=F.coalesce(listed, T.blank_to_null(F.regexp_extract(path, r"^/(?:channel|user)/([^/]+)", 1))),
                        attributes={"feedType": F.when(listed.isNotNull(), "playlist").otherwise("channel")}),
        "google-news": dict(type="feed", source="google-news", method="google-news-rss", published_at=F.col("first_at").cast("timestamp"), url=U.canonical_entity_url(page), id=F.coalesce(
            F.when(path.rlike(r"(?i)^/search/?$"), query), topic), attributes={
                "feedType": F.when(path.rlike(r"(?i)^/search/?$"), "search").when(topic.isNotNull(), "topic").otherwise("top_stories"),
                "query": F.when(path.rlike(r"(?i)^/search/?$"), query), "description": F.col("feed_description"), "language": language, "country": country}),
        "bluesky": dict(type="profile", source="bluesky", method="bluesky-rss", published_at=F.col("first_at").cast("timestamp"), id=U.bluesky_actor(page),
                        author=F.col("by") if kind == "bluesky" else None,
                        attributes={"handle": F.col("by") if kind == "bluesky" else F.lit(None), "biography": F.col("feed_description"), "postCount": F.col("n")}),
    }[kind]
    return entity_rows(df, ["payload_id"], title=F.col("title"), content=content, **({"url": page} | rules))


def profile_parents(items: DataFrame, source: str) -> DataFrame:
    """Creators as one row each, from their recent posts with `profile`: sources instagram, tiktok."""
    line = lambda i: T.join_present("\n\n", _headed("Post", "###")(i), _said("Published ", i["publishedAt"]), T.as_value(i["content"]))
    df = _gathered(items, {"profile": F.col("profile")}, line, "\n\n")
    p = F.col("profile")
    grouped = lambda c: F.format_number(c, 0)
    stats = T.join_present(" · ", _said("Followers: ", grouped(p["followers"])), _said("Following: ", grouped(p["following"])), _said("Posts: ", grouped(p["posts"])),
                           _said("Likes: ", grouped(p["likes"])))
    content = T.join_present("\n\n", _said("# ", e(p["author"])), e(p["biography"]), T.as_value(stats), F.when(F.col("n") > 0, F.lit("## Recent posts")), T.as_value(F.col("body")))
    home = F.concat(F.lit("https://www.instagram.com/"), p["handle"], F.lit("/")) if source == "instagram" else F.concat(F.lit("https://www.tiktok.com/@"), p["handle"])
    return entity_rows(
        df, ["payload_id"], type="profile", source=source, method="instagram-profile" if source == "instagram" else "tiktok-profile-embed", id=p["id"], url=home,
        title=p["title"], author=p["author"], published_at=F.col("first_at").cast("timestamp") if source == "instagram" else None, content=content, media=image(p["avatar"], p["author"]), attributes={
            "handle": F.concat(F.lit("@"), p["handle"]), "biography": p["biography"], "verified": p["verified"], "followerCount": p["followers"],
            "followingCount": p["following"], "postCount": p["posts"], "totalLikeCount": p["likes"]})


def marketplace_parents(items: DataFrame, kind: str) -> DataFrame:
    """Search results or a public list of a marketplace as one feed, from its cards."""
    page = F.col("page_url")
    line = lambda i: T.join_present("\n\n", F.concat(F.lit("## "), (i["position"] + 1).cast("string"), F.lit(". ["), e(i["title"]), F.lit("]("), i["url"], F.lit(")")), T.as_value(i["content"]))
    df = _gathered(items, {c: F.col(c) for c in ("page_url", "feed_title", "feed_author")}, line, "\n\n")
    asked, listed = U.product_search(page), U.product_list(page)
    if kind == "search":
        title, home, attributes = F.concat(F.lit("Amazon search: "), asked), F.concat(U.origin(page), F.lit("/s?k="), F.url_encode(asked)), {"feedType": F.lit("search"), "query": asked}
        by, name = None, None
    else:
        wish = listed["kind"] == "wishlist"
        title = F.coalesce("feed_title", F.when(wish, F.lit("Amazon Wish List")).otherwise(F.concat(F.lit("Amazon storefront: "), listed["id"])))
        home, attributes = F.concat(U.origin(page), U.path(page)), {"feedType": listed["kind"], "resultCount": F.col("n")}
        by, name = F.col("feed_author"), listed["id"]
    df = df.withColumn("_title", title)
    return entity_rows(
        df, ["payload_id"], type="feed", source="amazon", method=f"amazon-{kind}-html", id=name, url=home, title=F.col("_title"), author=by,
        content=T.join_present("\n\n", _said("# ", e(F.col("_title"))), F.col("body")), attributes=attributes)


def shop_parents(items: DataFrame, routes: DataFrame, source: str) -> DataFrame:
    """Shop answers: the product itself for a product address, else one feed of all products. `routes` has payload_id, url, route (kind, handle)."""
    known = items.withColumnRenamed("url", "_item").join(routes.select("payload_id", F.col("url").alias("page_url"), "route"), "payload_id").withColumnRenamed("_item", "url")
    single = known.filter((F.col("route.kind") == "product") & (F.col("position") == 0)).select("payload_id", *[c for c in items.columns if c not in ("payload_id", "position")])
    many = _gathered(known.filter(F.col("route.kind") != "product"), {"page_url": F.col("page_url"), "route": F.col("route")}, lambda i: i["content"], RULE)
    kind, handle = F.col("route.kind"), F.col("route.handle")
    titles = {
        "shopify": F.when(kind == "collection", "Shopify collection products").otherwise("Shopify products"),
        "woocommerce": F.when(kind == "search", F.concat(F.lit("Product results for "), handle)).when(kind == "category", F.lit("Product category")).otherwise("Store products")}
    many = many.withColumn("_title", titles[source])
    query = F.when(kind == "search", handle) if source == "woocommerce" else F.lit(None)
    feed = entity_rows(
        many, ["payload_id"], type="feed", source=source, method=f"{source}-json", id=handle if source == "shopify" else query, url=F.col("page_url"), title=F.col("_title"),
        published_at=F.col("first_at").cast("timestamp"), content=T.join_present(RULE, _said("# ", e(F.col("_title"))), F.col("body")),
        attributes={"feedType": kind, "query": query})
    return single.unionByName(feed)
