"""Posts and profiles of public social payloads to entity rows.

Input rows have payload_id, url and body: JSON for threads, statuses and posts, markup for pages with an
embedded model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import let, rows_of
from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import from_epoch_seconds, parse_date
from factloom.functions.dom import fragment_markdown
from factloom.operators.listings import json_items
from factloom.sources.embeds import context_json, embedded_json, json_fields
from factloom.sources.entities import entity_rows, image, images

J = F.get_json_object
e = T.escape_markdown


def _count(*values: Column) -> Column:
    return F.coalesce(*[N.as_count(v) for v in values])


def _flag(*values: Column) -> Column:
    return F.coalesce(*[let(v, lambda v: F.when(v.isin("true", "false"), v == "true")) for v in values])


def _signed(name: Column, handle: Column) -> Column:
    """`Name (@handle)`, or only the handle."""
    return F.when(name.isNotNull(), F.concat(name, F.lit(" (@"), handle, F.lit(")"))).otherwise(F.concat(F.lit("@"), handle))


def _tags(names: Column, maximum: int = 50) -> Column:
    found = T.keep_first_distinct(F.transform(names, lambda n: F.regexp_replace(F.trim(n), "^#", "")), maximum)
    return let(found, lambda f: F.when(F.size(f) > 0, f))


def _link(label: str, url: Column) -> Column:
    return F.concat(F.lit(f"[{label}]("), url, F.lit(")"))


def media_kind(kinds: Column) -> Column:
    """`mixed` for several kinds, else the only one."""
    return let(F.array_distinct(kinds), lambda k: F.when(F.size(k) > 1, F.lit("mixed")).when(F.size(k) == 1, k[0]))


BLUESKY = (
    "author/handle", "author/displayName", "record/text", "record/createdAt", "record/facets", "record/tags", "embed/external/uri", "embed/external/title",
    "embed/external/description", "embed/images", "embed/playlist", "embed/record/record/value/text", "embed/record/record/author/handle",
    "likeCount", "replyCount", "repostCount", "quoteCount")


def normalize_bluesky(payloads: DataFrame) -> DataFrame:
    """Single posts of a thread payload, with quoted text, links and pictures in the content."""
    df, given = json_fields(payloads, F.col("body"), [f"thread/post/{path}" for path in BLUESKY])
    f, page = lambda path: given(f"thread/post/{path}"), F.col("url")
    df = df.withColumn("text", f("record/text")).filter(F.coalesce("text", F.lit("")) != "")
    df = df.withColumn("handle", F.coalesce(f("author/handle"), U.bluesky_actor(page))).withColumn("key", U.bluesky_post_key(page))
    df = df.withColumn("author", _signed(T.as_value(F.trim(f("author/displayName"))), F.col("handle"))).withColumn(
        "target", F.concat(F.lit("https://bsky.app/profile/"), F.url_encode("handle"), F.lit("/post/"), F.url_encode("key")))
    facets = F.flatten(F.transform(json_items(f("record/facets")), lambda f: F.transform(json_items(J(f, "$.features")), lambda x: J(x, "$.tag"))))
    uri = f("embed/external/uri")
    external = F.when(uri.isNotNull(), F.concat(F.lit("["), e(F.coalesce(T.as_value(f("embed/external/title")), uri)), F.lit("]("), uri, F.lit(")")))
    shown = F.array_join(F.filter(F.transform(json_items(f("embed/images")), lambda i: F.concat(
        F.lit("!["), e(F.coalesce(J(i, "$.alt"), F.lit("Post image"))), F.lit("]("), F.coalesce(J(i, "$.fullsize"), J(i, "$.thumb")), F.lit(")"))), lambda s: s.isNotNull()), "\n\n")
    quoted = f("embed/record/record/value/text")
    quoted_by = F.coalesce(F.concat(F.lit("@"), f("embed/record/record/author/handle")), F.lit("Quoted post"))
    quote = F.when(T.as_value(quoted).isNotNull(), F.concat(F.lit("> "), e(quoted_by), F.lit(": "), F.regexp_replace(e(quoted), "\n", "\n> ")))
    content = T.join_present(
        "\n\n", F.concat(F.lit("# Post by "), e(F.col("author"))), e(F.col("text")), external, e(T.as_value(f("embed/external/description"))), shown,
        _link("View attached video", f("embed/playlist")), quote, _link("View on Bluesky", F.col("target")))
    return entity_rows(
        df, ["payload_id"], type="post", source="bluesky", method="bluesky-api", id=F.col("key"), url=F.col("target"), title=F.concat(F.lit("Post by @"), "handle"),
        author=F.col("author"), published_at=parse_date(f("record/createdAt")), content=content, attributes={
            "handle": F.concat(F.lit("@"), "handle"), "hashtags": _tags(F.concat(json_items(f("record/tags")), facets)), "likeCount": _count(f("likeCount")),
            "replyCount": _count(f("replyCount")), "repostCount": _count(f("repostCount")), "quoteCount": _count(f("quoteCount"))})


MASTODON = (
    "id", "url", "content", "spoiler_text", "created_at", "account/acct", "account/display_name", "media_attachments", "tags",
    "favourites_count", "replies_count", "reblogs_count")


def normalize_mastodon(payloads: DataFrame) -> DataFrame:
    """Status payloads with their attachments and content warning."""
    df, f = json_fields(payloads, F.col("body"), MASTODON)
    page = F.col("url")
    df = df.withColumn("markdown", fragment_markdown(f("content"), page)).filter(F.coalesce("markdown", F.lit("")) != "")
    account = T.as_value(F.trim(f("account/acct")))
    df = df.withColumn("handle", F.when(account.contains("@"), account).otherwise(F.concat(account, F.lit("@"), U.host(page)))).withColumn(
        "author", _signed(T.as_value(F.trim(f("account/display_name"))), F.col("handle")))
    attached = F.filter(F.transform(json_items(f("media_attachments")), lambda m: F.struct(
        F.when(J(m, "$.type") == "gifv", F.lit("video")).otherwise(J(m, "$.type")).alias("type"),
        F.coalesce(T.as_value(J(m, "$.url")), T.as_value(J(m, "$.preview_url"))).alias("url"), T.as_value(F.trim(J(m, "$.description"))).alias("alt"),
        F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))), lambda m: m["url"].isNotNull() & m["type"].isin("image", "video", "audio"))
    df = df.withColumn("attached", attached)
    described = F.filter(F.transform(json_items(f("media_attachments")), lambda m: T.as_value(F.trim(J(m, "$.description")))), lambda d: d.isNotNull())
    warning = T.as_value(F.trim(f("spoiler_text")))
    notes = F.when(F.size(described) > 0, F.concat(F.lit("Media descriptions:\n\n"), F.array_join(F.transform(described, lambda d: F.concat(F.lit("- "), e(d))), "\n")))
    return entity_rows(
        df, ["payload_id"], type="post", source="mastodon", method="mastodon-oembed", id=F.coalesce(T.as_value(f("id")), T.blank_to_null(F.regexp_extract(page, r"/(\d+)/?$", 1))),
        url=F.coalesce(T.as_value(f("url")), page), title=F.concat(F.lit("Mastodon post by @"), "handle"), author=F.col("author"), published_at=parse_date(f("created_at")),
        content=T.join_present("\n\n", F.concat(F.lit("# Mastodon post by "), e(F.col("author"))), F.concat(F.lit("Content warning: "), e(warning)), F.col("markdown"), notes,
                               _link("View on Mastodon", page)),
        media=F.col("attached"), attributes={
            "handle": F.concat(F.lit("@"), "handle"), "contentWarning": warning,
            "mediaType": F.when(F.size("attached") > 1, F.lit("mixed")).otherwise(F.get("attached", F.lit(0))["type"]),
            "hashtags": _tags(F.transform(json_items(f("tags")), lambda t: J(t, "$.name"))), "likeCount": _count(f("favourites_count")),
            "replyCount": _count(f("replies_count")), "repostCount": _count(f("reblogs_count"))})


X = (
    "text", "created_at", "lang", "user/screen_name", "user/name", "user/profile_image_url_https", "user/verified", "user/is_blue_verified", "isEdited", "possibly_sensitive",
    "in_reply_to_screen_name", "in_reply_to_status_id_str", "quoted_tweet/user/screen_name", "quoted_tweet/id_str", "entities/hashtags", "mediaDetails",
    "favorite_count", "conversation_count", "retweet_count", "quote_count", "view_count", "views/count")


def normalize_x(payloads: DataFrame) -> DataFrame:
    """Syndicated post payloads."""
    df, f = json_fields(payloads, F.col("body"), X)
    df = df.withColumn("id", U.tweet_id(F.col("url"))).withColumn("user", f("user/screen_name")).filter(F.col("user").isNotNull() & F.col("id").isNotNull())
    target = F.concat(F.lit("https://x.com/i/status/"), "id")
    author = _signed(f("user/name"), F.col("user"))
    raw = json_items(f("mediaDetails"))
    pictures = F.slice(F.filter(F.transform(raw, lambda m: F.struct(
        J(m, "$.media_url_https").alias("url"), F.coalesce(T.as_value(F.trim(J(m, "$.ext_alt_text"))), F.lit("Post image")).alias("alt"),
        N.as_positive(J(m, "$.original_info.width")).alias("width"), N.as_positive(J(m, "$.original_info.height")).alias("height"))), lambda m: m["url"].isNotNull()), 1, 20)
    kinds = F.transform(raw, lambda m: F.when(J(m, "$.type") == "photo", "image").when(J(m, "$.type").isin("video", "animated_gif"), J(m, "$.type")))
    kind = media_kind(kinds)
    status = lambda user, ref: F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), ref)
    attached = F.array_join(F.transform(raw, lambda m: F.when(
        J(m, "$.type") == "photo", F.concat(F.lit("!["), e(F.coalesce(T.as_value(J(m, "$.ext_alt_text")), F.lit("Tweet image"))), F.lit("]("), J(m, "$.media_url_https"), F.lit(")"))
    ).otherwise(F.concat(F.lit("[View attached "), F.when(J(m, "$.type") == "video", "video").otherwise("animation"), F.lit("]("), J(m, "$.expanded_url"), F.lit(")")))), "\n\n")
    return entity_rows(
        df, ["payload_id"], type="post", source="x", method="react-tweet", id=F.col("id"), url=target, title=F.concat(F.lit("Post by @"), "user"), author=author,
        published_at=parse_date(f("created_at")), media=images(pictures),
        content=T.join_present("\n\n", F.concat(F.lit("# Post by "), e(author)), e(f("text")), attached, _link("View on X", target)), attributes={
            "handle": F.concat(F.lit("@"), "user"), "authorImageUrl": f("user/profile_image_url_https"), "language": T.as_value(f("lang")),
            "verified": F.coalesce(_flag(f("user/verified")), F.lit(False)) | F.coalesce(_flag(f("user/is_blue_verified")), F.lit(False)),
            "edited": F.coalesce(_flag(f("isEdited")), F.lit(False)), "sensitive": _flag(f("possibly_sensitive")),
            "inReplyToUrl": status(F.coalesce(f("in_reply_to_screen_name"), F.lit("i")), f("in_reply_to_status_id_str")),
            "quotedPostUrl": status(f("quoted_tweet/user/screen_name"), f("quoted_tweet/id_str")),
            "hashtags": _tags(F.transform(json_items(f("entities/hashtags")), lambda h: J(h, "$.text"))), "likeCount": _count(f("favorite_count")),
            "replyCount": _count(f("conversation_count")), "repostCount": _count(f("retweet_count")), "quoteCount": _count(f("quote_count")),
            "viewCount": _count(f("view_count"), f("views/count")), "mediaType": F.when(kind == "animated_gif", F.lit("video")).otherwise(kind)})


TIKTOK = (
    "id", "desc", "createTime", "author/uniqueId", "author/nickname", "challenges", "textExtra", "video/duration", "video/cover", "video/originCover", "video/dynamicCover",
    "music/title", "music/authorName", *[f"{kind}/{n}" for kind in ("stats", "statsV2") for n in ("diggCount", "commentCount", "shareCount", "playCount")])


def normalize_tiktok(payloads: DataFrame) -> DataFrame:
    """Video pages with a hydration script."""
    item = "__DEFAULT_SCOPE__/webapp.video-detail/itemInfo/itemStruct"
    df, given = json_fields(payloads, embedded_json(F.col("body"), "__UNIVERSAL_DATA_FOR_REHYDRATION__"), [f"{item}/{path}" for path in TIKTOK])
    f = lambda path: given(f"{item}/{path}")
    df = df.withColumn("id", T.as_value(f("id"))).withColumn("user", T.as_value(f("author/uniqueId"))).filter(F.col("id").isNotNull() & F.col("user").isNotNull())
    photo = F.col("url").rlike(r"(?i)/photo/\d+/?(?:[?#]|$)")
    target = F.concat(F.lit("https://www.tiktok.com/@"), "user", F.when(photo, F.lit("/photo/")).otherwise(F.lit("/video/")), "id")
    author = _signed(T.as_value(F.trim(f("author/nickname"))), F.col("user"))
    described = T.as_value(F.trim(f("desc")))
    seconds = let(N.as_number(f("video/duration")), lambda s: F.when(s > 0, s))
    tags = _tags(F.concat(F.transform(json_items(f("challenges")), lambda c: J(c, "$.title")), F.transform(json_items(f("textExtra")), lambda x: J(x, "$.hashtagName"))), 1000)
    cover = F.coalesce(T.as_value(f("video/cover")), T.as_value(f("video/originCover")), T.as_value(f("video/dynamicCover")))
    sound = T.join_present(" — ", T.as_value(f("music/title")), T.as_value(f("music/authorName")))
    stat = lambda n: _count(f(f"stats/{n}"), f(f"statsV2/{n}"))
    content = T.join_present(
        "\n\n", F.concat(F.lit("# TikTok post by "), e(author)), e(described), F.concat(F.lit("Duration: "), F.regexp_replace(seconds.cast("string"), r"\.0$", ""), F.lit(" seconds")),
        F.when(T.as_value(f("music/title")).isNotNull(), F.concat(F.lit("Sound: "), e(sound))),
        F.concat(F.lit("Hashtags: "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), e(t))), ", ")), _link("View on TikTok", target))
    return entity_rows(
        df, ["payload_id"], type="post", source="tiktok", method="tiktok-hydration", id=F.col("id"), url=target, title=F.concat(F.lit("TikTok post by @"), "user"), author=author,
        published_at=from_epoch_seconds(let(N.as_number(f("createTime")), lambda s: F.when(s > 0, s))), content=content,
        media=image(cover, F.coalesce(described, F.lit("TikTok post"))), attributes={
            "handle": F.concat(F.lit("@"), "user"), "mediaType": F.when(photo, F.lit("image")).otherwise(F.lit("video")), "durationSeconds": F.floor(seconds + 0.5),
            "hashtags": tags, "likeCount": stat("diggCount"), "replyCount": stat("commentCount"), "shareCount": stat("shareCount"), "viewCount": stat("playCount")})


def normalize_tiktok_profiles(payloads: DataFrame) -> DataFrame:
    """Profile pages with a hydration script."""
    scope = embedded_json(F.col("body"), "__UNIVERSAL_DATA_FOR_REHYDRATION__")
    df = payloads.withColumn("info", J(scope, "$.__DEFAULT_SCOPE__['webapp.user-detail'].userInfo")).withColumn("user", T.as_value(J("info", "$.user.uniqueId"))).filter(F.col("user").isNotNull())
    info = F.col("info")
    name = T.as_value(F.trim(J(info, "$.user.nickname")))
    target = F.concat(F.lit("https://www.tiktok.com/@"), "user")
    bio, link = T.as_value(F.trim(J(info, "$.user.signature"))), U.public_url(J(info, "$.user.bioLink.link"))
    author = _signed(name, F.col("user"))
    return entity_rows(
        df, ["payload_id"], type="profile", source="tiktok", method="tiktok-hydration", id=F.coalesce(T.as_value(J(info, "$.user.id")), F.col("user")), url=target,
        title=F.coalesce(name, F.concat(F.lit("@"), "user")), author=author, media=image(T.as_value(J(info, "$.user.avatarLarger")), author),
        content=T.join_present("\n\n", F.concat(F.lit("# "), e(author)), e(bio), _link("Profile link", link), _link("View on TikTok", target)), attributes={
            "handle": F.concat(F.lit("@"), "user"), "biography": bio, "followerCount": _count(J(info, "$.stats.followerCount")),
            "followingCount": _count(J(info, "$.stats.followingCount")), "postCount": _count(J(info, "$.stats.videoCount"))})


INSTAGRAM = (
    "__typename", "shortcode", "is_video", "owner/username", "owner/is_verified", "owner/verified", "taken_at_timestamp", "taken_at", "location/name", "coauthor_producers",
    "is_paid_partnership", "edge_media_preview_like/count", "edge_liked_by/count", "edge_media_to_parent_comment/count", "edge_media_to_comment/count", "video_view_count",
    "video_play_count", "edge_sidecar_to_children/edges", "edge_media_to_caption/edges", "display_url", "thumbnail_src", "accessibility_caption", "dimensions/width", "dimensions/height")


def _instagram_attributes(f: Callable[[str], Column], tags: Column) -> dict[str, Column]:
    places = T.as_value(F.trim(f("location/name")))
    co = T.keep_first_distinct(F.transform(json_items(f("coauthor_producers")), lambda c: F.concat(F.lit("@"), T.as_value(J(c, "$.username")))), 20)
    return {
        "verified": _flag(f("owner/is_verified"), f("owner/verified")), "hashtags": let(tags, lambda t: F.when(F.size(t) > 0, t)),
        "coauthors": let(co, lambda c: F.when(F.size(c) > 0, c)), "locationName": places, "sponsored": _flag(f("is_paid_partnership")),
        "likeCount": _count(f("edge_media_preview_like/count"), f("edge_liked_by/count")),
        "replyCount": _count(f("edge_media_to_parent_comment/count"), f("edge_media_to_comment/count")), "viewCount": _count(f("video_view_count"), f("video_play_count"))}


def _instagram_media(f: Callable[[str], Column], fallback: Column) -> Column:
    children = F.transform(json_items(f("edge_sidecar_to_children/edges")), lambda c: J(c, "$.node"))
    shown = lambda get: F.struct(
        U.public_url(F.coalesce(get("display_url"), get("thumbnail_src"))).alias("url"), F.coalesce(T.as_value(F.trim(get("accessibility_caption"))), fallback).alias("alt"),
        N.as_positive(get("dimensions/width")).alias("width"), N.as_positive(get("dimensions/height")).alias("height"))
    many = F.transform(children, lambda c: shown(lambda path: J(c, "$." + path.replace("/", "."))))
    rows = F.when(F.size(children) > 0, many).otherwise(F.array(shown(f)))
    keep = let(rows, lambda r: F.filter(r, lambda x, i: x["url"].isNotNull() & (F.array_position(F.transform(r, lambda y: y["url"]), x["url"]) == i + 1)))
    return images(F.slice(keep, 1, 20))


def _caption(f: Callable[[str], Column]) -> Column:
    return T.as_value(F.trim(J(f("edge_media_to_caption/edges"), "$[0].node.text")))


def normalize_instagram(payloads: DataFrame) -> DataFrame:
    """Post pages with an embedded model."""
    df, given = json_fields(payloads, context_json(F.col("body")), [f"gql_data/shortcode_media/{path}" for path in INSTAGRAM])
    f, page = lambda path: given(f"gql_data/shortcode_media/{path}"), F.col("url")
    df = df.withColumn("caption", _caption(f)).withColumn("user", T.as_value(f("owner/username")))
    df = df.filter(F.coalesce("user", "caption").isNotNull())
    author = F.concat(F.lit("@"), "user")
    kind = f("__typename")
    target = U.canonical_entity_url(page)
    children = F.size(json_items(f("edge_sidecar_to_children/edges")))
    shown = F.when(kind == "GraphSidecar", F.concat(F.lit("Media: "), F.when(children > 0, children.cast("string")).otherwise(F.lit("multiple")), F.lit(" carousel items"))).when(
        kind == "GraphVideo", F.lit("Media: video")).when(kind == "GraphImage", F.lit("Media: image"))
    by = F.when(author.isNotNull(), F.concat(F.lit(" by "), e(author))).otherwise(F.lit(""))
    return entity_rows(
        df, ["payload_id"], type="post", source="instagram", method="instagram-embed", id=U.instagram_shortcode(page), url=target,
        title=F.when(author.isNotNull(), F.concat(F.lit("Instagram post by "), author)).otherwise(F.lit("Instagram post")), author=author,
        published_at=from_epoch_seconds(F.coalesce(f("taken_at_timestamp"), f("taken_at"))),
        content=T.join_present("\n\n", F.concat(F.lit("# Instagram post"), by), e(F.col("caption")), shown, _link("View on Instagram", target)),
        media=_instagram_media(f, F.coalesce("caption", F.lit("Instagram post"))), attributes={
            "handle": author, "mediaType": F.when(kind == "GraphSidecar", "carousel").when(kind == "GraphVideo", "video").when(kind == "GraphImage", "image"),
            **_instagram_attributes(f, T.hashtags(F.coalesce("caption", F.lit(""))))})


def instagram_profile_posts(payloads: DataFrame) -> DataFrame:
    """Recent posts embedded in profile pages."""
    context = J(context_json(F.col("body")), "$.context")
    df = payloads.withColumn("context", context).filter(F.col("context").isNotNull()).withColumn("handle", F.coalesce(T.as_value(J("context", "$.username")), U.last_segment(F.col("url"))))
    df = df.withColumn("author", _signed(T.as_value(F.trim(J("context", "$.full_name"))), F.col("handle")))
    rows = rows_of(df, ["payload_id", "handle", "author"], F.transform(json_items(J("context", "$.graphql_media")), lambda m: J(m, "$.shortcode_media")), "node")
    rows, f = json_fields(rows, F.col("node"), INSTAGRAM)
    rows = rows.withColumn("code", T.as_value(f("shortcode"))).filter(F.col("code").isNotNull()).withColumn("caption", _caption(f))
    video = F.coalesce(f("is_video") == "true", F.lit(False)) | F.coalesce(f("__typename") == "GraphVideo", F.lit(False))
    target = F.concat(F.lit("https://www.instagram.com/"), F.when(video, "reel").otherwise("p"), F.lit("/"), "code", F.lit("/"))
    return entity_rows(
        rows, ["payload_id", "position"], type="post", source="instagram", method="instagram-profile", id=F.col("code"), url=target,
        title=T.as_value(T.first_line(F.col("caption"))), author=F.col("author"), published_at=from_epoch_seconds(f("taken_at_timestamp")),
        content=F.coalesce(e(F.col("caption")), _link("View on Instagram", target)), media=_instagram_media(f, F.coalesce("caption", F.lit("Instagram post"))),
        attributes={"handle": F.concat(F.lit("@"), "handle"), "mediaType": F.when(video, "video").otherwise("image"), **_instagram_attributes(f, T.hashtags(F.coalesce("caption", F.lit(""))))})
