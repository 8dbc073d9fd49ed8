"""RSS, Atom and JSON feeds to item rows.

Input rows have payload_id, url and body. Items keep the position of the feed, and a feed shows at most 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import let, rows_of
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.functions.dates import parse_date
from factloom.functions.dom import fragment_markdown
from factloom.operators.ordered import keep_first
from factloom.sources.entities import entity_rows, image

MAX_ENTRIES = 50
_LINKS = "array<struct<_href:string,_rel:string,_VALUE:string>>"
_TEXT = "struct<_VALUE:string>"
_ENTRY = (
    "title:string,guid:struct<_VALUE:string>,id:string,description:string,`content:encoded`:string,content:string,summary:string,author:string,"
    "pubDate:string,published:string,updated:string,source:struct<_VALUE:string,_url:string>,`yt:videoId`:string,"
    "`media:group`:struct<`media:title`:string,`media:description`:string,`media:thumbnail`:array<struct<_url:string>>>"
)
XML_SCHEMA = (
    f"channel struct<title:string,description:string,lastBuildDate:string,item:array<struct<link:string,{_ENTRY}>>>, title string, "
    f"subtitle string, author string, updated string, entry array<struct<link:{_LINKS},{_ENTRY}>>"
)
JSON_SCHEMA = (
    "version string, title string, description string, items array<struct<id:string,url:string,external_url:string,title:string,"
    "content_html:string,content_text:string,summary:string,authors:array<struct<name:string>>,author:struct<name:string>,"
    "date_published:string,date_modified:string>>"
)


def _trimmed(c: Column) -> Column:
    return T.as_value(F.trim(c))


def _author(c: Column) -> Column:
    """An author is a text or an element with a name."""
    return let(c, lambda a: F.coalesce(_trimmed(F.regexp_extract(a, "(?s)<name>(.*?)</name>", 1)), _trimmed(F.regexp_replace(a, "<[^>]*>", ""))))


def read_xml(payloads: DataFrame) -> DataFrame:
    """Adds `xml`; bodies that are no feed get null there."""
    return payloads.withColumn("xml", F.from_xml("body", XML_SCHEMA, {"mode": "PERMISSIVE"}))


def xml_items(payloads: DataFrame, limit: int = MAX_ENTRIES) -> DataFrame:
    """Raw entries of RSS and Atom feeds: payload_id, page_url, what the feed says of itself, position, entry fields."""
    df = read_xml(payloads)

    def shared(e: Column, kind: str, link: Column) -> Column:
        return F.struct(
            link.alias("link"), _trimmed(e["guid"]["_VALUE"]).alias("guid"), _trimmed(e["id"]).alias("entry_id"), _trimmed(e["title"]).alias("title"),
            F.coalesce(T.as_value(e["content:encoded"]), T.as_value(e["content"]), T.as_value(e["description"]), T.as_value(e["summary"])).alias("raw"),
            _author(e["author"]).alias("author"),
            F.coalesce(T.as_value(e["pubDate"]), T.as_value(e["published"]), T.as_value(e["updated"])).alias("date"),
            _trimmed(e["source"]["_VALUE"]).alias("publisher"), _trimmed(e["source"]["_url"]).alias("publisher_url"),
            e["yt:videoId"].alias("video_id"), _trimmed(e["media:group"]["media:title"]).alias("media_title"),
            _trimmed(e["media:group"]["media:description"]).alias("media_description"),
            F.get(e["media:group"]["media:thumbnail"], F.lit(0))["_url"].alias("thumbnail"), F.lit(kind).alias("kind"))

    def atom_link(e: Column) -> Column:
        usual = F.filter(e["link"], lambda l: F.coalesce(l["_rel"] == "alternate", F.lit(True)))
        chosen = F.coalesce(F.get(usual, F.lit(0)), F.get(e["link"], F.lit(0)))
        return let(chosen, lambda l: F.coalesce(_trimmed(l["_href"]), _trimmed(l["_VALUE"])))

    rss = F.transform(F.slice("xml.channel.item", 1, limit), lambda e: shared(e, "rss", F.coalesce(_trimmed(e["link"]), _trimmed(e["guid"]["_VALUE"]))))
    atom = F.transform(F.slice("xml.entry", 1, limit), lambda e: shared(e, "atom", F.coalesce(atom_link(e), _trimmed(e["guid"]["_VALUE"]))))
    title = F.coalesce(_trimmed(F.col("xml.channel.title")), _trimmed(F.col("xml.title")))
    described = F.coalesce(_trimmed(F.col("xml.channel.description")), _trimmed(F.col("xml.subtitle")))
    head = ["payload_id", F.col("url").alias("page_url"), title.alias("feed_title"), described.alias("feed_description"),
            _author(F.col("xml.author")).alias("feed_author"), _trimmed(F.col("xml.updated")).alias("feed_updated")]
    return rows_of(df, head, F.coalesce(rss, atom), "entry").select(*KEEP, "entry.*")


def _with_markdown(df: DataFrame, raw: str, base: str) -> DataFrame:
    """Content as Markdown, or the escaped text when the markup holds none."""
    written = F.coalesce(T.as_value(fragment_markdown(F.col(raw), F.col(base))), T.escape_markdown(F.coalesce(F.col(raw), F.lit(""))))
    return df.withColumn("content", written)


KEEP = ["payload_id", "page_url", "feed_title", "feed_description", "feed_author", "feed_updated", "position"]


def parse_xml_feeds(payloads: DataFrame) -> DataFrame:
    """Publisher RSS and Atom feeds as article rows."""
    items = xml_items(payloads).withColumn("item_url", F.coalesce("link", "page_url"))
    return entity_rows(
        _with_markdown(items, "raw", "item_url"), KEEP, type="article", source="web", method="discovered-feed", url=F.col("item_url"),
        id=F.col("guid"), title=F.col("title"), author=F.col("author"), published_at=parse_date(F.col("date")), content=F.col("content"))


def parse_json_feeds(payloads: DataFrame) -> DataFrame:
    """JSON feeds as article rows; other JSON has none."""
    df = payloads.withColumn("feed", F.from_json("body", JSON_SCHEMA))
    known = df.filter(F.col("feed.version").startswith("https://jsonfeed.org/version/"))
    none = F.lit(None).cast("string")
    head = ["payload_id", F.col("url").alias("page_url"), _trimmed(F.col("feed.title")).alias("feed_title"),
            _trimmed(F.col("feed.description")).alias("feed_description"), none.alias("feed_author"), none.alias("feed_updated")]
    rows = rows_of(known, head, F.slice("feed.items", 1, MAX_ENTRIES), "e")
    rows = rows.withColumn("item_url", F.coalesce("e.url", "e.external_url", "page_url"))
    plain = T.escape_markdown(F.coalesce("e.content_text", "e.summary", F.lit("")))
    markup = fragment_markdown(F.col("e.content_html"), F.col("item_url"))
    first = F.coalesce(F.get("e.authors", F.lit(0))["name"], F.when(F.col("e.authors").isNull(), F.col("e.author.name")))
    return entity_rows(
        rows, KEEP, type="article", source="web", method="discovered-feed", url=F.col("item_url"), id=F.col("e.id"), title=_trimmed(F.col("e.title")),
        author=_trimmed(first), published_at=parse_date(F.coalesce("e.date_published", "e.date_modified")),
        content=F.when(F.col("e.content_html").isNotNull(), markup).otherwise(plain))


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """Feeds of either form, told apart by their first character."""
    is_json = F.coalesce(F.substring(F.ltrim("body"), 1, 1).isin("{", "["), F.lit(False))
    return parse_json_feeds(payloads.filter(is_json)).unionByName(parse_xml_feeds(payloads.filter(~is_json)))


def parse_search_results(payloads: DataFrame) -> DataFrame:
    """Search index results: absolute web links only, the first of each per query (payload_id is the query)."""
    items = xml_items(payloads, 1_000_000).withColumn("result_url", U.public_url(F.col("link"))).filter(F.col("result_url").isNotNull())
    first = keep_first(items, ["payload_id", "result_url"], ["position"])
    title = F.coalesce(T.as_value(T.strip_tags(F.col("title"))), F.regexp_replace(U.host(F.col("result_url")), r"^www\.", ""))
    return entity_rows(
        first, ["payload_id", "position"], type="document", source="web-search", method="web-search-rss", url=F.col("result_url"), title=title,
        content=T.strip_tags(F.coalesce("raw", F.lit(""))))


def parse_news_feeds(payloads: DataFrame) -> DataFrame:
    """News results with their publisher."""
    link = F.coalesce(U.public_url(F.col("link")), U.public_url(F.col("guid")))
    items = xml_items(payloads).withColumn("item_url", link).filter(F.col("item_url").isNotNull() & F.col("title").isNotNull())
    return entity_rows(
        _with_markdown(items, "raw", "item_url"), KEEP, type="article", source="google-news", method="google-news-rss", url=F.col("item_url"),
        id=F.coalesce("guid", "item_url"), title=F.col("title"), author=F.col("publisher"), published_at=parse_date(F.col("date")),
        content=F.col("content"), attributes={"publisher": F.col("publisher"), "publisherUrl": U.public_url(F.col("publisher_url"))})


def parse_community_feeds(payloads: DataFrame) -> DataFrame:
    """Community posts of an Atom feed."""
    items = xml_items(payloads, 1_000_000).withColumn("item_url", F.coalesce("link", "page_url"))
    return entity_rows(
        _with_markdown(items, "raw", "item_url"), KEEP, type="post", source="reddit", method="reddit-rss", url=F.col("item_url"),
        id=T.blank_to_null(F.regexp_extract("item_url", r"(?i)/comments/([a-z0-9]+)", 1)), title=F.col("title"), author=F.col("author"),
        published_at=parse_date(F.col("date")), content=F.col("content"), attributes={"handle": F.col("author")})


def parse_video_feeds(payloads: DataFrame) -> DataFrame:
    """Videos of a channel or playlist feed."""
    items = xml_items(payloads, 1_000_000).withColumn(
        "item_url", F.coalesce("link", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id")))
    title = F.coalesce("media_title", "title")
    picture = F.concat(F.lit("![Video thumbnail]("), "thumbnail", F.lit(")"))
    return entity_rows(
        items, KEEP, type="video", source="youtube", method="youtube-atom", url=F.col("item_url"),
        id=F.coalesce(F.col("video_id"), U.youtube_id(F.col("item_url"))), title=title, author=F.col("author"), published_at=parse_date(F.col("date")),
        content=T.join_present("\n\n", T.escape_markdown(F.col("media_description")), picture),
        media=image(F.col("thumbnail"), F.coalesce(title, F.lit("Video thumbnail"))))


def parse_profile_feeds(payloads: DataFrame) -> DataFrame:
    """Posts of a profile feed; the author is named by the feed title."""
    items = xml_items(payloads, 1_000_000).withColumn("item_url", F.coalesce("link", "page_url"))
    actor = F.coalesce(T.blank_to_null(F.regexp_extract("feed_title", r"^(?i)(@.+?)\s+-\s+Bluesky$", 1)), F.concat(F.lit("@"), U.bluesky_actor(F.col("page_url"))))
    return entity_rows(
        items, KEEP, type="post", source="bluesky", method="bluesky-rss", url=F.col("item_url"),
        id=T.blank_to_null(F.regexp_extract("item_url", r"/post/([^/?#]+)", 1)), author=actor, published_at=parse_date(F.col("date")),
        content=T.escape_markdown(F.coalesce("raw", F.lit(""))), attributes={"handle": actor})
