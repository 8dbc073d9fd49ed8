"""Advertised and guessed alternate forms of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import html as H
from factloom.functions import rows_of
from factloom.functions import urls as U
from factloom.operators.ordered import keep_first

# Feeds of publishers that are known by host.
KNOWN_FEEDS = (
    ("openai.com", "https://openai.com/news/rss.xml"),
    ("www.openai.com", "https://openai.com/news/rss.xml"),
)
# Feed paths tried on publisher sites, in order.
COMMON_FEED_PATHS = ("/feed", "/rss.xml", "/feed.xml", "/atom.xml", "/feed.json")
MAX_GUESSES = 4


def alternate_links(pages: DataFrame) -> DataFrame:
    """The first WordPress, embed and feed link of every page, in that order: (page_id, kind, href, position)."""
    header = F.col("link_header") if "link_header" in pages.columns else F.lit(None).cast("string")
    links = F.concat(H.alternate_links(H.without_comments(F.col("html"))), H.header_links(header))
    kinds = F.transform(links, lambda l: F.struct(H.alternate_kind(l).alias("kind"), l["href"].alias("href")))
    first = lambda kind: F.get(F.filter(kinds, lambda l: F.coalesce(l["kind"] == kind, F.lit(False))), F.lit(0))
    chosen = F.filter(F.array(first("wordpress"), first("oembed"), first("feed")), lambda l: l.isNotNull())
    rows = rows_of(pages, ["page_id", "url"], chosen, "link")
    target = U.validate_url(U.absolute_url(F.col("link.href"), F.col("url")))["url"]
    return rows.select("page_id", "position", F.col("link.kind").alias("kind"), target.alias("href")).filter(
        F.col("href").isNotNull()
    )


def inferred_feeds(url: Column) -> Column:
    """Addresses where a publisher probably keeps its feed; at most four."""
    first = F.lower(F.get(U.segments(url), F.lit(0)))
    section = F.coalesce(first.isin(*U.BLOG_SECTIONS), F.lit(False))
    publisher = U.host(url).rlike(r"^(?:blog|news|press)\.")
    known = F.lit(None).cast("string")
    for name, feed in KNOWN_FEEDS:
        known = F.when(U.host(url) == name, F.lit(feed)).otherwise(known)
    at = lambda p: F.concat(U.origin(url), p)
    guesses = [
        known,
        F.when(section, at(F.concat(F.lit("/"), first, F.lit("/rss.xml")))),
        F.when(section, at(F.concat(F.lit("/"), first, F.lit("/feed")))),
        *[F.when(section | publisher, at(F.lit(p))) for p in COMMON_FEED_PATHS],
    ]
    return F.slice(F.array_distinct(F.array_compact(F.array(*guesses))), 1, MAX_GUESSES)


def match_feed_items(requested: DataFrame, items: DataFrame) -> DataFrame:
    """Each requested page with the first feed item on the same canonical address.

    `requested` has page_id, url; `items` has url, position and the item's columns.
    """
    keyed = keep_first(items.withColumn("url_key", U.canonical_url_key(F.col("url"))), ["url_key"], ["position"])
    wanted = requested.select("page_id", U.canonical_url_key(F.col("url")).alias("url_key"))
    return wanted.join(keyed, "url_key")
