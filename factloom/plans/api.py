"""The nine public jobs over tables.

Every job takes tables of requests and of what an upstream would answer, so thousands of requests run as
one join. Items keep their rank in `pos`; `feeds` turns them into one row per request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import text as T
from factloom.operators import dispatch
from factloom.operators import feeds as FEEDS
from factloom.operators import market as M
from factloom.operators import places as P
from factloom.operators import search as S
from factloom.operators.joins import with_fallback
from factloom.operators.ordered import keep_first, top_k


def extract_url(
    requests: DataFrame, fetched: DataFrame, as_of: Column, focus: Column | None = None, rendered: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(entities, items): addresses of any kind to one entity or error code each, and the items of feeds, profiles and lists."""
    return dispatch.extract(requests, fetched, as_of, focus, rendered)


def search_web(queries: DataFrame, sources: Sequence[tuple[DataFrame, bool]], site: Column | None = None, limit: int = 10) -> DataFrame:
    """Ranked results per query. Later sources answer only queries that the earlier ones leave without a result.

    A source is (table of doc_id, url, title, content; whether it drops repeats before it tests relevance).
    The site filter is a column of `queries` or a constant.
    """
    levels = []
    for corpus, repeats_first in sources:
        rows = keep_first(corpus, ["url"], ["doc_id"]) if repeats_first else corpus
        found = S.relevance_join(queries, rows, F.concat_ws(" ", "title", "url", "content"))
        if site is not None:
            found = S.filter_site(found.join(queries.select("query_id", site.alias("_site")), "query_id"), F.col("_site")).drop("_site")
        levels.append(found if repeats_first else keep_first(found, ["query_id", "url"], ["doc_id"]))
    return S.rank_results(with_fallback(levels, "query_id"), limit)


def search_news(queries: DataFrame, articles: DataFrame, as_of: Column, timeframe: str = "any", limit: int = 10) -> DataFrame:
    """Articles of a query's feed within the timeframe, in feed order; `articles` has query_id, position, published_at."""
    rows = articles.join(queries.select("query_id"), "query_id", "left_semi")
    return top_k(S.filter_recent(rows, as_of, timeframe), ["query_id"], [F.col("position")], limit, "pos")


def search_images(catalogs: Sequence[DataFrame], usage: str = "all", orientation: str = "any", limit: int = 10) -> DataFrame:
    """Pictures that fit the licence and shape; a catalog serves the queries the one before could not."""
    levels = [S.filter_images(c, usage, orientation) for c in catalogs]
    return top_k(with_fallback(levels, "query_id"), ["query_id"], [F.col("position")], limit, "pos")


def search_videos(
    queries: DataFrame, primary: DataFrame, fallback: DataFrame, platform: str = "any", creator: str | None = None, sort: str = "relevance",
    as_of: Column | None = None, limit: int = 10,
) -> DataFrame:
    """Videos per query. Only the fallback is tested for relevance and platform; both for the creator.

    Tables have query_id, position, url, title, author, content, published_at, displayed_age.
    """
    terms = queries.select("query_id", T.query_terms(F.col("query")).alias("_terms"))
    words = T.tokens(F.concat_ws(" ", "title", "author", "url", "content"))
    relevant = fallback.join(terms, "query_id").filter(T.is_relevant(F.col("_terms"), words)).drop("_terms")
    levels = [S.filter_creator(primary, creator), S.filter_creator(S.filter_platform(relevant, platform), creator)]
    order = [F.col("position")]
    if sort == "date":
        order = S.newest_first(F.col("published_at"), F.col("displayed_age"), F.col("position"), as_of)
    return top_k(with_fallback(levels, "query_id"), ["query_id"], order, limit, "pos")


def search_places(queries: DataFrame, places: DataFrame, limit: int = 5) -> DataFrame:
    """Places of a query, nearest to its point first; `queries` has query_id, at_lat, at_lon."""
    return P.nearest(places, queries, "query_id", limit)


def search_stocks(queries: DataFrame, listings: DataFrame, instrument: str = "equity", limit: int = 10) -> DataFrame:
    """Listings that match a query by name or symbol."""
    return M.search_symbols(queries, listings, {"equity": "EQUITY", "crypto": "CRYPTOCURRENCY"}[instrument], limit)


def market_movers(quotes: DataFrame, which: str = "gainers", limit: int = 10) -> DataFrame:
    """One ranked list of the market."""
    return M.movers(quotes, which, limit)


def market_data(
    ticks: DataFrame, timeframe: str, as_of: Column, order: Sequence[str], fx: DataFrame | None = None, meta: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(history, snapshot) per symbol for a timeframe, converted when a rate series is given."""
    bars = M.price_history(ticks, timeframe, as_of, order)
    quotes = M.snapshot(bars, meta)
    if fx is None:
        return bars, quotes
    spot = fx.agg(F.max_by("close", "ts").alias("rate"))
    money = ["price", "previous_close", "change", "day_high", "day_low", "year_high", "year_low"]
    rated = quotes.withColumn("_one", F.lit(0)).join(F.broadcast(spot.withColumn("_one", F.lit(0))), "_one")  # one row
    converted = rated.select("symbol", "ts", "change_percent", "volume", *[M.market_round(F.col(c) * F.col("rate")).alias(c) for c in money], "rate")
    return M.convert_currency(bars, fx, ["open", "high", "low", "close"], "bar"), converted


def feeds(items: DataFrame, queries: DataFrame, title: str) -> DataFrame:
    """One feed per query: heading, numbered links and the number of results; queries without any get an empty feed.

    Items have query_id, pos, title, url, content.
    """
    line = FEEDS.numbered_link(F.col("pos"), F.coalesce("title", "url"), F.col("url"), F.col("content"))
    joined = FEEDS.assemble_feed(items, ["query_id"], "pos", line, separator="\n\n")
    head = F.concat(F.lit(f"# {title} results for "), T.escape_markdown(F.col("query")))
    return queries.join(joined, "query_id", "left").select(
        "query_id", "query", F.coalesce("result_count", F.lit(0)).alias("result_count"), F.concat_ws("\n\n", head, F.col("content")).alias("content"))
