"""Relevance join of a query table with a corpus, filters and per-query ranking.

A document is relevant when it holds a majority m of the n distinct query terms. A relevant document then
holds at least one of any n - m + 1 of them, so the join runs on the rarest terms only and the frequent
ones (the skewed keys) are never joined. Candidates are verified against all terms; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions import rows_of
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.operators.ordered import top_k

SALTS = 16

# Recency choices in seconds.
TIMEFRAME_SECONDS = {"1h": 3600, "1d": 86_400, "7d": 604_800, "30d": 2_592_000}


def relevance_join(queries: DataFrame, corpus: DataFrame, text: Column) -> DataFrame:
    """Relevant (query, document) pairs with `matched`, the number of query terms found.

    `queries` has query_id and query; `corpus` has doc_id and its other columns, which are kept.
    """
    asked = queries.select("query_id", T.query_terms(F.col("query")).alias("terms")).withColumn("needed", T.needed_matches(F.col("terms")))
    terms = asked.select("query_id", "needed", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # A frequent term stands in most documents: its rows are dealt out to salts by document, and what they meet is there once per salt.
    salted = lambda rows: rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    vocabulary = terms.select("term").distinct().select("term", salts.alias("_salt"))
    # One tokenization: every document with those of its tokens that some query asks for.
    tokens = rows_of(corpus, ["doc_id"], T.distinct_tokens(text), "term").drop("position")
    held = salted(tokens).join(vocabulary, ["term", "_salt"], "left_semi").groupBy("doc_id").agg(F.collect_set("term").alias("_held"))
    postings = held.select("doc_id", F.explode("_held").alias("term"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    rarest = Window.partitionBy("query_id").orderBy("docs", "term")
    # A document that holds enough of a query's terms holds one of its rarest.
    probes = (
        terms.join(frequency, "term", "left")
        .withColumn("docs", F.coalesce("docs", F.lit(0)))
        .withColumn("_rank", F.row_number().over(rarest))
        .filter((F.col("_rank") <= F.col("n_terms") - F.col("needed") + 1) & (F.col("docs") > 0))
        .select("term", "query_id", salts.alias("_salt"))
    )
    candidates = salted(postings).join(probes, ["term", "_salt"]).select("doc_id", "query_id").distinct()
    # The terms of a document meet those of the query in one row; no term is joined on again.
    found = candidates.join(held, "doc_id").join(asked, "query_id").withColumn("matched", F.size(F.array_intersect("_held", "terms")).cast("long"))
    return found.filter(F.col("matched") >= F.col("needed")).select("query_id", "doc_id", "matched").join(corpus, "doc_id")


def rank_results(matches: DataFrame, limit: int = 10, order: list[Column] | None = None) -> DataFrame:
    """Best `limit` rows per query: most terms matched first, then corpus position."""
    return top_k(matches, ["query_id"], order or [F.col("matched").desc(), F.col("doc_id")], limit, "pos")


def filter_recent(df: DataFrame, as_of: Column, timeframe: str, ts: str = "published_at") -> DataFrame:
    """Rows published within the timeframe, ends included; undated rows pass only `any`."""
    if timeframe == "any":
        return df
    return df.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {TIMEFRAME_SECONDS[timeframe]} SECONDS"))


def filter_site(df: DataFrame, site: Column, url: str = "url") -> DataFrame:
    return df.filter(U.matches_site(F.col(url), site))


def filter_platform(df: DataFrame, platform: str, url: str = "url") -> DataFrame:
    if platform == "any":
        return df
    name = U.host(F.col(url))
    return df.filter((name == "youtu.be") | (name == "youtube.com") | name.endswith(".youtube.com"))


def filter_creator(df: DataFrame, creator: str | None, author: str = "author") -> DataFrame:
    """Exact creator name after compatibility normalization."""
    if creator is None:
        return df
    return df.filter(T.creator_key(F.col(author)) == T.creator_key(F.lit(creator)))


def license_rights(license_name: Column, license_url: Column) -> Column:
    """struct(commercial, modify); an unknown licence grants nothing, public domain grants both."""
    text = F.lower(F.concat_ws(" ", license_name, license_url))
    known = F.trim(text) != ""
    free = text.rlike(r"cc0|pdm|public[ -]domain")
    return F.struct(
        (known & (free | ~text.rlike(r"by-?nc|licenses/[^/]*nc"))).alias("commercial"),
        (known & (free | ~text.rlike(r"by-?nd|licenses/[^/]*nd"))).alias("modify"),
    )


def filter_images(df: DataFrame, usage: str = "all", orientation: str = "any") -> DataFrame:
    """Licence and shape filter over columns license, license_url, orientation."""
    rights = license_rights(F.col("license"), F.col("license_url"))
    out = df if orientation == "any" else df.filter(F.col("orientation") == orientation)
    if usage in ("commercial", "commercial-and-modify"):
        out = out.filter(rights["commercial"])
    if usage in ("modify", "commercial-and-modify"):
        out = out.filter(rights["modify"])
    return out


def newest_first(published_at: Column, displayed: Column, position: Column, as_of: Column) -> list[Column]:
    """Sort columns: youngest first by date, else by displayed age; unknown ages last, ties by position."""
    from factloom.functions.dates import displayed_age_ms

    exact = F.greatest((F.unix_millis(as_of) - F.unix_millis(published_at)).cast("double"), F.lit(0.0))
    dated = F.when(published_at.isNotNull(), exact)
    return [F.coalesce(dated, displayed_age_ms(displayed)).asc_nulls_last(), position]
