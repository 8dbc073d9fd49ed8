"""Assembly of ranked rows into feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.ordered import top_k

SEPARATOR = "\n\n---\n\n"
MAX_FEED_ITEMS = 50


def assemble_feed(
    items: DataFrame, feed: Sequence[str], position: str, content: Column, published: Column | None = None,
    limit: int = MAX_FEED_ITEMS, separator: str = SEPARATOR,
) -> DataFrame:
    """One row per feed: number of items, joined content and the first known date.

    A feed shows its first `limit` items, so a group is cut by every task before it is collected.
    """
    rows = items.withColumn("_content", content).withColumn("_published", published if published is not None else F.lit(None).cast("timestamp"))
    kept = top_k(rows.select(*feed, position, "_content", "_published"), feed, [F.col(position)], limit, "_rank")
    body = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_content"))), lambda x: x["_content"])
    return kept.groupBy(*feed).agg(
        F.count(F.lit(1)).alias("result_count"),
        F.array_join(body, separator).alias("content"),
        F.min_by("_published", F.when(F.col("_published").isNotNull(), F.col("_rank"))).alias("published_at"),
    )


def numbered_link(position: Column, title: Column, url: Column, snippet: Column) -> Column:
    """Markdown of one search result."""
    from factloom.functions.text import escape_markdown

    tail = F.when(F.coalesce(snippet, F.lit("")) != "", F.concat(F.lit("\n\n   "), escape_markdown(snippet))).otherwise(F.lit(""))
    return F.concat(position.cast("string"), F.lit(". ["), escape_markdown(title), F.lit("]("), url, F.lit(")"), tail)
