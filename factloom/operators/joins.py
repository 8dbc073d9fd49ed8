"""Fallbacks, merges, idempotency and enrichment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import comparison_key
from factloom.operators.ordered import keep_first


def with_fallback(levels: Sequence[DataFrame], query_key: str, level: str = "source_rank") -> DataFrame:
    """Rows of the first level that has any row for the query; later levels serve only unanswered queries."""
    answer = levels[0].withColumn(level, F.lit(0).cast("long"))
    for rank, source in enumerate(levels[1:], start=1):
        answered = answer.select(query_key).distinct()
        rescue = source.join(answered, query_key, "left_anti").withColumn(level, F.lit(rank).cast("long"))
        answer = answer.unionByName(rescue)
    return answer


def rescue_by_id(wanted: DataFrame, sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Each wanted id with the row of the first source that knows it; ids nobody knows are kept with nulls."""
    ranked = sources[0].withColumn("source_rank", F.lit(0).cast("long"))
    for rank, source in enumerate(sources[1:], start=1):
        ranked = ranked.unionByName(source.withColumn("source_rank", F.lit(rank).cast("long")), allowMissingColumns=True)
    return wanted.join(keep_first(ranked, [key], ["source_rank"]), key, "left")


def union_ranked(sources: Sequence[DataFrame], rank: str = "source_rank") -> DataFrame:
    """Ordered union: rows carry the position of their source."""
    out = None
    for i, source in enumerate(sources):
        tagged = source.withColumn(rank, F.lit(i).cast("long"))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def unseen(events: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Events whose id was not handled before."""
    return events.join(seen.select(key), key, "left_anti")


def once(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first delivery of every event id."""
    return keep_first(events, [key], order)


def safe_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Outer merge in which left values win and right values fill gaps."""
    l = left.select(*keys, *[F.col(f).alias(f"_l_{f}") for f in fields])
    r = right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields])
    return l.join(r, list(keys), "full_outer").select(
        *keys, *[F.coalesce(F.col(f"_l_{f}"), F.col(f"_r_{f}")).alias(f) for f in fields]
    )


def replace_retried(original: DataFrame, retried: DataFrame, key: str) -> DataFrame:
    """Result rows, with those of the retried subset replaced and flagged."""
    fields = [c for c in original.columns if c != key]
    again = retried.select(key, F.struct(*fields).alias("_again"))
    return original.join(again, key, "left").select(
        key,
        *[F.when(F.col("_again").isNotNull(), F.col("_again")[f]).otherwise(F.col(f)).alias(f) for f in fields],
        F.col("_again").isNotNull().alias("retried"),
    )


def enrich(rows: DataFrame, extra: DataFrame, keys: Sequence[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Optional enrichment; a missing right side never drops the row."""
    out = rows.join(extra, list(keys), "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def values_agree(a: Column, b: Column) -> Column:
    """Normalized values are equal or one contains the other."""
    x, y = comparison_key(a), comparison_key(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def upsert(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], merge: dict[str, str], order: str
) -> DataFrame:
    """Keyed merge of a table with its changes: per column `first`, `last`, `fill` (last non-null), `min`, `max`, `sum`.

    `first` is insert-or-ignore, `last` is overwrite. Old rows precede all changes.
    """
    base = target.withColumn("_age", F.lit(0)).withColumn("_at", F.col(order))
    new = changes.withColumn("_age", F.lit(1)).withColumn("_at", F.col(order))
    both = base.unionByName(new, allowMissingColumns=True)
    position = F.struct("_age", "_at")
    rules = {
        "first": lambda c: F.min_by(F.col(c), position),
        "last": lambda c: F.max_by(F.col(c), position),
        "fill": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
        "sum": lambda c: F.sum(c),
    }
    return both.groupBy(*keys).agg(*[rules[rule](c).alias(c) for c, rule in merge.items()])
