"""Rules for hosts: the rule of the longest suffix decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import urls as U

SALTS = 16


def host_suffixes(name: Column) -> Column:
    """A host and all domains it lies below, the longest first: a.b.c, b.c, c."""
    labels = F.split(F.regexp_replace(F.lower(name), r"\.$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_host_rules(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "include") -> DataFrame:
    """Adds `rule` (the domain that decided, null without one) and `action` of each row's host.

    `rules` has domain and action; of rules for one domain the smallest action counts, so `exclude` wins over `include`. Distinct hosts
    are unrolled to their suffixes and meet the rules by hash. A host may hold most of the rows: its verdict is dealt out to salts before it joins them.
    """
    known = rules.select(F.regexp_replace(F.lower(F.trim("domain")), r"^\*?\.|\.$", "").alias("_rule"), "action").groupBy("_rule").agg(F.min("action").alias("_action"))
    rows = df.withColumn("_host", U.host(F.col(url))).withColumn("_salt", F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("int"))
    hosts = rows.filter("_host <> ''").select("_host").distinct()
    met = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_rule")).join(known, "_rule")
    verdicts = met.groupBy("_host").agg(F.max_by(F.struct("_rule", "_action"), F.length("_rule")).alias("_v"))
    dealt = verdicts.select("_host", "_v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.join(dealt, ["_host", "_salt"], "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("_v._rule").alias("rule"), F.coalesce("_v._action", F.lit(default)).alias("action"))


def allowed(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "include") -> DataFrame:
    """Rows whose host is not excluded."""
    return with_host_rules(df, rules, url, default).filter("action <> 'exclude'").drop("rule", "action")
