"""Crawl-quality reports: outcomes, errors, rates, agreement, scores and samples."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions import urls as U
from factloom.functions.numbers import round_half_up
from factloom.operators.joins import values_agree
from factloom.operators.ordered import summarize

# Rank bands with their share of a sample.
RANK_BANDS = ((1, 1_000, 0.4), (1_001, 10_000, 0.3), (10_001, 100_000, 0.2), (100_001, 1_000_000, 0.1))
MIN_SUCCESS_RATE = 0.6
MAX_SAMPLE = 1_000


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def error_groups(results: DataFrame) -> DataFrame:
    """Failures by code and message, most frequent first in `pos`."""
    grouped = results.filter(F.col("error_code").isNotNull()).groupBy("error_code", "error_message").agg(F.count(F.lit(1)).alias("n"))
    return grouped.orderBy(F.col("n").desc(), "error_code", "error_message")


def success_rate(outcome: Column) -> Column:
    """Aggregate: successes among the rows whose target was not rejected."""
    return F.count_if(outcome == "success") / F.nullif(F.count_if(outcome != "rejected_target"), F.lit(0))


def smoke_report(results: DataFrame, wanted: int, min_rate: float = MIN_SUCCESS_RATE) -> DataFrame:
    """One row: counts, rate, nearest-rank latencies and the gates."""
    o = F.col("outcome")
    one = lambda test: F.when(test, 1).otherwise(0).cast("long")
    found = summarize(
        results, [], {"latency": (F.col("duration_ms"), {"p50": 0.5, "p95": 0.95, "maximum": 1.0})},
        {"evaluated": one(o != "rejected_target"), "successes": one(o == "success"), "_invalid": one(o == "invalid_response"), "_transport": one(o == "transport_error"),
         "_limited": one(o == "rate_limited")}, {"distinct_sites": U.site_key(U.host(F.col("url")))}).withColumnRenamed("rows", "attempted")
    # Without results there is still one row, of zeros.
    found = results.sparkSession.range(1).select(F.lit(0).alias("_one")).join(found.withColumn("_one", F.lit(0)), "_one", "left").fillna(
        0, ["attempted", "evaluated", "successes", "distinct_sites", "_invalid", "_transport", "_limited"])
    found = found.withColumn("success_rate", F.coalesce(F.col("successes") / F.nullif(F.col("evaluated"), F.lit(0)), F.lit(0.0)))
    checks = {
        "attempted_ok": F.col("attempted") >= wanted, "rate_ok": F.col("success_rate") >= min_rate,
        "no_invalid": F.col("_invalid") == 0, "no_transport": F.col("_transport") == 0, "no_limited": F.col("_limited") == 0,
    }
    passed = F.lit(True)
    for c in checks.values():
        passed = passed & c
    return found.select(
        "attempted", "evaluated", "successes", "success_rate", "distinct_sites", "p50", "p95", "maximum",
        *[c.alias(n) for n, c in checks.items()], passed.alias("passed"))


def fastest_success(results: DataFrame) -> DataFrame:
    """The quickest successful row as target of a follow-up probe."""
    ok = results.filter(F.col("outcome") == "success")
    return ok.agg(F.min_by("url", F.struct("duration_ms", "url")).alias("url"), F.min("duration_ms").alias("duration_ms"))


def coverage(rows: DataFrame, fields: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Share of rows that have each field, four digits."""
    rate = lambda f: round_half_up(F.avg(F.when(F.col(f).isNotNull(), 1.0).otherwise(0.0)), 4).alias(f"{f}_rate")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *[rate(f) for f in fields])


def agreement(pairs: DataFrame, left: str, right: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows where both values exist and the share that agrees by equality or containment."""
    both = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    agreed = F.count_if(values_agree(F.col(left), F.col(right)))
    return both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("compared"), round_half_up(agreed / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("rate"))


def disagreements(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose success differs."""
    return pairs.filter(F.col(left) != F.col(right))


def implementation_summary(results: DataFrame, group: str) -> DataFrame:
    """Per implementation: success, coverage, noise, median words and runtime percentiles.

    Columns: group, success, title, author, published_at, noise, word_count, duration_ms.
    """
    ok = F.col("success")
    one = lambda test: F.when(test, 1).otherwise(0).cast("long")
    fields = ["title", "author", "published_at"]
    found = summarize(
        results, [group], {"words": (F.when(ok, F.col("word_count")), {"median_words": 0.5}), "runtime": (F.col("duration_ms"), {"p50": 0.5, "p95": 0.95})},
        {"successes": one(ok), "_noise": F.when(ok, F.col("noise").cast("decimal(18,2)")), **{f"_{f}": one(ok & F.col(f).isNotNull()) for f in fields}})
    n_ok = F.greatest(F.col("successes"), F.lit(1))
    return found.select(
        group, "successes", round_half_up(F.col("successes") / F.col("rows"), 4).alias("success_rate"),
        *[round_half_up(F.col(f"_{f}") / n_ok, 4).alias(f"{f}_rate") for f in fields],
        round_half_up(F.coalesce(F.col("_noise").cast("double"), F.lit(0.0)) / n_ok, 2).alias("noise"), "median_words", "p50", "p95").fillna(0, ["median_words"])


def composite_score(summary: DataFrame) -> DataFrame:
    """Adds the weighted score and marks the winner; the fastest implementation sets the speed scale."""
    every = Window.partitionBy(F.lit(0))  # one row per implementation
    fastest = F.greatest(F.lit(0.01), F.min(F.when(F.col("p50") > 0, F.col("p50"))).over(every))
    p50 = F.when(F.col("p50") > 0, F.col("p50")).otherwise(fastest)
    speed = fastest / F.greatest(fastest, p50)
    score = round_half_up(
        F.col("success_rate") * 60 + F.greatest(F.lit(0.0), 15 - F.col("noise")) + F.col("title_rate") * 8
        + F.col("author_rate") * 5 + F.col("published_at_rate") * 7 + speed * 5, 2)
    return summary.withColumn("score", score).withColumn("winner", F.col("score") == F.max("score").over(every))


def stratified_sample(domains: DataFrame, count: int, bands=RANK_BANDS) -> DataFrame:
    """`count` ranked domains of distinct sites, spread over rank bands by a stride.

    Every stride takes its first valid domain whose site was not taken before. At most `count` sites can be
    taken, so the first `count` sites of a stride decide it exactly; only those reach the final choice.
    """
    if count > MAX_SAMPLE:
        raise ValueError(f"a sample has at most {MAX_SAMPLE} domains")
    plan, taken = [], 0
    for i, (start, end, weight) in enumerate(bands):
        wanted = count - taken if i == len(bands) - 1 else int(count * weight + 0.5)
        taken += max(wanted, 0)
        if wanted > 0:
            plan.append((start, end, wanted, max(1, (end - start + 1) // wanted)))
    rank = F.col("rank")
    slots, offset = [], 0
    for start, _, wanted, stride in plan:
        first = start + stride // 2
        step = F.floor((rank - first) / stride)
        slots.append(F.when((rank >= first) & (step < wanted), (step + offset).cast("long")))
        offset += wanted
    # The last stride of a band may reach into the next band, so a domain can stand in two strides.
    valid = domains.filter(U.valid_domain(F.col("domain"))).withColumn("slot", F.explode(F.array_compact(F.array(*slots))))
    sites = valid.withColumn("site", U.site_key(F.col("domain"))).groupBy("slot", "site").agg(
        F.min(F.struct("rank", "domain")).alias("_first"))
    w = Window.partitionBy("slot").orderBy("_first")
    few = sites.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= count).select(
        F.lit(0).alias("_all"), "slot", "site", F.col("_first.rank").alias("rank"), F.col("_first.domain").alias("domain"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        seen, chosen = set(), {}
        for r in rows.sort_values(["slot", "rank"]).itertuples():
            if r.slot not in chosen and r.site not in seen and len(chosen) < count:
                seen.add(r.site)
                chosen[r.slot] = (r.slot, r.rank, r.domain, r.site)
        return pd.DataFrame(list(chosen.values()), columns=["slot", "rank", "domain", "site"])

    # At most count * count rows, whatever the size of the list.
    return few.groupBy("_all").applyInPandas(choose, "slot long, rank long, domain string, site string")


def stride_sample(rows: DataFrame, rank: str, stride: int) -> DataFrame:
    """Every stride-th row, from the middle of the first stride."""
    return rows.filter(F.pmod(F.col(rank), F.lit(stride)) == stride // 2)


def mixed_sample(first: DataFrame, second: DataFrame, key: str, count: int) -> DataFrame:
    """Half of the sample from each corpus, distinct and in order of the key."""
    half = count // 2
    a = first.select(key).distinct().orderBy(key).limit(half).withColumn("corpus", F.lit("first"))
    b = second.select(key).distinct().orderBy(key).limit(count - half).withColumn("corpus", F.lit("second"))
    return a.unionByName(b)


def distinct_targets(sources: Sequence[DataFrame], key: str, count: int) -> DataFrame:
    """The first `count` distinct targets of several sources, in order."""
    both = sources[0].select(key)
    for s in sources[1:]:
        both = both.union(s.select(key))
    return both.distinct().orderBy(key).limit(count)
