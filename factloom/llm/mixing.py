"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates that give each source its target words, those
are taken that are closest in entropy to one copy each, with no rate above max_copies: rate = min(max_copies,
exp(tilt * size / mean size)). The tilt of a source is the root of the convex dual's gradient. Newton steps, kept inside a
bracket, run for all sources at once on the table of distinct sizes, which Spark counts first; each step writes its small
state table. Rates become whole copies in blocks of some thousand documents, longest first, where the error of each rounding
is carried to the next document, so a block misses its share by about half of its shortest text.

Null text counts as empty; a document without words has size 0 and takes 0 words. A null source is a source of its own, last in
order. A source without words has target 0. Equal rows are rounded in turn. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.store import narrow, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
BLOCK_ROWS = 4096
STEPS = 60
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    """Runs of anything but blank and 0x09-0x0D, counted on the JVM side; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target per source. Input: source, size, n, one row for each distinct pair.

    Sources stand in code-point order, null last, and take weights in turn. Their targets rise together in proportion to the
    weights up to a common level, and stop at max_copies times the source's size. Windows run over one row per source only.
    """
    per_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weighted = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    total, cap = F.sum("source_size").over(Window.partitionBy()), F.col("source_size") * float(max_copies)
    order = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (total * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # Up to the first source that the level doesn't fill it rises along this order, and falls from there on.
    stepped = weighted.withColumn("cap", cap).withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return stepped.select("source", F.col("source_size").cast("long").alias("source_size"),
                          F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, max_copies: int) -> Column:
    return F.least(F.lit(float(max_copies)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))


def tilts(sizes: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """source, mean, tilt: safeguarded Newton steps on the dual, for all sources in each step."""
    mean = sizes.filter("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = stored(
        goals.alias("g").join(mean.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source"))).select(
            "g.source", "source_size", "target", "mean", F.lit(0.0).alias("tilt"),
            F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"), F.lit(1.0).alias("miss")), "mix-state")
    for _ in range(steps):
        s, z = state.alias("s"), sizes.filter("size > 0").alias("z")
        rate = _rate(F.col("s.tilt"), F.col("z.size"), F.col("s.mean"), max_copies)
        mass = F.col("z.size") * F.col("z.n")
        sums = z.join(s, F.col("z.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("s.source").alias("source")).agg(
            F.sum(mass * rate).alias("taken"),
            F.sum(F.when(rate < max_copies, mass * rate * F.col("z.size") / F.col("s.mean")).otherwise(0.0)).alias("slope"))
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        step = F.when((newton > F.col("low_")) & (newton < F.col("high_")), newton).otherwise((F.col("low_") + F.col("high_")) / 2)
        state = stored(
            state.alias("a").join(sums.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "taken", "slope")
            .withColumn("low_", low).withColumn("high_", high).select(
                "source", "source_size", "target", "mean", F.when(gap == 0, F.col("tilt")).otherwise(step).alias("tilt"),
                F.col("low_").alias("low"), F.col("high_").alias("high"),
                F.when(F.col("target") > 0, F.abs(gap) / F.col("target")).otherwise(0.0).alias("miss")), "mix-state")
        # Full sources (target = max_copies * size) reach their target at the end of the bracket only.
        worst = state.agg(F.max(F.when(F.col("target") < F.col("source_size") * max_copies * (1 - 1e-12), F.col("miss")))).first()[0]
        if worst is None or worst <= tolerance:
            break
    full = F.col("target") >= F.col("source_size") * max_copies * (1 - 1e-12)
    # Rounded, so that the order in which Spark adds up does not show in the copies.
    return state.select("source", "mean", F.when(full, F.lit(1e9)).otherwise(F.round("tilt", 9)).alias("tilt"))


def _round_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    carried, copies = 0.0, np.zeros(len(rows), np.int64)
    for k, (size, rate, most) in enumerate(zip(rows["size"].to_numpy(), rows["rate"].to_numpy(), rows["most"].to_numpy())):
        wanted = rate * size + carried
        copies[k] = min(most, max(0, int(np.floor(wanted / size + 0.5))))
        carried = wanted - copies[k] * size
    return rows[["doc_id", "source", "size", "rate"]].assign(copies=copies)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, taken."""
    sized = stored(narrow(docs, doc_id=id_col, text=text_col, source=source_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    goals = stored(targets(sizes, weights, share, max_copies), "mix-targets")
    found = tilts(sizes, goals, max_copies)
    counts = sizes.groupBy("source").agg(F.sum("n").alias("n_docs"))
    plan = goals.alias("g").join(found.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source")), "left").join(
        counts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source"))).select(
        F.col("g.source").alias("p_source"), "source_size", "target", "mean", "tilt", F.ceil(F.col("n_docs") / block_rows).alias("n_blocks"))
    # One row per source: small, though it is left to Spark to broadcast it.
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    rated = joined.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("tilt"), F.col("size"), F.col("mean"), max_copies)).otherwise(0.0))
    block = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks"))
    rounded = rated.filter("size > 0").select("doc_id", "source", "size", "rate", F.lit(max_copies).alias("most"), block.alias("block")).groupBy(
        "source", "block").applyInPandas(_round_block, "doc_id long, source string, size long, rate double, copies long")
    empty = rated.filter("size = 0").select("doc_id", "source", "size", "rate", F.lit(0).cast("long").alias("copies"))
    out = rounded.unionByName(empty).join(plan.select("p_source", "source_size", "target"), F.col("source").eqNullSafe(F.col("p_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
