"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many random lines. In each of several tables they are sorted along one line, within cells that the signs of
further projections cut so that a cell holds about CELL vectors; only pairs within a window centred on the query's projection meet.
For each pair that meets, window collisions are counted over all counting lines. Pairs with at least the count that a pair at
the threshold reaches with the wanted recall are verified once, by exact cosine in double precision.
The number of tables follows from the same model, so the expected recall of pairs at the threshold is known beforehand
(expected_recall); pairs above it are found more often.

Equal vectors form one class and are not compared. Vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length neither. Rows with equal or null ids are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.components import connected
from factloom.llm.store import narrow, stored

SIMILAR = 0.9
# Expected recall of pairs right at the threshold, split between meeting in a table and reaching the count.
MEET, COUNT = 0.985, 0.995
CELL = 16
LINES = 32
# Half width of the tables' windows and of the counted ones, in standard deviations of the difference of a pair at the threshold.
TABLE_WINDOW, COUNT_WINDOW = 2.2, 1.645
# Counting projections are kept in steps of 1 / STEP.
STEP = 16
SEED = 20260101


@dataclass
class Design:
    """Tables, sign bits per table, windows and the least number of collisions."""
    tables: int
    bits: int
    window: float
    count_window: float
    least: int
    lines: int = LINES

    @property
    def expected_recall(self) -> float:
        return MEET * COUNT


def design(rows: int, similar: float = SIMILAR, lines: int = LINES) -> Design:
    """Bits so that a cell holds about CELL vectors, tables and count for the wanted recall at the threshold."""
    spread = math.sqrt(2 - 2 * similar)  # of the projected difference of unit vectors
    inside = lambda w: math.erf(w / math.sqrt(2))
    bits = max(0, math.ceil(math.log2(max(rows, 1) / CELL)))
    meet = (1 - math.acos(similar) / math.pi) ** bits * inside(TABLE_WINDOW)
    tables = max(1, math.ceil(math.log(1 - MEET) / math.log(1 - meet)))
    p, least, tail = inside(COUNT_WINDOW), lines + 1, 0.0
    while tail < COUNT and least > 0:
        least -= 1
        tail += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
    return Design(tables, bits, TABLE_WINDOW * spread, COUNT_WINDOW * spread, least, lines)


def _lines(size: int, number: int, salt: int) -> np.ndarray:
    return np.random.default_rng([SEED, salt, size]).standard_normal((number, size))


def _sketch(plan: Design):
    """Per vector: cell and value in every table, and the counting projections as 8-bit steps."""
    def run(batches):
        cached: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            lists = batch["v"]
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
            sizes = np.diff(ends)
            cells = np.zeros((batch.num_rows, plan.tables), np.int64)
            values = np.zeros((batch.num_rows, plan.tables))
            counts = np.zeros((batch.num_rows, plan.lines), np.int8)
            for size in np.unique(sizes):
                if size not in cached:
                    cached[size] = _lines(size, plan.tables * plan.bits, 1), _lines(size, plan.tables, 2), _lines(size, plan.lines, 3)
                signs, along, lines = cached[size]
                own = np.flatnonzero(sizes == size)
                x = flat[ends[own][:, None] + np.arange(size)]
                # Scaled first, so that the squares of very large or small components stay finite.
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if plan.bits:
                    bit = ((x @ signs.T) > 0).reshape(len(own), plan.tables, plan.bits)
                    cells[own] = (bit << np.arange(plan.bits)).sum(2)
                # Vectors of another length never share a cell.
                cells[own] += int(size) << 40
                values[own] = x @ along.T
                counts[own] = np.clip(np.rint(x @ lines.T * STEP), -127, 127)
            yield pa.record_batch([batch["k"], pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * plan.tables), pa.array(cells.ravel())),
                                   pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * plan.tables), pa.array(values.ravel())),
                                   pa.array([row.tobytes() for row in counts], pa.binary())], ["k", "cells", "along", "counts"])

    return run


def _counted(plan: Design):
    """Pairs whose window collisions over all counting lines reach the least number."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [np.frombuffer(b"".join(batch[c].to_pylist()), np.int8).reshape(batch.num_rows, plan.lines).astype(np.int32) for c in ("x_counts", "y_counts")]
            meets = (np.abs(sides[0] - sides[1]) <= plan.count_window * STEP + 1).sum(1)
            keep = pa.array(meets >= plan.least)
            yield pa.record_batch([batch["x"].filter(keep), batch["y"].filter(keep)], ["x", "y"])

    return run


def candidates(sketches: DataFrame, plan: Design) -> DataFrame:
    """Distinct pairs (x, y) that meet in a window of some table and collide often enough. sketches: k, cells, along, counts."""
    tables = F.explode(F.transform(F.sequence(F.lit(0), F.lit(plan.tables - 1)), lambda t: F.struct(
        t.alias("t"), F.element_at("cells", t + 1).alias("cell"), F.element_at("along", t + 1).alias("at"))))
    rows = sketches.select("k", "counts", tables.alias("r")).select("k", "counts", "r.t", "r.cell", "r.at")
    slot = F.floor(F.col("at") / plan.window)
    # The window reaches from one slot into the next only: each row asks in its own and offers itself to the one below, too.
    x = rows.select("t", "cell", slot.alias("slot"), *[F.col(c).alias(f"x_{c}") for c in ("k", "counts", "at")])
    y = rows.select("t", "cell", F.explode(F.array(slot, slot - 1)).alias("slot"), *[F.col(c).alias(f"y_{c}") for c in ("k", "counts", "at")])
    met = x.join(y, ["t", "cell", "slot"]).filter(
        ((F.col("y_at") > F.col("x_at")) | (F.col("y_at") == F.col("x_at")) & (F.col("y_k") > F.col("x_k"))) & (F.col("y_at") - F.col("x_at") <= plan.window))
    counted = met.select(F.least("x_k", "y_k").alias("x"), F.greatest("x_k", "y_k").alias("y"), "x_counts", "y_counts").mapInArrow(_counted(plan), "x long, y long")
    return counted.distinct()


def _cosines(similar: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch[c].values.to_numpy(zero_copy_only=False).astype(float) for c in ("va", "vb"))
            ends, other = batch["va"].offsets.to_numpy(), batch["vb"].offsets.to_numpy()
            sizes, keep = np.diff(ends), np.zeros(batch.num_rows, bool)
            for size in np.unique(sizes):
                own = np.flatnonzero((sizes == size) & (np.diff(other) == size))
                # Scaled by powers of two, which changes no digit, so that squares of very large or small components stay finite.
                p, q = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a[ends[own][:, None] + np.arange(size)], b[other[own][:, None] + np.arange(size)]))
                keep[own] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= similar
            keep = pa.array(keep)
            yield pa.record_batch([batch["x"].filter(keep), batch["y"].filter(keep)], ["a", "b"])

    return run


def join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similar: float = SIMILAR, plan: Design | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    plain = narrow(vectors, d=id_col, v=vector_col).select(F.col("d").cast("long").alias("d"), F.col("v").cast("array<double>").alias("v"))
    able = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(
        "v", lambda c: c != 0), F.lit(False))
    rows = stored(plain.withColumn("able", able), "vectors")
    fit = rows.filter("able")
    # -0.0 and 0.0 are one component.
    named = fit.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    classes = named.groupBy("v").agg(F.min("d").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    odd = rows.groupBy("d").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or d is null").limit(1).count()
    classes = stored(classes.withColumn("k", F.xxhash64("v") if odd else F.col("first_id")), "vector-classes")
    plan = plan or design(classes.count(), similar)
    sketches = stored(classes.select("k", "v").mapInArrow(_sketch(plan), "k long, cells array<long>, along array<double>, counts binary"), "vector-sketches")
    pairs = stored(candidates(sketches, plan), "vector-pairs")
    both = pairs.join(classes.select(F.col("k").alias("x"), F.col("v").alias("va")), "x").join(classes.select(F.col("k").alias("y"), F.col("v").alias("vb")), "y")
    links = stored(both.select("x", "y", "va", "vb").mapInArrow(_cosines(similar), "a long, b long"), "vector-links")
    weight = classes.select("k", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(weight.withColumnRenamed("k", "b"), "b").groupBy("a").agg(F.sum("copies").alias("degree"))
    labelled = classes.join(connected(links).withColumnRenamed("node", "k"), "k", "left").join(degree.withColumnRenamed("a", "k"), "k", "left").select(
        "v", "k", "first_id", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("root", "k").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = labelled.join(smallest, "root").select("v", "n_links", "component_id")
    out = named.join(told, "v").select("d", "n_links", "component_id").unionByName(
        rows.filter("not able").select("d", F.lit(0).cast("long").alias("n_links"), F.col("d").alias("component_id")))
    return out.select(F.col("d").alias("vec_id"), "n_links", "component_id", F.col("d").eqNullSafe(F.col("component_id")).alias("kept"))
