"""Exact top-k search by inner product, with a pivot table.

The table holds the distance of every vector to many pivots. For a query q and a vector x the largest difference of their distances to one pivot
is a lower bound of |q - x|, so (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product. Candidates are evaluated in the order of their upper
bounds, until the next one is below the last score that would still be returned: then no other can enter, and the result is exact.

Vectors are sorted by nearest pivot and cut into groups of bounded size; a group knows the range of its distances to every pivot. A query first searches its
own group, which gives a score to beat. Then lots of queries meet the groups whose ranges do not rule them out, both in blocks of bounded size.

The pivots are far apart from each other, chosen from a sample of SAMPLE vectors; they decide how much is passed over, never what is found. How much that is
depends on the data: vectors spread evenly in many dimensions all have about the same distance to any pivot, and then nearly all are evaluated.

Components become floor(256 * x), as long (beyond its range: the nearest long); a score beyond the range of long is the nearest long. Equal vectors form one
class, searched and evaluated once; of its rows the first k + 1 by id are kept, since no more can be returned. A null id is the largest.
Vectors that are null, empty or hold null or non-finite components take no part; vectors of different length do not meet. A query's own row is
left out; other rows of equal vector or id count. Repeated rows are rows of their own, as queries, too. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.store import stored
from factloom.llm.whitening import entries

BEST, EVERY = 5, 50
PIVOTS, SAMPLE = 64, 2048
# Vectors of a group, queries of a lot, candidates evaluated at once, and salts of rows that ask with the same vector.
GROUP, LOT, BLOCK, SALTS = 8192, 4096, 512, 16
# Bounds are widened by this share of the squares they come from, far beyond rounding.
SLACK = 1e-9
LONG = np.iinfo(np.int64)
FOUND = "q long, c long, score long, vec_id long"
RING = "low array<double>, high array<double>, square double, to_beat long"


def pivots_of(sample: list[list[int]], number: int = PIVOTS) -> dict[int, np.ndarray]:
    """Per vector length: vectors of the sample, each the farthest from those chosen before."""
    by_size: dict[int, list] = {}
    for x in sample:
        by_size.setdefault(len(x), []).append(x)
    out = {}
    for size, rows in by_size.items():
        x = np.array(rows, float)
        at, away, chosen = 0, np.full(len(x), np.inf), []
        while len(chosen) < min(number, len(x)):
            chosen.append(at)
            away = np.minimum(away, ((x - x[at]) ** 2).sum(1))
            at = int(away.argmax())
        out[size] = x[chosen]
    return out


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _table(pivots: dict[int, np.ndarray]):
    """Distances of every vector to the pivots of its length, and the nearest of them."""
    def run(batches):
        for batch in batches:
            far, home, near = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            sizes = batch["x"].value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                chosen = pivots.get(int(size), np.zeros((0, size)))
                x = _matrix(batch["x"].take(pa.array(own)), int(size)).astype(float)
                away = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in chosen], 1) if len(chosen) else np.zeros((len(x), 0))
                for i, row in zip(own, away):
                    far[i] = row
                if len(chosen):
                    home[own], near[own] = away.argmin(1), away.min(1)
            yield pa.record_batch([batch["x"], batch["ids"], batch["asked"], batch["k"], pa.array(sizes), pa.array(far, pa.list_(pa.float64())), pa.array(home), pa.array(near)],
                                  ["x", "ids", "asked", "k", "size", "far", "home", "near"])

    return run


def _grouped(group: int):
    """Numbers the groups of each task's sorted rows: at most `group` rows of one length."""
    def run(batches):
        base, number, count, size = None, -1, 0, None
        for batch in batches:
            sizes, out = batch["size"].to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int64)
            if base is None and batch.num_rows:
                base = batch["task"][0].as_py() << 32
            for i, s in enumerate(sizes):
                if s != size or count == group:
                    number, count, size = number + 1, 0, s
                out[i] = base + number
                count += 1
            yield pa.record_batch([pa.array(out), *[batch[c] for c in ("k", "size", "x", "far", "asked", "ids")]], ["g", "k", "size", "x", "far", "asked", "ids"])

    return run


def _scores(x: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products, kept within long."""
    if small:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(row, q)), LONG.min), LONG.max) for row in x], np.int64)


def _best(queries: dict, candidates: dict, best: int) -> list[tuple]:
    """(q, c, score, vec_id) of the first best + 1 rows of every query, by score, then id. queries, candidates: k, x, far, ids; queries: to_beat."""
    x, far = candidates["x"], candidates["far"]
    square = (x.astype(float) ** 2).sum(1)
    first = np.array([LONG.max if not len(i) or i[0] is None else i[0] for i in candidates["ids"]], np.int64)
    copies = np.array([len(i) for i in candidates["ids"]])
    out = []
    for k, q, q_far, least in zip(queries["k"], queries["x"], queries["far"], queries["to_beat"]):
        q_square = (q.astype(float) ** 2).sum()
        # Below 2^52 all products and sums are exact in doubles.
        small = q_square * square.max() < 2.0**104
        apart = np.abs(far - q_far).max(1) if far.shape[1] else np.zeros(len(x))
        upper = (q_square + square) * (1 + SLACK) / 2 - np.maximum(apart - SLACK * (far.max(1) if far.shape[1] else 0), 0) ** 2 / 2
        upper = np.maximum(upper, LONG.min)
        to_beat = -np.inf if least is None else float(least)
        alive = np.flatnonzero(upper >= to_beat)
        order = alive[np.argsort(-upper[alive], kind="stable")]
        kept, scores = np.zeros(0, int), np.zeros(0, np.int64)
        for start in range(0, len(order), BLOCK):
            if upper[order[start]] < to_beat:
                break
            block = order[start:start + BLOCK]
            kept, scores = np.r_[kept, block], np.r_[scores, _scores(x[block], q, small)]
            ranked = np.lexsort((first[kept], -scores))[:best + 1]
            kept, scores = kept[ranked], scores[ranked]
            full = np.flatnonzero(np.cumsum(copies[kept]) > best)
            if len(full):
                to_beat = max(to_beat, float(scores[full[0]]))
        rows = sorted((-int(s), i is None, i or 0, int(candidates["k"][c])) for c, s in zip(kept, scores) for i in candidates["ids"][c])[:best + 1]
        out += [(k, c, -s, None if none else i) for s, none, i, c in rows]
    return out


def _side(table: pa.Table, to_beat: bool) -> dict:
    size = table["size"][0].as_py()
    table = table.combine_chunks()
    out = {"k": table["k"].to_pylist(), "x": _matrix(table["x"].chunk(0), size), "far": np.array(table["far"].to_pylist(), float).reshape(len(table), -1)}
    return out | ({"to_beat": table["to_beat"].to_pylist()} if to_beat else {"ids": table["ids"].to_pylist()})


def _rows(found: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in found], pa.int64()) for i in range(4)]


def _searched(best: int):
    """Each query's search in its own group."""
    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(table["asked"])
        queries = _side(asked.append_column("to_beat", pa.nulls(len(asked), pa.int64())), True) if len(asked) else None
        found = _best(queries, _side(table, False), best) if queries else []
        return pa.Table.from_arrays(_rows(found), ["q", "c", "score", "vec_id"])

    return run


def _met(best: int):
    """A lot of queries searches a group of candidates."""
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = _best(_side(queries, True), _side(candidates, False), best) if len(queries) and len(candidates) else []
        return pa.Table.from_arrays(_rows(found), ["q", "c", "score", "vec_id"])

    return run


def _ring(rows: DataFrame, by: list[str], beat: bool) -> DataFrame:
    """Per group: least and largest distance to every pivot, largest square of a length, and the least score to beat."""
    def run(batches):
        # Partial rings of consecutive rows; a second pass joins those of one group.
        for batch in batches:
            names = list(zip(*[batch[c].to_pylist() for c in by])) if batch.num_rows else []
            cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(names)]):
                part = batch.slice(a, b - a)
                far = np.array(part["far"].to_pylist(), float).reshape(b - a, -1)
                x = _matrix(part["x"], part["size"][0].as_py()).astype(float)
                least = min((LONG.min if v is None else v for v in part["to_beat"].to_pylist())) if beat else LONG.min
                yield pa.record_batch([*[pa.array([v], pa.int64()) for v in names[a]], pa.array([far.min(0)]), pa.array([far.max(0)]),
                                       pa.array([(x * x).sum(1).max()]), pa.array([least], pa.int64())], [*by, "low", "high", "square", "to_beat"])

    parts = rows.mapInArrow(run, ", ".join(f"{c} long" for c in by) + f", {RING}")
    joined = F.collect_list(F.struct("low", "high"))
    fold = lambda side, pick: F.aggregate("r", F.col("r")[0][side], lambda a, s: F.zip_with(a, s[side], pick))
    grouped = parts.groupBy(*by).agg(joined.alias("r"), F.max("square").alias("square"), F.min("to_beat").alias("to_beat"))
    return grouped.select(*by, fold("low", lambda a, b: F.least(a, b)).alias("low"), fold("high", lambda a, b: F.greatest(a, b)).alias("high"), "square", "to_beat")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", best: int = BEST, every: int = EVERY, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the best rows by inner product for every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = stored(entries(vectors, id_col, vector_col), "pivot-rows")
    ordered = Window.partitionBy("x").orderBy(F.asc_nulls_last("d"))
    first = rows.withColumn("n", F.row_number().over(ordered)).filter(F.col("n") <= best + 1)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("n", "d"))), lambda s: s.d)
    asks = rows.filter(F.col("d") % every == 0)
    classes = stored(first.groupBy("x").agg(ids.alias("ids")).join(asks.select("x", F.lit(True).alias("asked")).distinct(), "x", "left").select(
        "x", "ids", F.coalesce("asked", F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("k")), "pivot-classes")
    pivots = pivots_of([r.x for r in classes.orderBy(F.xxhash64("x"), "k").limit(SAMPLE).select("x").collect()])
    table = classes.mapInArrow(_table(pivots), "x array<long>, ids array<long>, asked boolean, k long, size int, far array<double>, home int, near double")
    near = table.repartitionByRange("size", "home", "near").sortWithinPartitions("size", "home", "near").withColumn("task", F.spark_partition_id().cast("long"))
    groups = stored(near.mapInArrow(_grouped(group), "g long, k long, size int, x array<long>, far array<double>, asked boolean, ids array<long>"), "pivot-groups")
    seeds = stored(groups.groupBy("g").applyInArrow(_searched(best), FOUND), "pivot-seeds")
    last = seeds.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select(
        F.col("q").alias("k"), F.when(F.col("n") > best, F.col("s")).alias("to_beat"))
    queries = stored(groups.filter("asked").drop("ids", "asked").join(last, "k", "left"), "pivot-queries")
    # Lots of queries and pages of groups: the ranges of a lot's groups meet those of all groups, page by page.
    lots = max(1, -(-queries.count() // LOT))
    lot = F.pmod(F.xxhash64("g"), F.lit(lots))
    ring = _ring(groups, ["g", "size"], False)
    pages = max(1, -(-ring.count() // 1024))
    asking = _ring(queries, ["g", "size"], True).select(F.col("g").alias("a"), "size", F.struct("low", "high", "square", "to_beat").alias("p"),
                                                        F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))
    asked = ring.select(F.col("g").alias("b"), "size", F.struct("low", "high", "square").alias("r"), F.pmod(F.xxhash64("g"), F.lit(pages)).cast("int").alias("page"))
    gaps = F.zip_with(F.arrays_zip(F.col("p.low").alias("l"), F.col("p.high").alias("h")), F.arrays_zip(F.col("r.low").alias("l"), F.col("r.high").alias("h")),
                      lambda p, r: F.greatest(p.l - r.h, r.l - p.h, F.lit(0.0)))
    both = F.col("p.square") + F.col("r.square")
    apart = F.coalesce(F.array_max(gaps), F.lit(0.0)) - F.sqrt(both) * SLACK
    upper = both * (1 + SLACK) / 2 - F.pow(F.greatest(apart, F.lit(0.0)), 2) / 2
    pairs = stored(asking.join(asked, ["size", "page"]).filter((F.col("a") != F.col("b")) & (upper >= F.col("p.to_beat"))).select(
        F.col("a").alias("g"), "b"), "pivot-pairs")
    lotted = pairs.withColumn("lot", lot)
    left = queries.withColumn("lot", lot).join(lotted.select("g", "b"), "g").select("b", "lot", "k", "size", "x", "far", "to_beat")
    right = groups.join(lotted.select(F.col("b").alias("g"), "lot").distinct(), "g").select(F.col("g").alias("b"), "lot", "k", "size", "x", "far", "ids")
    found = left.groupBy("b", "lot").cogroup(right.groupBy("b", "lot")).applyInArrow(_met(best), FOUND)
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    top = seeds.unionByName(found).withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= best + 1)
    lists = top.groupBy(F.col("q").alias("k")).agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", (F.col("c") == F.col("q")).alias("own")))).alias("e"))
    by_vector = lists.join(classes.filter("asked").select("k", "x"), "k").select("x", "e", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # Rows that ask with the same vector may be very many: they are spread over salts.
    salted = asks.select("d", "x").withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int"))
    told = salted.join(by_vector, ["x", "salt"])
    mine = F.array_position(F.transform("e", lambda s: s.own & s.vec_id.eqNullSafe(F.col("d"))), F.lit(True))
    others = F.slice(F.filter("e", lambda s, i: i + 1 != F.col("mine")), 1, best)
    listed = told.withColumn("mine", F.coalesce(mine, F.lit(0))).select("d", F.posexplode(others).alias("i", "s"))
    return listed.select(F.col("d").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"), "s.vec_id", "s.score")
