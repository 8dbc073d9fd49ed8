"""Jaccard join of word n-gram sets: rare-first prefix filter with length, positional and suffix filters.

Texts with equal sets form a class and one of them stands for all. Two sets that are alike share an n-gram among the first
n - ceil(t * n) + 1 of each, in any order that holds for all sets. This order has three parts: n-grams in the lower LOW part of the hash
range that occur in at most FREQUENT documents; those in the upper part; the frequent ones of the lower part. In each part rare ones come
first. The prefix of nearly every set lies in the first part, so the lower part only is counted over all documents, and the upper one over the
few sets that need it. N-grams that occur once are in no join. Prefixes are joined on the n-gram, pairs must pass the length and positional
filters, each pair is verified once, on whole sets, after a suffix filter over hash ranges.

Components need not all links: in every group of prefixes with one n-gram, all are compared with some leaders first, and pairs that are
already connected are not compared at all. In the end all pairs left between different components are compared, so none is lost.

Words are split at blanks and 0x09-0x0D, A-Z lowered. A text of fewer words counts whole; null, empty and blank texts have an empty
set and no link. n-grams are 64-bit hashes, classes 128-bit sums over them. Rows with equal or null ids are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from factloom.llm.components import connected
from factloom.llm.store import fresh, narrow, stored
from factloom.llm.words import Scanner, mix

WORDS = 5
SIMILAR = Fraction(3, 4)
# Part of the hash range whose n-grams come first in the order.
LOW = Fraction(3, 8)
# N-grams of the lower part in more documents than this come last in the order.
FREQUENT = 64
LEADERS = 8
# Rounds of leaders go on while they take away at least this part of the pairs left to compare.
WORTH = 0.5
RANGES = 64


def _low(grams: np.ndarray) -> int:
    """How many of the sorted n-grams lie in the lower part."""
    return int(np.searchsorted(grams, np.uint64(int(LOW * 2**64))))


def _prefix(n: int, similar: Fraction) -> int:
    return n + (-n * similar.numerator) // similar.denominator + 1


def _sets(scanner: Scanner, texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for piece in scanner.pieces(texts):
        for row, grams in piece.sequences(words):
            yield piece.first + row, grams


def _describe(words: int):
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for row, grams in _sets(scanner, batch["t"], words):
                second = mix(grams ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                out[:, row] = len(grams), _low(grams), *np.array([grams.sum(dtype=np.uint64), second]).view(np.int64)
            yield pa.record_batch([batch["d"], batch["k"], *(pa.array(c) for c in out)], ["doc_id", "k", "n", "low", "s1", "s2"])

    return run


def _deal(words: int):
    """The lower part of every set, one row per n-gram."""
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            keys = batch["k"].to_numpy(zero_copy_only=False)
            for piece in scanner.pieces(batch["t"]):
                held, grams_of = [], []
                for row, grams in piece.sequences(words):
                    own = grams[: _low(grams)]
                    held.append(np.full(len(own), keys[piece.first + row]))
                    grams_of.append(own)
                if held:
                    yield pa.record_batch([pa.array(np.concatenate(held)), pa.array(np.concatenate(grams_of).view(np.int64))], ["k", "h"])

    return run


def _whole(words: int):
    """Whole sets, a record batch for each piece, so that neither side holds those of a whole Arrow batch."""
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            for piece in scanner.pieces(batch["t"]):
                rows, sets = zip(*piece.sequences(words))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                ranges = np.concatenate([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES) for s in sets]).astype(np.int32)
                yield pa.record_batch([
                    batch["k"].take(pa.array(np.array(rows) + piece.first)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * RANGES), pa.array(ranges))], ["k", "grams", "ranges"])

    return run


def _least_common(n, m, similar: Fraction):
    """Fewest common n-grams of two alike sets: t / (1 + t) of both sizes, rounded up."""
    p, q = similar.numerator, similar.numerator + similar.denominator
    return F.expr(f"({n} + {m}) * {p} div {q} + if(({n} + {m}) * {p} % {q} = 0, 0, 1)")


def _ranked(rows: DataFrame, stop: str) -> DataFrame:
    """h, k, n, place of rows (h, k, n, df) of one part of the order that are in the prefix. stop: n-grams of the set up to this part's end.

    N-grams that occur once have no row; they stand before the others of their part.
    """
    own = Window.partitionBy("k")
    placed = rows.withColumn("rank", F.row_number().over(own.orderBy("df", "h"))).withColumn("held", F.count(F.lit(1)).over(own))
    return placed.withColumn("place", (F.expr(stop) - F.col("held") + F.col("rank") - 1).cast("int")).filter("place < size").select("h", "k", "n", "place")


def prefixes(texts: DataFrame, classes: DataFrame, words: int, similar: Fraction, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """The n-grams (h, k, n, place) in the prefix of each class that occur more than once, and the sets of all classes with one.

    texts: k, t of all documents; classes: k, n, low.
    """
    postings = texts.mapInArrow(_deal(words), "k long, h long")
    shared = postings.join(postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "h")
    size = F.expr(f"n - (n * {similar.numerator} + {similar.denominator - 1}) div {similar.denominator} + 1")
    owned = stored(shared.join(classes.withColumn("size", size), "k").select("k", "h", "n", "low", "size", "df"), "ngram-shared")
    often = owned.filter(F.col("df") > frequent).groupBy("k").agg(F.count(F.lit(1)).alias("often"))
    counted = stored(classes.withColumn("size", size).join(often, "k", "left").select(
        "k", "n", "low", "size", (F.col("low") - F.coalesce("often", F.lit(0))).alias("rare")), "ngram-counted")
    first = stored(_ranked(owned.filter(F.col("df") <= frequent).join(often, "k", "left"), "low - coalesce(often, 0)"), "ngram-first")
    # Sets whose prefix goes beyond the first part need their upper part, too.
    beyond = counted.filter("rare < size")
    wanted = first.select("k").union(beyond.select("k")).distinct()
    sets = stored(texts.join(wanted, "k", "left_semi").mapInArrow(_whole(words), "k long, grams array<long>, ranges array<int>"), "ngram-sets")
    edge = int(LOW * 2**64)
    # Hashes are unsigned; those above 2^63 read as negative. The lower part ends below.
    upper = sets.join(beyond, "k").select("k", "n", "low", "size", "rare", F.explode(F.filter("grams", lambda h: (h < 0) | (h >= edge))).alias("h"))
    held = upper.join(upper.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "h")
    second = _ranked(held, "rare + n - low")
    third = _ranked(owned.filter(F.col("df") > frequent).join(beyond.filter("rare + n - low < size").select("k"), "k"), "n")
    return stored(first.unionByName(second).unionByName(third), "ngram-prefixes"), sets


def _passing(pairs: DataFrame, similar: Fraction) -> DataFrame:
    """Distinct pairs a < b of rows (x_k, x_n, x_place, y_k, ...) that pass the length and positional filters."""
    p, q = similar.numerator, similar.denominator
    left = F.expr("1 + least(x_n - x_place - 1, y_n - y_place - 1)")
    return pairs.filter(F.expr(f"{q} * least(x_n, y_n) >= {p} * greatest(x_n, y_n)") & (left >= _least_common("x_n", "y_n", similar))).select(
        F.least("x_k", "y_k").alias("a"), F.greatest("x_k", "y_k").alias("b")).distinct()


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select("h", *[F.col(c).alias(f"{name}_{c}") for c in ("k", "n", "place", *more)])


def verified(pairs: DataFrame, sets: DataFrame, similar: Fraction) -> DataFrame:
    """Which pairs (a, b) are links: a suffix filter over hash ranges, then the intersection of whole sets."""
    of_b = pairs.join(sets.select(F.col("k").alias("b"), F.col("grams").alias("gb"), F.col("ranges").alias("rb")), "b")
    both = of_b.join(sets.select(F.col("k").alias("a"), F.col("grams").alias("ga"), F.col("ranges").alias("ra")), "a").withColumns(
        {"na": F.size("ga"), "nb": F.size("gb")})
    possible = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    common = F.when(possible >= _least_common("na", "nb", similar), F.size(F.array_intersect("ga", "gb"))).otherwise(0)
    p, q = similar.numerator, similar.denominator
    return both.select("a", "b", "na", "nb", common.alias("common")).filter(f"{q} * common >= {p} * (na + nb - common)").select("a", "b")


def link_classes(prefix: DataFrame, sets: DataFrame, similar: Fraction, leaders: int = LEADERS) -> DataFrame | None:
    """node, root of all classes with a link; None if no group of prefixes holds two classes.

    A group all of whose members are connected stays so; the others, with their labels, are the next round's rows.
    """
    rows, roots, done, open_pairs, turn = prefix.withColumn("label", F.col("k")), None, None, None, 0
    while True:
        per_group = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(
            F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("same")).filter("g * g > same")
        per_group = stored(per_group, "ngram-groups")
        left = per_group.agg(F.sum(F.expr("(g * g - same) div 2")), F.sum("g")).first()
        if not left[0]:
            return roots
        rows = stored(rows.join(per_group.select("h"), "h"), "ngram-open")
        # Leaders pay off where groups have many more pairs than members.
        last = left[0] <= leaders * left[1] or open_pairs is not None and left[0] > (1 - WORTH) * open_pairs
        open_pairs = left[0]
        if last:
            pairs = _side(rows, "x", "label").join(_side(rows, "y", "label"), "h").filter("x_label < y_label")
        else:
            lead = F.struct("k", "n", "place", "label")
            chosen = rows.groupBy("h").agg(*[F.min_by(lead, F.xxhash64("k", F.lit(turn * leaders + j))).alias(f"l{j}") for j in range(leaders)])
            y = chosen.select("h", F.explode(F.array_distinct(F.array(*[f"l{j}" for j in range(leaders)]))).alias("l")).select(
                "h", *[F.col(f"l.{c}").alias(f"y_{c}") for c in ("k", "n", "place", "label")])
            pairs = _side(rows, "x", "label").join(y, "h").filter("x_label <> y_label")
        pairs = _passing(pairs, similar)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stored(pairs, "ngram-pairs")
        links = verified(pairs, sets, similar)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = connected(links)
        if last:
            return roots
        rows = rows.drop("label").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("root", "k")).drop("root")
        done = pairs if done is None else done.unionByName(pairs)
        turn += 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str | None, bool]:
    """docs with a column that names each row, that column, and whether ids repeat or are null; else the id itself names it."""
    repeated = docs.groupBy(F.col(f"`{id_col}`").alias("d")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or d is null").limit(1).count() > 0
    key = fresh(docs, "row_key")
    own = F.col(f"`{id_col}`").cast("long")
    return docs.withColumn(key, F.xxhash64(own, F.col(f"`{text_col}`")) if repeated else own), key, repeated


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: Fraction = SIMILAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), representative (smallest id with the same set)."""
    keyed, key, repeated = _keyed(docs, id_col, text_col)
    return _join(keyed, key, repeated, id_col, text_col, words, similar).select("doc_id", "n_shingles", "component_id", "representative")


def _join(keyed: DataFrame, key: str, repeated: bool, id_col: str, text_col: str, words: int, similar: Fraction) -> DataFrame:
    """The rows of join with their key k, and kept: whether the row stands for its component."""
    texts = narrow(keyed, d=id_col, k=key, t=text_col).withColumn("d", F.col("d").cast("long"))
    described = stored(texts.mapInArrow(_describe(words), "doc_id long, k long, n long, low long, s1 long, s2 long"), "ngram-documents")
    classes = stored(described.filter("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("k").alias("k"), F.min("doc_id").alias("first_id"), F.min("low").alias("low")), "ngram-classes")
    own = texts.select("k", "t").dropDuplicates(["k"]) if repeated else texts.select("k", "t")
    prefix, sets = prefixes(own, classes.select("k", "n", "low"), words, similar)
    roots = link_classes(prefix, sets, similar)
    if roots is None:
        labelled = classes.withColumn("label", F.col("k"))
    else:
        labelled = classes.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("root", "k")).drop("root")
    smallest = labelled.groupBy("label").agg(F.min(F.struct("first_id", "k")).alias("least"))
    named = labelled.join(smallest, "label").select("n", "s1", "s2", "first_id", F.col("least.first_id").alias("component_id"), F.col("least.k").alias("stays"))
    full = described.filter("n > 0").join(named, ["n", "s1", "s2"])
    return full.select("doc_id", "k", F.col("n").alias("n_shingles"), "component_id", F.col("first_id").alias("representative"), (F.col("k") == F.col("stays")).alias("kept")).unionByName(
        described.filter("n = 0").select("doc_id", "k", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("representative"),
                                         F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: Fraction = SIMILAR) -> DataFrame:
    """One row of each component, of the smallest id, with all its columns; of rows with equal id and text one stays."""
    keyed, key, repeated = _keyed(docs, id_col, text_col)
    dropped = stored(_join(keyed, key, repeated, id_col, text_col, words, similar).filter("not kept").select(F.col("k").alias(key)).distinct(), "ngram-dropped")
    kept = keyed.join(dropped, key, "left_anti")
    return (kept.dropDuplicates([key]) if repeated else kept).select(*[F.col(f"`{c}`") for c in docs.columns])
