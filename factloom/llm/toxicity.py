"""Toxic passages by maximum-scoring segments.

Every word has a score: its log-odds between toxic and clean labelled documents, with a Dirichlet prior in proportion to the
word's share of both, less CAUTION standard errors; its first letters are scored likewise, and the best of these counts. Words
without a positive score cost a small drift, and so do repeats of one: first a linear-time scan finds all maximal segments with every
word counted, then a word that counted less than REPEAT_WORDS words before in the same segment doesn't count again, and the scan is
repeated. What stands elsewhere in the text takes nothing from a passage. Under clean words, the best segment of n words follows an extreme-value law, P(best <= s) = exp(-K n exp(-lambda s)):
lambda solves E[exp(lambda * word score)] = 1, K is the likelihood's maximum, both over clean documents that taught no word.
A document's evidence is the sum of its segments' bits beyond chance, and a logistic curve turns it into the score.

Words are runs of letters and digits in lower case, hashed into a fixed number of buckets, so the model has a fixed size. Null or
empty texts have no segment and get the score of no evidence. Rows with equal ids are scored one by one. Without labels all
scores are alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.store import narrow
from factloom.llm.training import MAX_LABELLED, fit_logistic, labelled, remainder
from factloom.llm.words import Scanner

BUCKETS = 1 << 18
# Bytes of the first letters that are scored besides the whole word.
STEMS = (4, 6)
PRIOR_WORDS = 5000.0
CAUTION = 2.5
DRIFT = 0.1
# A word counts again in a segment after so many words, whose drift outweighs one word.
REPEAT_WORDS = 64
MAX_RATE = 8.0
THRESHOLD = 0.7
# Word scores and evidence are counted in steps of 1 / STEP when the law and the curve are fitted, evidence up to MAX_BITS.
STEP = 64
MAX_BITS = 400
CALIBRATION_FOLDS = 4


@dataclass
class Model:
    scores: np.ndarray
    drift: float = DRIFT
    rate: float = 1.0
    chance: float = 1.0
    curve: tuple[float, float] = field(default=(0.0, 0.0))

    def values(self, words: np.ndarray) -> np.ndarray:
        """The score of each word. words: one row of buckets for the whole word and one for each stem."""
        own = self.scores[np.arange(len(words))[:, None], words].max(0)
        up = np.flatnonzero(own > 0)
        if len(up) > 1 and len(np.unique(words[0][up])) < len(up):
            segment = np.searchsorted([stop for _, stop, _ in passages(own)], up, "right")
            counted: dict[tuple[int, int], int] = {}
            for key, place in zip(zip(segment.tolist(), words[0][up].tolist()), up.tolist()):
                if place - counted.get(key, -REPEAT_WORDS) < REPEAT_WORDS:
                    own[place] = -self.drift
                else:
                    counted[key] = place
        return own

    def probability(self, bits: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log2(1 + np.minimum(bits, MAX_BITS)), -60, 60)))


def word_scores(clean: np.ndarray, toxic: np.ndarray, prior_words: float = PRIOR_WORDS, caution: float = CAUTION, drift: float = DRIFT) -> np.ndarray:
    """Log-odds of each bucket with an informative Dirichlet prior, less a few standard errors; -drift where nothing is left."""
    both, n0, n1 = clean + toxic, clean.sum(), toxic.sum()
    if not n0 or not n1:
        return np.full(len(clean), -drift)
    prior = prior_words * (both + 1e-3) / (both.sum() + 1e-3 * len(both))
    odds = np.log((toxic + prior) / (n1 + prior_words - toxic - prior)) - np.log((clean + prior) / (n0 + prior_words - clean - prior))
    sure = odds - caution * np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.where(sure > 0, sure, -drift)


def extreme_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root lambda of E[exp(lambda * score)] = 1 over the given words."""
    if not counts.sum() or scores[counts > 0].max() <= 0 or (scores * counts).sum() >= 0:
        return 1.0
    share = counts[counts > 0] / counts.sum()
    own = scores[counts > 0]
    low, high = 0.0, 1.0
    while (share * np.exp(high * own)).sum() < 1 and high < MAX_RATE:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * own)).sum() < 1 else (low, middle)
    return high


def segments(sums: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a list of scores, in linear time.

    A candidate keeps the running sum before and after it. A new positive score goes back to the nearest candidate that begins
    lower than it; joined with that one if this raises the top, else it stands alone.
    """
    found: list[tuple] = []  # first, last, sum before, sum after, nearest candidate that begins lower or -1
    total = 0.0
    for k, s in enumerate(sums):
        before, total = total, total + s
        if s <= 0:
            continue
        first, j = k, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, k, before, total, j))
                break
            first, before, lower = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = lower
    return [(f[0], f[1], f[3] - f[2]) for f in found]


def passages(own: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments (first word, last word + 1, score) of the words' scores. Runs of one sign are summed up first."""
    up = own > 0
    if not up.any():
        return []
    edge = np.concatenate([[0], np.flatnonzero(up[1:] != up[:-1]) + 1, [len(own)]])
    return [(int(edge[a]), int(edge[b + 1]), s) for a, b, s in segments(np.add.reduceat(own, edge[:-1]).tolist())]


def evidence(found: list[tuple[int, int, float]], n: int, rate: float, chance: float) -> float:
    """Bits of all segments beyond what n clean words make likely."""
    least = np.log(max(chance * n, 1e-9))
    return sum(max(0.0, rate * s - max(least, 0.0)) for *_, s in found) / np.log(2)


def _rows(scanner: Scanner, texts: pa.Array):
    """Row, buckets of its words and of their stems."""
    for piece in scanner.pieces(texts):
        buckets = np.stack([(h & np.uint64(BUCKETS - 1)).astype(np.int64) for h in (piece.hashes, *(piece.stems(n) for n in STEMS))])
        for row in range(len(piece)):
            yield piece.first + row, buckets[:, piece.rows[row]: piece.rows[row + 1]]


def _count(batches):
    scanner, counts = Scanner(True), np.zeros((1 + len(STEMS), 2, BUCKETS), np.int64)
    for batch in batches:
        y = batch["y"].to_numpy(zero_copy_only=False)
        for row, words in _rows(scanner, batch["t"]):
            # Once per document, so that one text that repeats a word does not decide its score.
            for kind, own in enumerate(words):
                counts[kind][1 if y[row] else 0][np.unique(own)] += 1
    kind, bucket = np.nonzero(counts.any(1))
    yield pa.record_batch({"kind": pa.array(kind), "bucket": pa.array(bucket), "clean": pa.array(counts[kind, 0, bucket]),
                           "toxic": pa.array(counts[kind, 1, bucket])})


def _score_counts(model: Model):
    def run(batches):
        scanner = Scanner(True)
        for batch in batches:
            steps = [np.rint(model.values(words) * STEP).astype(np.int64) for _, words in _rows(scanner, batch["t"])]
            step, n = np.unique(np.concatenate(steps) if steps else np.zeros(0, np.int64), return_counts=True)
            yield pa.record_batch({"step": pa.array(step), "n": pa.array(n)})

    return run


def _evidence_of(model: Model):
    def run(batches):
        scanner = Scanner(True)
        for batch in batches:
            best, n, bits = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, words in _rows(scanner, batch["t"]):
                found = passages(model.values(words))
                n[row], best[row] = words.shape[1], max((s for *_, s in found), default=0.0)
                bits[row] = evidence(found, words.shape[1], model.rate, model.chance)
            yield pa.record_batch({"y": batch["y"].cast(pa.int32()), "n": pa.array(n), "best": pa.array(best),
                                   "step": pa.array((np.minimum(bits, MAX_BITS) * STEP).astype(np.int64))})

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out=None, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_LABELLED) -> Model:
    """Word scores from three quarters of the labelled rows, the extreme-value law and the curve from the rest.

    held_out: a condition on doc_id whose rows teach nothing. Counts come to the driver per bucket and per step only.
    """
    known = labelled(docs, labels, label_col, F.lit(True) if held_out is None else ~held_out, id_col, text_col, max_rows)
    fold = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("|fold")).cast("binary")) % CALIBRATION_FOLDS
    counted = known.filter(fold != 0).select("t", "y").mapInArrow(_count, "kind long, bucket long, clean long, toxic long").groupBy(
        "kind", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    tables = []
    for kind in range(1 + len(STEMS)):
        own, counts = counted[counted["kind"] == kind], np.zeros((2, BUCKETS))
        counts[0][own["bucket"]], counts[1][own["bucket"]] = own["clean"], own["toxic"]
        tables.append(word_scores(*counts))
    model = Model(np.stack(tables))
    rest = known.filter(fold == 0).select("t", "y")
    steps = rest.filter("y = 0").mapInArrow(_score_counts(model), "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas()
    model.rate = extreme_rate(steps["step"].to_numpy(float) / STEP, steps["n"].to_numpy(float))
    found = "y int, n long, best double, step long"
    law = rest.filter("y = 0").mapInArrow(_evidence_of(model), found).agg(
        F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-model.rate * F.col("best")))).first()
    model.chance = float(law[0] / law[1]) if law[0] and law[1] else 1.0
    steps = rest.mapInArrow(_evidence_of(model), found).groupBy("step", "y").agg(F.count(F.lit(1)).alias("n")).toPandas()
    model.curve = fit_logistic(np.log2(1 + steps["step"].to_numpy(float) / STEP), (steps["y"].to_numpy() > 0).astype(float), steps["n"].to_numpy(float))
    return model


SCORED = "doc_id long, score double, bits double, passages array<struct<first_word:int,end_word:int,score:double>>"


def _scorer(model: Model):
    def run(batches):
        scanner = Scanner(True)
        for batch in batches:
            bits, ends, flat = np.zeros(batch.num_rows), [0], ([], [], [])
            for row, words in _rows(scanner, batch["t"]):
                found = passages(model.values(words))
                bits[row] = evidence(found, words.shape[1], model.rate, model.chance)
                least = max(np.log(max(model.chance * words.shape[1], 1e-9)), 0.0)
                for passage in found:
                    if model.rate * passage[2] > least:
                        for column, value in zip(flat, passage):
                            column.append(value)
                ends.append(len(flat[0]))
            spans = pa.StructArray.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.float64())],
                                               ["first_word", "end_word", "score"])
            yield pa.record_batch([batch["d"].cast(pa.int64()), pa.array(model.probability(bits)), pa.array(bits), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), spans)], ["doc_id", "score", "bits", "passages"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, bits and the significant passages (first word, end word, score) of every document."""
    return narrow(docs, d=id_col, t=text_col).mapInArrow(_scorer(model), SCORED)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns."""
    def run(batches):
        scanner = Scanner(True)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, words in _rows(scanner, batch.column(batch.schema.get_field_index(text_col))):
                bits = evidence(passages(model.values(words)), words.shape[1], model.rate, model.chance)
                keep[row] = model.probability(np.array([bits]))[0] < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(modulus: int = 3, rest: int = 1):
    return remainder("doc_id", modulus) == rest
