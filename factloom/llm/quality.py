"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a fixed row of statistics (length, words, letters, repeats, lines), counts as logarithms and shares as
log-odds. Spark adds up their moments per class; class covariances are shrunk towards the common one and its mean variance, and
their Cholesky factors are computed once. A text's score is a logistic curve over the difference of the two Gaussian log densities
(Mahalanobis distance plus log determinant), fitted on counts of that difference.

Null counts as empty text; empty texts have the statistics of no words and are scored like all others. Rows with equal ids are scored
one by one. Without labels of both classes every score is the share of good ones, 0.5 if there are none. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.store import narrow
from factloom.llm.training import MAX_LABELLED, fit_logistic, labelled, remainder
from factloom.llm.words import Piece, Scanner

THRESHOLD = 0.3
# Weight of the common covariance and of its mean variance in each class covariance.
TO_COMMON, TO_ROUND = 0.1, 0.02
# Log-density differences are counted in unit steps within these bounds when the curve is fitted.
MAX_DIFFERENCE = 200
STATISTICS = ("words word_length word_spread upper digits symbols stops tails pipes lines line_repeats distinct repeats top_word distinct_pairs "
              "distinct_triples entropy not_ascii").split()


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of a share, drawn a little to the middle so that none is infinite."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _distinct(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of distinct keys, the most frequent one's count, and the sum of count * log(count)."""
    distinct, top, weighted = np.zeros(n_rows), np.zeros(n_rows), np.zeros(n_rows)
    for row in range(n_rows):
        counts = np.unique(keys[rows[row]: rows[row + 1]], return_counts=True)[1]
        if len(counts):
            distinct[row], top[row], weighted[row] = len(counts), counts.max(), (counts * np.log(counts)).sum()
    return distinct, top, weighted


def statistics(piece: Piece) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, rows, bounds, n_rows = piece.data, piece.rows, piece.bounds, len(piece)
    table = np.zeros((6, 256), bool)
    table[0, 65:91] = table[1, 48:58] = table[3, [33, 46, 63]] = table[4, 10] = True
    table[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = True
    table[5, 128:] = True
    size = np.diff(bounds).astype(float)
    upper, digits, symbols, stops, lines, not_ascii = (_per_row(t[data], bounds) for t in table)
    n = np.diff(rows).astype(float)
    long = (piece.ends - piece.starts).astype(float)
    mean = _per_row(long, rows) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(_per_row(long**2, rows) / np.maximum(n, 1) - mean**2, 0))
    tail = data[piece.ends - 1] if len(data) else np.zeros(0, np.uint8)
    odd = table[2].copy()
    odd[[33, 44, 46, 58, 59, 63]] = False
    tails, pipes = _per_row(odd[tail], rows), _per_row((long == 1) & odd[tail], rows)
    same = np.zeros(len(long))
    same[1:] = piece.hashes[1:] == piece.hashes[:-1]
    same[rows[:-1][np.diff(rows) > 0]] = 0
    distinct, top, weighted = _distinct(piece.hashes, rows, n_rows)
    grams = []
    for k in (2, 3):
        hashes, inside = piece.ngrams(k)
        at = np.searchsorted(np.flatnonzero(inside), rows)
        grams.append((_distinct(hashes[inside], at, n_rows)[0], np.diff(at).astype(float)))
    line_repeats = _line_repeats(piece)
    entropy = np.log(np.maximum(n, 1)) - weighted / np.maximum(n, 1)
    return np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), _odds(upper, size), _odds(digits, size), _odds(symbols, size), _odds(stops, n), _odds(tails, n),
        _odds(pipes, n), np.log1p(lines), np.log1p(line_repeats), _odds(distinct, n), _odds(_per_row(same, rows), n), _odds(top, n),
        _odds(*grams[0]), _odds(*grams[1]), entropy / np.maximum(np.log(np.maximum(n, 2)), 1), _odds(not_ascii, size)], 1)


def _line_repeats(piece: Piece) -> np.ndarray:
    """Lines of each text that it has had before."""
    out = np.zeros(len(piece))
    for row in range(len(piece)):
        lines = piece.data[piece.bounds[row]: piece.bounds[row + 1]].tobytes().split(b"\n")
        out[row] = len(lines) - len(set(lines))
    return out


@dataclass
class Model:
    """Per class (0, 1): mean, inverse Cholesky factor and log determinant; then the curve."""
    means: np.ndarray
    whitening: np.ndarray
    log_dets: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        far = [np.square((x - m) @ w.T).sum(1) + d for m, w, d in zip(self.means, self.whitening, self.log_dets)]
        return np.clip((far[0] - far[1]) / 2, -MAX_DIFFERENCE, MAX_DIFFERENCE)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self.difference(x), -60, 60)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_common: float = TO_COMMON, to_round: float = TO_ROUND) -> Model:
    """From the moments of each class: number, sum and sum of outer products."""
    means = sums / counts[:, None]
    spread = squares / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    common = (counts[:, None, None] * spread).sum(0) / counts.sum() + 1e-6 * np.eye(sums.shape[1])
    whitening, log_dets = [], []
    for own in spread:
        # In units of the common spread, so that shrinking to the round one treats all statistics alike.
        unit = np.sqrt(np.diag(common))
        shrunk = ((1 - to_common - to_round) * own + to_common * common) / np.outer(unit, unit)
        shrunk += to_round * np.trace(shrunk) / len(unit) * np.eye(len(unit))
        factor = np.linalg.cholesky(shrunk * np.outer(unit, unit))
        whitening.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(means, np.stack(whitening), np.array(log_dets))


def _all(texts: pa.Array, scanner: Scanner) -> np.ndarray:
    parts = [statistics(piece) for piece in scanner.pieces(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _moments(batches):
    scanner, d = Scanner(), len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, y = _all(batch["t"], scanner), batch["y"].to_numpy(zero_copy_only=False) > 0
        for k, own in enumerate((x[~y], x[y])):
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    y, place = np.indices(total.shape)
    yield pa.record_batch({"y": pa.array(y.ravel()), "place": pa.array(place.ravel()), "v": pa.array(total.ravel())})


def _differences(model: Model):
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            steps = np.rint(model.difference(_all(batch["t"], scanner))).astype(np.int64)
            yield pa.record_batch({"y": batch["y"].cast(pa.int64()), "step": pa.array(steps)})

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out=None, id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_LABELLED) -> Model:
    """held_out: a condition on doc_id whose rows teach nothing. Only moments and counts per step come to the driver."""
    d = len(STATISTICS)
    known = labelled(docs, labels, label_col, F.lit(True) if held_out is None else ~held_out, id_col, text_col, max_rows).select("t", "y")
    rows = known.mapInArrow(_moments, "y long, place long, v double").groupBy("y", "place").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + d + d * d))
    total[rows["y"], rows["place"]] = rows["v"]
    if total[:, 0].min() == 0:
        share = (total[1, 0] + 0.5) / (total[:, 0].sum() + 1.0)
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), (float(np.log(share / (1 - share))), 0.0))
    model = fit(total[:, 0], total[:, 1: 1 + d], total[:, 1 + d:].reshape(2, d, d))
    steps = known.mapInArrow(_differences(model), "y long, step long").groupBy("step", "y").agg(F.count(F.lit(1)).alias("n")).toPandas()
    model.curve = fit_logistic(steps["step"].to_numpy(float), (steps["y"].to_numpy() > 0).astype(float), steps["n"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, log density difference, and the statistics by name."""
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            x = _all(batch["t"], scanner)
            yield pa.record_batch([batch["d"].cast(pa.int64()), pa.array(model.probability(x)), pa.array(model.difference(x)),
                                   *(pa.array(c) for c in x.T)], ["doc_id", "score", "difference", *STATISTICS])

    schema = ", ".join(["doc_id long", "score double", "difference double", *(f"{s} double" for s in STATISTICS)])
    return narrow(docs, d=id_col, t=text_col).mapInArrow(run, schema)


def held_out(modulus: int = 5, rest: int = 0):
    return remainder("doc_id", modulus) == rest
