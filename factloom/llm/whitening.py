"""Whitening of vectors by an incrementally kept eigendecomposition.

Every task holds the spectrum (count, mean, eigenvalues, eigenvectors) of the scatter of the rows it has seen and takes each further
row as one centred rank-one update: the secular equation gives the new eigenvalues, after deflation of entries that cannot change, and
Loewner's formula the eigenvectors. Spectra of tasks are combined by successive rank-one updates, one for each direction of the smaller one
and one for the difference of the means, eight spectra a group until one is left. Ritz steps over the whole fit list then bring the
leading directions to double precision: products of the centred rows with the basis are added up in tasks, only
matrices of vector length times basis size reach the driver.

Entries become x = floor(256 * c), as long (beyond its range: the nearest long). The fit list holds each distinct x vector once, so
copies of any number weigh as one row and are combined before the shuffle. Sums are exact.

Vectors that are null, empty or hold null or non-finite entries give no rows, nor do vectors of another length than the most frequent
one (of several, the longest). Rows with equal or null ids are rows of their own. A component without variance (fewer distinct vectors than
components) has a null whitened value and explained 0 (null where nothing varies at all); identity_error speaks of the others.
A deviation beyond the range of long is null. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.store import narrow, stored

SCALE = 256
COMPONENTS = 4
# Directions kept beyond the wanted ones, so that the last wanted one is told apart from the next.
GUARD = 4
COMBINED = 8
STEPS = 40
EPS = np.finfo(float).eps
SPECTRUM = "n long, mean array<double>, values array<double>, vectors array<double>"


@dataclass
class Spectrum:
    """Scatter around the mean of n rows: vectors @ diag(values) @ vectors.T, values ascending."""
    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        """One more row: its centred part, weighed n / (n + 1), is a rank-one update of the scatter."""
        centred = x - self.mean
        self.mean = self.mean + centred / (self.n + 1)
        self.values, self.vectors = updated(self.values, self.vectors, centred * np.sqrt(self.n / (self.n + 1)))
        self.n += 1

    def combine(self, other: Spectrum) -> Spectrum:
        """The spectrum of both row sets."""
        if self.n < other.n:
            return other.combine(self)
        if not other.n:
            return self
        out = Spectrum(self.n + other.n, self.mean, self.values, self.vectors)
        apart = other.mean - self.mean
        steps = [other.vectors[:, i] * np.sqrt(v) for i, v in enumerate(other.values) if v > 0]
        for step in [*steps, apart * np.sqrt(self.n * (other.n / out.n))]:
            out.values, out.vectors = updated(out.values, out.vectors, step)
        out.mean = self.mean + apart * (other.n / out.n)
        return out


def _gathered(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, near: float) -> None:
    """Within eigenvalues that are equal up to near, turn the vectors so that one of them takes the whole of z."""
    starts = np.flatnonzero(np.r_[True, np.diff(values) > near])
    for a, b in zip(starts, np.r_[starts[1:], len(values)]):
        if b - a > 1 and (size := np.linalg.norm(z[a:b])) > 0:
            w = z[a:b].copy()
            w[-1] += np.copysign(size, w[-1])
            w /= np.linalg.norm(w)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ w, w)
            kept = -np.copysign(size, z[b - 1])
            z[a:b] = 0
            z[b - 1] = kept


def _roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (d - mu)), one above each pole, as the nearer pole's index and the distance from it."""
    m, weight = len(d), z * z
    top = d[-1] + weight.sum()
    upper = np.r_[d[1:], top]
    middle = (d + upper) / 2
    at_middle = 1 + (weight / (d - middle[:, None])).sum(1)
    # A root in the upper half of its interval is measured from the upper pole; the last one has the lower pole only.
    right = (at_middle < 0) & (np.arange(m) < m - 1)
    origin = np.arange(m) + right
    poles = d - d[origin][:, None]
    gap = upper - d
    low = np.where(right, -gap / 2, np.where(at_middle < 0, gap / 2, 0.0))
    high = np.where(right, 0.0, np.where(at_middle < 0, gap, gap / 2))
    below = np.arange(m) <= np.arange(m)[:, None]
    # The last interval's upper end is no pole; a second one without weight far above stands in for it.
    left_pole, right_pole = d - d[origin], np.r_[d[1:], d[-1] + 4 * weight.sum()] - d[origin]
    at = (low + high) / 2
    for _ in range(100):
        part = 1 / (poles - at[:, None])
        terms = weight * part
        f = 1 + terms.sum(1)
        low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
        slopes = terms * part
        first = np.where(below, slopes, 0).sum(1)
        rest = slopes.sum(1) - first
        x, y = left_pole - at, right_pole - at
        # Both sides are matched in value and slope by one pole each; the root of that model is the next guess.
        c = f - x * first - y * rest
        a = (x + y) * f - x * y * (first + rest)
        b = x * y * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        guess = at + step
        ok = np.isfinite(guess) & (guess > low) & (guess < high)
        guess = np.where(ok, guess, (low + high) / 2)
        done = (np.abs(f) <= 2 * EPS * (1 + np.abs(terms).sum(1))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        at = np.where(done, at, guess)
        if done.all():
            break
    return origin, at


def updated(values: np.ndarray, vectors: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors after the outer product of step with itself is added."""
    length = np.linalg.norm(step)
    if not length > 0:
        return values, vectors
    z = vectors.T @ step
    scale = max(abs(values[-1]), length * length)
    vectors = vectors.copy()
    _gathered(values, vectors, z, 8 * EPS * scale)
    # Deflation: an entry that moves no eigenvalue by more than rounding does.
    live = np.flatnonzero(np.abs(z) * length > 8 * EPS * scale)
    if not len(live):
        return values, vectors
    d, w = values[live], z[live]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        origin, shift = _roots(d, w)
        # away[j, i] = d[j] - root[i], from differences of poles so that no digits are lost.
        away = (d[:, None] - d[origin]) - shift
        poles = d - d[:, None]
        np.fill_diagonal(poles, 1)
        paired = np.where(np.arange(len(d)) < np.arange(len(d))[:, None], poles, np.roll(poles, -1, axis=1))
        paired[:, -1] = 1
        sharp = np.copysign(np.sqrt(np.abs((-away / paired).prod(1))), w)
        turned = sharp[:, None] / away
    turned = np.where(np.isfinite(turned), turned, 0)
    norms = np.linalg.norm(turned, axis=0)
    odd = norms == 0
    turned[:, odd] = np.eye(len(d))[:, odd]
    turned /= np.where(odd, 1, norms)
    values = values.copy()
    values[live] = d[origin] + shift
    vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """d (id) and x (array of long) of every vector that is whole: neither null nor empty, all entries finite."""
    plain = narrow(vectors, d=id_col, v=vector_col).select(F.col("d").cast("long").alias("d"), F.col("v").cast("array<double>").alias("v"))
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return plain.filter(F.coalesce(whole, F.lit(False))).select("d", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(s: Spectrum) -> pa.RecordBatch:
    return pa.record_batch([pa.array([s.n], pa.int64()), *[pa.array([a.ravel()], pa.list_(pa.float64())) for a in (s.mean, s.values, s.vectors)]],
                           ["n", "mean", "values", "vectors"])


def _unpacked(row: dict) -> Spectrum:
    size = len(row["mean"])
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(size, size))


def spectrum(fit: DataFrame, size: int) -> Spectrum:
    """One spectrum of all rows x: one per task, then combined eight at a time. A spectrum has size * (size + 2) numbers."""
    def of_task(batches):
        own = Spectrum.empty(size)
        for batch in batches:
            for x in _matrix(batch["x"], size).astype(float):
                own.add(x)
        if own.n:
            yield _packed(own)

    def of_group(table: pa.Table) -> pa.Table:
        rows = [_unpacked(r) for r in table.to_pylist()]
        out = rows[0]
        for other in rows[1:]:
            out = out.combine(other)
        return pa.Table.from_batches([pa.record_batch([pa.array([0], pa.int64()), *_packed(out).columns], ["g", "n", "mean", "values", "vectors"])])

    schema = f"g long, {SPECTRUM}"
    parts = stored(fit.select("x").mapInArrow(of_task, SPECTRUM).withColumn("g", F.monotonically_increasing_id()), "whitening-spectra")
    while (left := parts.count()) > 1:
        numbered = parts.drop("g").withColumn("g", F.xxhash64("n", "mean") % F.lit(-(-left // COMBINED)))
        # Groups of uneven luck stay small all the same: a group is one of left / 8 hash values.
        parts = stored(numbered.groupBy("g").applyInArrow(of_group, schema), "whitening-spectra")
    return _unpacked(parts.first().asDict())


@dataclass
class Model:
    """n and sums of the fit list, exact; leading eigenvalues and unit vectors of its covariance, its trace and the identity error."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def able(self) -> np.ndarray:
        """Components with variance beyond rounding."""
        return self.values > 1e-13 * max(self.trace, 0) if self.trace > 0 else np.zeros(len(self.values), bool)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - self.mean) @ self.vectors / np.sqrt(np.where(self.able, self.values, np.nan))


def _added(fit: DataFrame, size: int, width: int, part) -> np.ndarray:
    """Sum over all rows of part(matrix of rows), a size x width matrix; each task sends one."""
    def run(batches):
        total = np.zeros((size, width))
        for batch in batches:
            x = _matrix(batch["x"], batch["x"].value_lengths()[0].as_py()) if batch.num_rows else np.zeros((0, 1))
            if len(x):
                total += part(x)
        yield pa.record_batch([pa.array(np.arange(size * width)), pa.array(total.ravel())], ["i", "v"])

    cells = fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size * width)
    for r in cells:
        out[r.i] = r.v
    return out.reshape(size, width)


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension."""
    def run(batches):
        n, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch["x"], size) if batch.num_rows else np.zeros((0, size), np.int64)
            safe = len(x) and max(abs(int(x.min())), abs(int(x.max()))) < 2**62 // max(len(x), 1)
            part = x.sum(0) if safe else x.astype(object).sum(0) if len(x) else []
            n, total = n + len(x), [a + int(b) for a, b in zip(total, part)] if len(x) else total
        yield pa.record_batch([pa.array(range(size + 1), pa.int64()), pa.array([str(v) for v in [n, *total]])], ["i", "v"])

    rows = fit.select("x").mapInArrow(run, "i long, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.i: int(r.v) for r in rows}
    return found[0], [found[i + 1] for i in range(size)]


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct x of the most frequent length once, stored; and that length (0: no rows)."""
    most = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    return stored(rows.filter(F.size("x") == size).select("x").distinct(), "whitening-fit"), size


def train(fit: DataFrame, size: int, components: int = COMPONENTS) -> Model:
    """Model of the fit list: incremental spectrum, then Ritz steps over all rows until the residuals are those of rounding."""
    n, sums = _sums(fit, size)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    basis = spectrum(fit, size).vectors[:, ::-1][:, :min(size, components + GUARD)]
    width = basis.shape[1]

    def products(q):
        def part(x):
            c = x - mean
            return np.hstack([c.T @ (c @ q), (c * c).sum(0)[:, None]])
        return part

    for _ in range(STEPS):
        basis = np.linalg.qr(basis)[0]
        added = _added(fit, size, width + 1, products(basis)) / n
        image, trace = added[:, :width], float(added[:, width].sum())
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = basis @ turn, image @ turn
        apart = np.linalg.norm(image - vectors * values, axis=0)[:components]
        if not trace > 0 or (apart <= 1e-13 * np.sqrt(size) * max(values[0], 0)).all():
            break
        basis = image
    vectors /= np.linalg.norm(vectors, axis=0)
    model = Model(n, sums, np.maximum(values[:components], 0), vectors[:, :components], trace)
    keep = np.flatnonzero(model.able)
    if len(keep):
        def moments(x):
            w = model.whitened(x)[:, keep]
            return np.vstack([w.T @ w, w.sum(0)])
        total = _added(fit, len(keep) + 1, len(keep), moments) / n
        cov = total[:-1] - np.outer(total[-1], total[-1])
        model.identity_error = float(np.abs(cov - np.eye(len(keep))).max())
    return model


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """One row per vector (d, x) and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    k, size, mean = len(model.values), len(model.sums), model.mean
    largest = max(abs(s) for s in model.sums)

    def deviations(x):
        # n * x - S stays in long where a cheap bound says so; else Python's integers, null beyond long.
        reach = max(abs(int(x.min())), abs(int(x.max()))) * model.n + largest
        if size * reach * reach < 2**63:
            return ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums)) for row in x]
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        scale = np.sqrt(np.where(model.able, model.values, np.nan))
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch["x"], size)
            whitened = (x - mean) @ model.vectors / scale
            dev = deviations(x)
            yield pa.record_batch([
                batch["d"].take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array([v for v in dev for _ in range(k)], pa.int64()), pa.array(whitened.ravel(), from_pandas=True)], ["vec_id", "component", "deviation", "whitened"])

    told = rows.filter(F.size("x") == size).select("d", "x").mapInArrow(run, "vec_id long, component int, deviation long, whitened double")
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("component"))
    return told.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
                       F.lit(model.identity_error).cast("double").alias("identity_error"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every whole vector."""
    rows = entries(vectors, id_col, vector_col)
    fit, size = fit_list(rows)
    if not size:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return apply(rows, train(fit, size, components))
