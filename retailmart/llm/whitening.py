"""Whitening of vectors along the principal directions of their covariance.

1. Grouped sums give the mean of every dimension; entries are whole numbers, so it is exact.
2. Tasks reduce the centred rows of their partition block by block to an upper triangle R with
   Householder QR; the triangles of SPAN tasks at a time are reduced to one, until one is left.
   No covariance matrix is formed: R's singular values are those of all centred rows.
3. R, which has no more rows than a vector has entries, is brought to bidiagonal form by
   Householder reflections on the driver. dqds finds its singular values to high relative
   accuracy, and twisted factorisations of the shifted tridiagonal matrix find its right singular
   vectors, which are turned back into directions. Directions whose singular values nearly
   agree are found by inverse iteration on that matrix, each orthogonal to those before it, and
   turned by one-sided Jacobi rotations.
4. A last pass projects the centred rows on the directions and divides by the deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailmart.llm.common import stored

SCALE, OFFSET = 64, 1_000_000  # an entry c counts as floor(SCALE * c) + OFFSET
LARGEST = 2.0**62  # of a scaled entry
ROWS_A_BLOCK = 4096
SPAN = 32  # triangles that are reduced to one at a time
CLOSE = 1e-3  # relative gap of squared singular values below which directions are found together
EPS = np.finfo(float).eps


# ------------------------------------------------------------------- singular value problem


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = U B v' for orthogonal U and v; B has a on its diagonal and b above it."""
    r, d = r.copy(), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        top = np.abs(x).max(initial=0.0)
        if top == 0 or not np.abs(x[1:]).max(initial=0.0):
            return None
        h = x / top
        h[0] += np.copysign(np.linalg.norm(h), h[0])
        return h / np.linalg.norm(h)

    for k in range(d):
        h = reflector(r[k:, k])
        if h is not None:
            r[k:, k:] -= 2 * np.outer(h, h @ r[k:, k:])
        if k < d - 2:
            h = reflector(r[k, k + 1 :])
            if h is not None:
                r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ h, h)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential quotient-difference step with a shift: (q, e, least d); None if the shift is
    beyond the smallest value."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:  # d and e are zero: the value below stands alone
            new_e[i] = 0.0
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / new_q[i]
            new_e[i] = e[i] * t
            d = d * t - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, least


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, falling, by dqds.

    The smallest value is held in a bracket: a shift that fails, and the least d of one that does
    not, bound it from above, and the shifts taken so far from below. The next shift is a part
    of the bracket, a larger one the longer shifts succeed.
    """
    scale = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(a))
    found: list[float] = []
    todo = [((a / scale) ** 2, (b / scale) ** 2, 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        high, part = np.inf, 0.5
        while len(q) > 1:
            small = 64 * EPS * EPS * (sigma + np.minimum(q[:-1], q[1:])) + np.finfo(float).tiny
            cut = np.flatnonzero(e <= small)
            if len(cut):  # the matrix falls into two
                k = int(cut[-1]) + 1
                todo.append((q[:k], e[: k - 1], sigma))
                q, e, high, part = q[k:], e[k:], np.inf, 0.5
                continue
            if q[0] < q[-1] / 1.5:  # small values belong at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            high = min(high, q.min())
            shift = part * high if sigma + part * high > sigma else 0.0
            stepped = _step(q, e, shift)
            if stepped is None:
                high, part = shift, min(part, 0.5)
                continue
            q, e, bound = stepped
            sigma += shift
            high = min(high - shift, bound)
            part = 1 - (1 - part) / 4 if part < 0.999 else part
        found.extend(sigma + q)
    return np.sort(np.array(found))[::-1] * scale**2


@dataclass(frozen=True)
class Tridiagonal:
    """B'B of a bidiagonal B as L D L': d on the diagonal of D, low below the ones of L."""

    d: np.ndarray
    low: np.ndarray

    def factors(self, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Stationary and progressive factors of L D L' - value, and the place of the best twist."""
        d, low, n = self.d, self.low, len(self.d)
        tiny = np.finfo(float).tiny * 2**60
        plus, lower, s = np.empty(n), np.empty(n - 1), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            plus[i] = s[i] + d[i] or tiny
            lower[i] = d[i] * low[i] / plus[i]
            s[i + 1] = lower[i] * low[i] * s[i] - value
        plus[-1] = s[-1] + d[-1] or tiny
        minus, upper, p = np.empty(n), np.empty(n - 1), np.empty(n)
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            minus[i + 1] = d[i] * low[i] ** 2 + p[i + 1] or tiny
            t = d[i] / minus[i + 1]
            upper[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        minus[0] = p[0] or tiny
        gamma = np.abs(s + p + value)
        return plus, lower, minus, upper, int(np.nanargmin(gamma))

    def vector(self, value: float) -> np.ndarray:
        """The unit vector of a value that stands apart: zero residual but at the twist."""
        _, lower, _, upper, r = self.factors(value)
        z = np.zeros(len(self.d))
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, len(z) - 1):
            z[i + 1] = -upper[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, value: float, x: np.ndarray) -> np.ndarray:
        """About (L D L' - value)^-1 x, by elimination with row exchanges, scaled to length 1."""
        n, off = len(self.d), self.d[:-1] * self.low
        diagonal = self.d - value
        diagonal[1:] += off * self.low
        least = EPS * (np.abs(self.d).max() + np.abs(off).max(initial=0.0))
        rows = [[diagonal[0], off[0] if n > 1 else 0.0, 0.0]]  # finished rows: entries i, i + 1, i + 2
        y = x.tolist()
        for i in range(n - 1):
            after = [off[i], diagonal[i + 1], off[i + 1] if i + 2 < n else 0.0]
            if abs(after[0]) > abs(rows[i][0]):
                rows[i], after = after, rows[i]
                y[i], y[i + 1] = y[i + 1], y[i]
            pivot = rows[i][0] = rows[i][0] or least
            t = after[0] / pivot
            rows.append([after[1] - t * rows[i][1], after[2] - t * rows[i][2], 0.0])
            y[i + 1] -= t * y[i]
        z = np.zeros(n + 2)
        for i in range(n - 1, -1, -1):
            pivot, one, two = rows[i]
            z[i] = (y[i] - one * z[i + 1] - two * z[i + 2]) / (pivot if abs(pivot) > least else least)
            if abs(z[i]) > 1e100:
                z, y = z * 1e-100, [v * 1e-100 for v in y]
        return z[:n] / (np.linalg.norm(z) or 1.0)


def _together(matrix: Tridiagonal, values: np.ndarray, before: np.ndarray, seed: int) -> np.ndarray:
    """Vectors of neighbouring values, by inverse iteration, orthogonal to each other and to
    ``before``, and turned within their space so that each belongs to its own value."""
    rng = np.random.default_rng(seed)
    found = before
    for value in values:
        z = rng.standard_normal(len(matrix.d))
        for _ in range(4):
            for _ in range(2):
                z -= found @ (found.T @ z)
            z = matrix.solve(value, z / np.linalg.norm(z))
        for _ in range(2):
            z -= found @ (found.T @ z)
        found = np.column_stack((found, z / np.linalg.norm(z)))
    own = found[:, before.shape[1] :]
    rows = np.sqrt(matrix.d)[:, None] * (own + np.vstack((matrix.low[:, None] * own[1:], np.zeros((1, own.shape[1])))))
    turn = np.eye(own.shape[1])
    for _ in range(30):  # one-sided Jacobi: make the images of the vectors orthogonal
        off = 0.0
        for i in range(own.shape[1]):
            for j in range(i + 1, own.shape[1]):
                x, y = rows[:, i], rows[:, j]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= EPS * np.sqrt(xx * yy):
                    continue
                off = max(off, abs(xy) / np.sqrt(xx * yy))
                zeta = (yy - xx) / (2 * xy)
                t = np.copysign(1.0, zeta) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                spin = np.array([[c, c * t], [-c * t, c]])
                rows[:, [i, j]] = rows[:, [i, j]] @ spin
                turn[:, [i, j]] = turn[:, [i, j]] @ spin
        if off <= 8 * EPS:
            break
    order = np.argsort(-(rows**2).sum(0), kind="stable")
    return (own @ turn)[:, order]


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values of r, falling; unit right singular vectors as columns for the
    first ``most``, fewer if r has a smaller rank within rounding)."""
    a, b, v = bidiagonal(r)
    squares = squared_singular_values(a, b)
    rank = int((squares > (len(r) * EPS * 4) ** 2 * squares.max(initial=0.0)).sum())
    wanted = min(most, rank)
    if not wanted:
        return squares, np.zeros((len(r), 0))
    floor = EPS * EPS * np.sqrt(squares[0])
    a = np.where(np.abs(a) < floor, floor, np.abs(a)) * np.where(a < 0, -1.0, 1.0)
    ends = [0, *(np.flatnonzero(np.abs(b) <= EPS * np.sqrt(squares[0])) + 1).tolist(), len(a)]
    parts = []  # blocks of B that don't touch, each with its own values
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        own = squared_singular_values(a[low:high], b[low : high - 1])
        parts.append((low, Tridiagonal(a[low:high] ** 2, b[low : high - 1] / a[low : high - 1]), own))
    z, value = [], []
    for low, matrix, own in parts:
        last = int((own >= squares[wanted - 1] * (1 - CLOSE)).sum())
        i, done = 0, np.zeros((len(own), 0))
        while i < last:
            j = i + 1
            while j < len(own) and own[j - 1] - own[j] <= CLOSE * own[j - 1]:
                j += 1
            if j == i + 1:
                block = matrix.vector(own[i])[:, None]
            else:
                block = _together(matrix, own[i:j], done, i)
            done = np.column_stack((done, block))
            full = np.zeros((len(a), j - i))
            full[low : low + len(own)] = block
            z.append(full)
            value.append(own[i:j])
            i = j
    z, value = np.column_stack(z), np.concatenate(value)
    order = np.argsort(-value, kind="stable")[:wanted]
    return squares, v @ z[:, order]


# ---------------------------------------------------------------------------- rows in tasks


def _vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole-numbered entries without the offset) of its usable vectors, for
    each length."""
    lists = batch.column(column)
    lists = lists.cast(pa.large_list(pa.float64()))
    size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = lists.flatten()
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(size)))
    with np.errstate(over="ignore", invalid="ignore"):
        good = np.abs(flat * SCALE) < LARGEST
    bad = np.concatenate(([0], np.cumsum(~good)))
    usable = (bad[before[1:]] == bad[before[:-1]]) & (size > 0)
    for d in np.unique(size[usable]):
        at = np.flatnonzero(usable & (size == d))
        for i in range(0, len(at), ROWS_A_BLOCK):
            own = at[i : i + ROWS_A_BLOCK]
            entries = flat[before[own][:, None] + np.arange(d)]
            yield own, np.floor(entries * SCALE).astype(np.int64)


def _sums(batches) -> Iterator[pa.RecordBatch]:
    """(length, place, sum): entries' sums for each length; at place -1 the number of vectors."""
    rows: dict[int, list[int]] = {}
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for own, y in _vectors(batch, 0):
            d = y.shape[1]
            exact = np.abs(y).max() < 2**40
            rows[d] = rows.get(d, 0) + len(own)
            part = y.sum(0) if exact else y.astype(object).sum(0)
            totals[d] = totals.get(d, np.zeros(d, object)) + part.astype(object)
    out = [(d, -1, n) for d, n in rows.items()] + [(d, i, int(s)) for d, t in totals.items() for i, s in enumerate(t)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
         pa.array([Decimal(r[2]) for r in out], pa.decimal128(38, 0))],
        ["length", "place", "sum"],
    )


def _triangle(blocks) -> np.ndarray | None:
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack((r, block)), mode="r")
    return r


def _reduce(batches, mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    d = len(mean)
    r = _triangle(y - mean for batch in batches for _, y in _vectors(batch, 0) if y.shape[1] == d)
    rows = [] if r is None else [r.tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["r"])


def _combine(rows: pa.Table, d: int) -> pa.Table:
    order = np.argsort(rows.column("number").to_numpy())
    stacked = [np.frombuffer(rows.column("r")[int(i)].as_py(), np.float64).reshape(-1, d) for i in order]
    return pa.table({"r": pa.array([_triangle(stacked).tobytes()], pa.binary())})


def _products(batches, mean: np.ndarray, project: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(i, j, sum) of products of whitened entries i <= j; at j = -1 the sums of entries."""
    d, k = project.shape
    sums, products = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        for _, y in _vectors(batch, 0):
            if y.shape[1] == d:
                w = (y - mean) @ project
                sums += w.sum(0)
                products += w.T @ w
    i, j = np.triu_indices(k)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*range(k), *i.tolist()], pa.int64()), pa.array([*[-1] * k, *j.tolist()], pa.int64()),
         pa.array([*sums.tolist(), *products[i, j].tolist()], pa.float64())],
        ["i", "j", "sum"],
    )


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the entries of (n * y - sum)^2; null where it needs more than 64 bits."""
    s = np.array(sums, object)
    rough = np.abs(y.astype(np.float64) * n - s.astype(np.float64))
    if n * float(np.abs(y).max()) < 2.0**61 and float((rough**2).sum(1).max()) < 2.0**61:
        return pa.array(((y * n - s.astype(np.int64)) ** 2).sum(1), pa.int64())
    exact = ((y.astype(object) * n - s) ** 2).sum(1)
    return pa.array([int(x) if x < 1 << 63 else None for x in exact], pa.int64())


def _whiten(batches, n: int, sums: list[int], mean: np.ndarray, project: np.ndarray) -> Iterator[pa.RecordBatch]:
    d, k = project.shape
    for batch in batches:
        for own, y in _vectors(batch, 1):
            if y.shape[1] != d or not k:
                continue
            w = (y - mean) @ project
            row = pa.array(np.repeat(own, k))
            numbers = np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))
            deviation = _deviations(y, n, sums).take(pa.array(np.repeat(np.arange(len(own)), k)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), pa.array(numbers), deviation, pa.array(w.reshape(-1))],
                ["id", "component", "deviation", "whitened"],
            )


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # of the entries without the offset
    mean: np.ndarray
    variances: np.ndarray  # of all components, falling
    directions: np.ndarray  # of the components kept, as columns

    @property
    def project(self) -> np.ndarray:
        return self.directions / np.sqrt(self.variances[: self.directions.shape[1]])

    @property
    def explained(self) -> np.ndarray:
        return self.variances[: self.directions.shape[1]] / (self.variances.sum() or 1.0)


def _one_triangle(plain: DataFrame, mean: np.ndarray) -> np.ndarray:
    d = len(mean)
    parts = plain.select("v").mapInArrow(partial(_reduce, mean=mean), "r binary")
    parts = stored(parts.withColumn("number", F.spark_partition_id().cast("bigint")), "triangles")
    while (parts.agg(F.max("number")).first()[0] or 0) > 0:
        number = F.floor(F.col("number") / SPAN).alias("group")
        less = parts.groupBy(number).applyInArrow(
            lambda key, rows: _combine(rows, d).append_column("number", pa.array([key[0].as_py()], pa.int64())),
            "r binary, number bigint",
        )
        parts = stored(less, "triangles")
    r = np.frombuffer(parts.first()["r"], np.float64).reshape(-1, d)
    return np.vstack((r, np.zeros((d - len(r), d))))


def fit(rows: DataFrame, most: int = 32, vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of the commonest length; None if there is none."""
    plain = rows.select(F.col(f"`{vector}`").alias("v"))
    found = plain.mapInArrow(_sums, "length bigint, place bigint, sum decimal(38,0)")
    of_length = stored(found.groupBy("length", "place").agg(F.sum("sum").cast("decimal(38,0)").alias("sum")), "sums")
    commonest = of_length.where("place = -1").orderBy(F.desc("sum"), F.desc("length")).first()
    if commonest is None:
        return None
    d, n = commonest["length"], int(commonest["sum"])
    own = of_length.where((F.col("length") == d) & (F.col("place") >= 0)).orderBy("place").collect()
    sums = [int(r["sum"]) for r in own]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    squares, directions = right_singular(_one_triangle(plain, mean), most)
    return Whitening(n, sums, mean, squares / n, directions)


def identity_error(rows: DataFrame, fitted: Whitening, vector: str = "embedding") -> float:
    """The largest entry, as to size, of the whitened rows' covariance minus the identity."""
    plain = rows.select(F.col(f"`{vector}`").alias("v"))
    parts = plain.mapInArrow(partial(_products, mean=fitted.mean, project=fitted.project), "i bigint, j bigint, sum double")
    worst = 0.0
    sums = {(r["i"], r["j"]): r["sum"] / fitted.n for r in parts.groupBy("i", "j").agg(F.sum("sum").alias("sum")).collect()}
    for (i, j), value in sums.items():
        if j >= 0:
            worst = max(worst, abs(value - sums[i, -1] * sums[j, -1] - (i == j)))
    return worst


def whiten(rows: DataFrame, fitted: Whitening, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id column, component, deviation, whitened, explained) for each usable vector and component."""
    plain = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(
        partial(_whiten, n=fitted.n, sums=fitted.sums, mean=fitted.mean, project=fitted.project),
        f"id {kind}, component int, deviation bigint, whitened double",
    )
    shares = F.array(*[F.lit(float(x)) for x in fitted.explained]) if len(fitted.explained) else F.array().cast("array<double>")
    return out.select(F.col("id").alias(id), "component", "deviation", "whitened", F.get(shares, F.col("component") - 1).alias("explained"))


def whitened_components(rows: DataFrame, most: int = 32, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id column, component, n, deviation, whitened, explained, identity_error) for each vector and
    component from 1 to ``most``, by falling variance.

    A vector is usable if neither it nor an entry is null, all entries are finite and, times 64,
    below 2^62; it counts if it has the commonest length (of equally common ones the longest), as
    vectors of other lengths have no common covariance. Others have no rows. Components whose
    variance is zero within rounding have none either: whitening is not defined for them, so that
    a single vector, equal vectors, or an empty table give no rows. ``deviation`` is null where it
    needs more than 64 bits. Equal rows and null ids come back as often as they came; other columns
    are not read.
    """
    fitted = fit(rows, most, vector)
    if fitted is None or not fitted.directions.shape[1]:
        kind = rows.schema[id].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{id}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(rows, fitted, vector)
    return whiten(rows, fitted, id, vector).select(
        id, "component", F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")
    )
