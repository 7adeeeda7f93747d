"""Whitening of embeddings by an incremental eigendecomposition.

Entries are put on a whole-number grid.  Each task keeps the spectrum of what it has read: number, sums, and the eigenvectors and
eigenvalues of the centred scatter.  New rows enter as centred rank-one updates: an update rotates into the eigenbasis,
sets apart what does not change (deflation), finds the new eigenvalues as roots of the secular equation between
the old ones, and the new eigenvectors from them.  Spectra of tasks are combined in a reduction tree, again by rank-one
updates, one per eigenvector and one for the distance between the two means.  The basis so found is then refined
by a distributed Rayleigh-Ritz step: the scatter is measured exactly in that basis by a pass over all rows, and its
small eigenproblem turns the basis.  States have the size of a d x d matrix, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, slices, stored

by_value(__name__)

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows that enter together, as a multiple of the dimension; states that one call of the reduction tree combines.
SLICE, FAN = 32, 8
EPS = np.finfo(float).eps
#: Grid values beyond this are no exact long after the shift.
FAR = float(2 ** 62)


def secular(poles: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z ** 2 / (poles - x)) = 0, one above each pole (ascending, apart; no z is 0).

    Returns (nearest pole's number, distance from it): roots are known relative to a pole, so no digits cancel.
    """
    k = len(poles)
    weight = z * z
    upper = np.append(poles[1:], poles[-1] + weight.sum())
    gap = upper - poles
    middle = poles + gap / 2
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        right = 1.0 + (weight / (poles[None, :] - middle[:, None])).sum(axis=1) < 0  # the root is in the right half
        right[-1] = False
        origin = np.arange(k) + right
        low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
        high[-1] = gap[-1]
        apart = poles[None, :] - poles[origin][:, None]
        below = np.tri(k, dtype=bool)  # poles up to each root's own
        near, far = apart[np.arange(k), np.arange(k)], upper - poles[origin]
        x = (low + high) / 2
        for _ in range(80):
            ratio = weight / (apart - x[:, None])
            slope = ratio / (apart - x[:, None])
            value = 1.0 + ratio.sum(axis=1)
            size = 1.0 + np.abs(ratio).sum(axis=1)
            low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
            done = (np.abs(value) <= 8 * EPS * size) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
            if done.all():
                break
            # A rational step with the two poles around the root.
            left, rest = np.where(below, slope, 0.0).sum(axis=1), np.where(below, 0.0, slope).sum(axis=1)
            a, b = near - x, far - x
            c = value - a * left - b * rest
            p, q = (a + b) * value - a * b * (left + rest), a * b * value
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            new = x + step
            inside = np.isfinite(new) & (new > low) & (new < high)
            x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return origin, x


class Spectrum:
    """Number of rows, their sums (whole numbers), and ``vectors diag(values) vectors.T``, the scatter about their mean."""

    def __init__(self, d: int):
        self.n, self.sums = 0, np.zeros(d, dtype=object)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=float)

    def update(self, v: np.ndarray) -> None:
        """Adds ``v v.T`` to the scatter."""
        z = self.vectors.T @ v
        norm = np.sqrt(z @ z)
        if norm == 0:
            return
        tiny = 8 * EPS * max(self.values[-1], norm * norm)
        values, vectors = self.values, self.vectors
        # Deflation: of eigenvalues that lie together one direction takes the whole update, the others none.
        ends = np.flatnonzero(np.diff(values) > tiny) + 1
        if len(ends) + 1 < len(values):
            for first, last in zip(np.append(0, ends), np.append(ends, len(values)), strict=True):
                if last - first > 1:
                    part = z[first:last]
                    size = np.sqrt(part @ part)
                    if size == 0:
                        continue
                    mirror = part.copy()
                    mirror[-1] += np.copysign(size, part[-1])
                    mirror /= np.sqrt(mirror @ mirror)
                    block = vectors[:, first:last]
                    vectors[:, first:last] = block - 2.0 * np.outer(block @ mirror, mirror)
                    z[first:last] = part - 2.0 * mirror * (mirror @ part)
                    z[first:last - 1] = 0.0
        # Deflation: directions that the update does not reach keep their eigenvalue.
        hit = np.abs(z) * norm > tiny
        if not hit.any():
            return
        poles, weights = values[hit], z[hit]
        origin, x = secular(poles, weights)
        # The update whose roots these are exactly; its eigenvectors are orthogonal to working precision.
        apart = poles[None, :] - poles[origin][:, None] - x[:, None]  # pole j minus root i
        ratio = poles[None, :] - poles[:, None]
        np.fill_diagonal(ratio, 1.0)
        exact = np.sqrt(np.abs(np.prod(apart / ratio, axis=0)))
        turn = np.copysign(exact, weights)[None, :] / apart
        turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
        vectors[:, hit] = vectors[:, hit] @ turn.T
        values[hit] = poles[origin] + x
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def add(self, rows: np.ndarray) -> None:
        """More rows (whole numbers).

        They are centred on their mean and turned among themselves, which leaves their scatter as it is and all but d
        of them zero; zero rows are deflated whole, the others are rank-one updates, as is the step between the means.
        """
        other = Spectrum.__new__(Spectrum)
        other.n, other.sums = len(rows), exact_sums(rows)
        base = rows[0]
        part = (rows - base).astype(float)
        part -= part.mean(axis=0)
        if len(part) > part.shape[1]:
            part = np.linalg.qr(part, mode="r")
        self._join(other, part)

    def merge(self, other: Spectrum) -> None:
        self._join(other, (other.vectors * np.sqrt(np.maximum(other.values, 0.0))).T[::-1])

    def _join(self, other: Spectrum, updates: np.ndarray) -> None:
        for v in updates:
            self.update(v)
        if self.n and other.n:
            # The means' distance from whole numbers, so that large values cancel exactly.
            both = self.n * other.n
            step = np.array([(a * other.n - b * self.n) / both for a, b in zip(self.sums, other.sums, strict=True)])
            self.update(step * np.sqrt(both / (self.n + other.n)))
        self.n, self.sums = self.n + other.n, self.sums + other.sums

    def pack(self) -> dict:
        return {"n": self.n, "sums": [str(s) for s in self.sums], "state": np.concatenate([self.values, self.vectors.ravel()]).tobytes()}

    @staticmethod
    def unpack(row: dict) -> Spectrum:
        out = Spectrum.__new__(Spectrum)
        d = len(row["sums"])
        out.n, out.sums = row["n"], np.array([int(s) for s in row["sums"]], dtype=object)
        state = np.frombuffer(row["state"]).copy()
        out.values, out.vectors = state[:d], state[d:].reshape(d, d)
        return out


def exact_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums in whole numbers of any size."""
    if len(rows) * float(np.abs(rows).max(initial=0)) < FAR:
        return np.array([int(s) for s in rows.sum(axis=0)], dtype=object)
    return rows.astype(object).sum(axis=0)


def on_grid(batch, d: int) -> np.ndarray:
    return np.asarray(batch.column(batch.num_columns - 1).flatten(), dtype=np.int64).reshape(-1, d)


STATE = "id long, n long, sums array<string>, state binary"


def reduced(states: DataFrame, combine, schema: str) -> DataFrame:
    """Folds rows (id from 0, state) in a tree, ``FAN`` neighbours at a time, in the order of their ids: one row is left.

    The number of tasks is all that the driver knows of them.
    """
    states = stored(states, "whitening-states")
    width = states.agg(F.max("id").alias("m")).first()["m"]

    def fold(key, table):
        import pyarrow as pa

        rows = table.sort_by("id").to_pylist()
        return pa.Table.from_pylist([combine(rows) | {"id": key[0].as_py()}], schema=table.schema)

    while width:
        states = states.groupBy(F.floor(F.col("id") / FAN).cast("long").alias("to")).applyInArrow(fold, schema)
        width //= FAN
    return states


def fit(grid: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums, eigenvalues falling, eigenvectors as columns) of the covariance of ``grid`` (x array<bigint> of length d)."""
    rows = max(256, SLICE * d)

    def read(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        found = Spectrum(d)
        held, size = [], 0
        for batch in batches:
            for part in slices([batch], rows):
                x = on_grid(part, d)
                if len(x):
                    held.append(x)
                    size += len(x)
                if size >= rows:
                    found.add(np.concatenate(held))
                    held, size = [], 0
        if size:
            found.add(np.concatenate(held))
        if found.n:
            yield pa.RecordBatch.from_pylist([found.pack() | {"id": TaskContext.get().partitionId()}], schema=pa.schema([
                ("id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("state", pa.binary())]))

    def combine(rows: list[dict]) -> dict:
        first = Spectrum.unpack(rows[0])
        for row in rows[1:]:
            first.merge(Spectrum.unpack(row))
        return first.pack()

    found = Spectrum.unpack(reduced(grid.select("x").mapInArrow(read, STATE), combine, STATE).first().asDict())
    # Rayleigh-Ritz: the scatter measured in the basis found, and the basis turned by its eigenvectors.
    basis, _ = np.linalg.qr(found.vectors)
    base, rest = centre(found.n, found.sums)
    measured = measure(grid, d, base, rest, basis, None)
    values, turn = np.linalg.eigh((measured + measured.T) / (2.0 * found.n))
    vectors = (basis @ turn)[:, ::-1]
    lead = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[lead, np.arange(d)] < 0, -1.0, 1.0)  # the largest entry of each is positive
    return found.n, found.sums, np.maximum(values[::-1], 0.0), np.ascontiguousarray(vectors)


def centre(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers plus a rest below 1: large values cancel before anything is rounded."""
    base = [int(s) // n for s in sums]
    return np.array(base, dtype=np.int64), np.array([(int(s) - n * b) / n for s, b in zip(sums, base, strict=True)], dtype=float)


def measure(grid: DataFrame, d: int, base: np.ndarray, rest: np.ndarray, basis: np.ndarray, scale: np.ndarray | None) -> np.ndarray:
    """Sum over all rows of p p.T, where p is the centred row in the basis (times ``scale``); summed pairwise in a tree."""
    def read(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total, seen = np.zeros((basis.shape[1], basis.shape[1])), False
        for batch in batches:
            for part in slices([batch], 4096):
                p = ((on_grid(part, d) - base).astype(float) - rest) @ basis
                p = p if scale is None else p * scale
                total += p.T @ p
                seen = True
        if seen:
            yield pa.RecordBatch.from_pylist([{"id": TaskContext.get().partitionId(), "state": total.tobytes()}], schema=pa.schema([("id", pa.int64()), ("state", pa.binary())]))

    def combine(rows: list[dict]) -> dict:
        return {"state": sum(np.frombuffer(r["state"]) for r in rows).tobytes()}

    total = reduced(grid.select("x").mapInArrow(read, "id long, state binary"), combine, "id long, state binary").first()["state"]
    return np.frombuffer(total).reshape(basis.shape[1], basis.shape[1])


def squares(n: int, y: np.ndarray, whole: np.ndarray) -> list[int | None]:
    """Row sums of (n * y - whole) ** 2 in whole numbers; null where one fits no long."""
    d, most = y.shape[1], (float(np.abs(y).max(initial=0)) + 1.0) * n  # |whole| < n
    if most < 2 ** 31 / np.sqrt(d):
        far = n * y - whole.astype(np.int64)
        return (far * far).sum(axis=1).tolist()
    if most < 2 ** 50 and d < 2 ** 12:  # in two halves of 25 bits, whose products and sums fit a long
        far = n * y - whole.astype(np.int64)
        high, low = far >> 25, far & (2 ** 25 - 1)
        parts = zip(*((p * q).sum(axis=1).tolist() for p, q in ((high, high), (high, low), (low, low))), strict=True)
        sums = [(a << 50) + (b << 26) + c for a, b, c in parts]
    else:
        far = n * y.astype(object) - whole
        sums = [int(s) for s in (far * far).sum(axis=1)]
    return [s if s < 2 ** 63 else None for s in sums]


RESULT = "{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): each row's whitened coordinates, one row per component.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, as are those whose entries on the grid
    fit no long, and vectors of another length than the most frequent one (the larger of two as frequent).  Rows with a null or
    repeated key are kept, each as a row.  A component without variance (equal rows, fewer rows than components) has
    ``whitened`` null and ``explained`` 0, and stays out of ``identity_error``; without any variance both are null.
    ``deviation`` is null where it fits no long.  Of eigenvectors the largest entry is positive.  Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = RESULT.format(key=f"`{key}`", kind=kind)
    good = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) * scale < FAR)) & (F.size("v") > 0)
    given = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where(F.coalesce(good, F.lit(False)))
    common = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    grid = given.where(F.size("v") == d).select("key", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x"))
    n, sums, values, basis = fit(grid, d)
    base, rest = centre(n, sums)
    k = min(components, d)
    live = values[:k] > 1e-12 * max(values[0], EPS)
    with np.errstate(divide="ignore"):
        factor = np.where(live, 1.0 / np.sqrt(values[:k]), 0.0)
    total = float(values.sum())
    explained = values[:k] / total if total > 0 else np.full(k, np.nan)
    error = None
    if live.any():  # measured on what is returned, by one more pass
        seen = measure(grid, d, base, rest, basis[:, :k][:, live], factor[live]) / n
        error = float(np.abs(seen - np.eye(int(live.sum()))).max())
    mean_times = [int(s) - n * int(b) for s, b in zip(sums, base, strict=True)]
    projection = basis[:, :k]

    def project(batches):
        import pyarrow as pa

        whole = np.array(mean_times, dtype=object)
        for batch in batches:
            for part in slices([batch], 2048):
                m = part.num_rows
                y = on_grid(part, d) - base
                deviation = squares(n, y, whole)
                out = ((y.astype(float) - rest) @ projection) * factor
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(out.ravel(), mask=np.tile(~live, m)), pa.array(np.tile(explained, m), mask=np.full(m * k, total <= 0)),
                    pa.array([error] * (m * k), pa.float64()),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(project, schema)
