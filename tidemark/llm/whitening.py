"""Whitening of embeddings through polarised variances.

For whole numbers, cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. So one kind of statistic is enough,
the sum of squares of a centred column, taken for each dimension and for the sum of each pair of
dimensions. Those sums are exact: every task adds up its rows in whole numbers, and what it sends
is cut into limbs of 40 bits, whose sums cannot overflow. The matrix that they give goes to an
eigensolver; vectors are then projected row by row.

Three passes over the table, none of which shuffles a vector. Tasks send one row per dimension, then one per
pair of dimensions, then one per pair of components; these are summed by key, and the driver sees the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT; values beyond LARGEST stand at it, so that x fits a long
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 1 << 61
LIMB, LIMBS = 40, 6
BLOCK = 4_096


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the vectors of ``dims`` finite entries, and which rows of ``column`` they are."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]


def _whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT


def _sums(x: np.ndarray) -> list[int]:
    fits = float(np.abs(x.astype(float)).max(initial=0.0)) * len(x) < 2.0**62
    return [int(v) for v in (x if fits else x.astype(object)).sum(axis=0)]


def _limbs(value: int) -> list[int]:
    """``value`` in base 2**LIMB; the last limb has the sign."""
    low = [(value >> LIMB * k) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*low, value >> LIMB * (LIMBS - 1)]


def _exact_sums(df: DataFrame, dims: int, sums_of: Callable[[np.ndarray], list[int]]) -> tuple[int, list[int]]:
    """(n, sums over all rows): ``sums_of`` gives those of a block of x-vectors as whole numbers."""
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _whole(matrix(batch.column(0), dims)[1])
            for at in range(0, len(x), BLOCK):
                part = sums_of(x[at : at + BLOCK])
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
        if n:
            rows = [_limbs(v) for v in [n, *total]]
            yield pa.RecordBatch.from_pydict({"at": list(range(len(rows))), **dict(zip(names, zip(*rows, strict=True), strict=True))})

    parts = df.select("embedding").mapInArrow(run, ", ".join(["at long", *(f"{x} long" for x in names)]))
    summed = parts.groupBy("at").agg(*(F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in names))
    rows = sorted((r["at"], sum(int(r[x]) << LIMB * k for k, x in enumerate(names))) for r in summed.collect())
    return (rows[0][1], [v for _, v in rows[1:]]) if rows else (0, [])


def _row_deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n x - S)^2 of each row, in whole numbers."""
    # n x - S = n (x - floor(S/n)) - r, r being what floor(S/n) leaves of S
    centre, rest = (np.array(v, object) for v in zip(*(divmod(s, n) for s in sums), strict=True))
    wide = n * (np.abs(x.astype(float) - centre.astype(float)).max(initial=0.0) + 2)
    exact = np.int64 if wide * wide * len(sums) < 2.0**62 else object
    far = n * (x.astype(exact) - centre.astype(exact)) - rest.astype(exact)
    return [int(v) for v in (far * far).sum(axis=1)]


def _squares(centre: np.ndarray) -> Callable[[np.ndarray], list[int]]:
    """Sums of (y_i + y_j)^2 for i < j after those of y_i^2, y being x without its whole-number centre."""

    def sums_of(x: np.ndarray) -> list[int]:
        wide = np.abs(x.astype(float) - centre.astype(float)).max(initial=0.0) * 2 + 2
        exact = np.int64 if wide * wide * len(x) < 2.0**62 else object
        y = x.astype(exact) - centre.astype(exact)
        out = [(y * y).sum(axis=0)]
        for i in range(y.shape[1] - 1):
            pair = y[:, i + 1 :] + y[:, i : i + 1]
            out.append((pair * pair).sum(axis=0))
        return [int(v) for v in np.concatenate(out)]

    return sums_of


class Whitening:
    """Fitted components: ``vectors`` (dims x k, columns are unit), ``values`` (eigenvalues, falling)."""

    def __init__(self, n: int, sums: list[int], squares: list[list[int]], most: int):
        dims = len(sums)
        self.n, self.sums = n, sums
        #: sum over rows of (n x_i - S_i)^2, and of its products with dimension j, in whole numbers
        own = squares[0]
        cross = [[0] * dims for _ in range(dims)]
        for i in range(dims):
            cross[i][i] = own[i]
            for j in range(i + 1, dims):
                cross[i][j] = cross[j][i] = (squares[i + 1][j - i - 1] - own[i] - own[j]) // 2
        self.deviation = sum(own)
        covariance = np.array([[v / n**3 for v in row] for row in cross])
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[: min(most, dims)]
        self.trace = float(np.trace(covariance))
        # a direction without spread is kept, but nothing can be scaled by its eigenvalue
        self.values = [float(v) if v > 1e-12 * self.trace else 0.0 for v in values[order]]
        largest = np.abs(vectors[:, order]).argmax(axis=0)
        self.vectors = vectors[:, order] * np.sign(vectors[largest, order])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x-vectors; NaN where a component has no spread."""
        # floor(S/n) is taken off in whole numbers, so that large values do not lose their spread
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        values = np.array(self.values)
        scale = np.divide(1.0, np.sqrt(values), out=np.full(len(values), np.nan), where=values > 0)
        return ((x - low).astype(float) - rest) @ self.vectors * scale


def fit(df: DataFrame, most: int = 8) -> Whitening | None:
    """Components of all good vectors of ``df``; None if there is none."""
    lengths = df.groupBy(F.size("embedding").alias("n")).count().filter("n > 0")
    first = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    if first is None:
        return None
    dims = first["n"]
    n, sums = _exact_sums(df, dims, _sums)
    if not n:
        return None
    centre = [s // n for s in sums]
    _, squares = _exact_sums(df, dims, _squares(np.array(centre, np.int64)))
    # from squares around the whole centre to those of n x - S = n y - r, r being the sum of y
    r = [s - n * c for s, c in zip(sums, centre, strict=True)]
    rows, at = [], 0
    for i in range(-1, dims - 1):
        width = dims - 1 - i
        left = [r[i] + r[i + 1 + k] if i >= 0 else r[k] for k in range(width)]
        rows.append([n * n * q - n * e * e for q, e in zip(squares[at : at + width], left, strict=True)])
        at += width
    return Whitening(n, sums, rows, most)


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, row_deviation long, row_deviation_digits string, identity_error double, deviation_digits string"


def whitened(df: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, row_deviation, row_deviation_digits, identity_error, deviation_digits).

    One row per vector and component.

    ``df`` has vec_id and embedding (array of numbers); other columns are not read. Vectors that are null or
    hold null or non-finite entries are left out of the fit and of the result, and so are those whose length is
    not the table's most frequent one (the longest of equally frequent ones). An x that would not fit a long
    stands at the largest, or least, that does. Repeated rows and null ids are rows like any other. A component
    without spread (fewer vectors than dimensions, equal vectors) has whitened null and is not in
    identity_error; explained is null if no dimension has spread. row_deviation is the sum over the dimensions of
    (n x - S)^2 of the vector, deviation that of all vectors together, which grows with the cube of the rows; either is
    null where it does not fit a long, and has its decimal digits at any size in the column with _digits. A table
    without a good vector gives no rows.
    """
    spark = df.sparkSession
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(df, components)
    if model is None:
        return spark.createDataFrame([], OUTPUT)
    dims, k = len(model.sums), len(model.values)
    explained = [v / model.trace if model.trace > 0 else None for v in model.values]
    deviation = model.deviation if model.deviation < 1 << 63 else None

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n, sums and products of the whitened columns of a task, by pair of components."""
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = model.project(_whole(matrix(batch.column(0), dims)[1]))
            w = np.column_stack([np.ones(len(w)), np.nan_to_num(w)])
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total.ravel()})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = matrix(batch.column(1), dims)
            x = _whole(values)
            w = model.project(x).ravel()
            size = len(w)
            own = [v for v in _row_deviations(x, model.n, model.sums) for _ in range(k)]
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(np.repeat(at, k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    "n": pa.array(np.full(size, model.n, np.int64)),
                    "deviation": pa.array([deviation] * size, pa.int64()),
                    "whitened": pa.array(w, mask=np.isnan(w)),
                    "explained": pa.array(explained * len(at), pa.float64()),
                    "row_deviation": pa.array([v if v < 1 << 63 else None for v in own], pa.int64()),
                    "row_deviation_digits": pa.array([str(v) for v in own], pa.string()),
                }
            )

    sums = df.select("embedding").mapInArrow(spread, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k + 1))
    for r in sums.collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[0, 1:] / total[0, 0]
    real = np.array(model.values) > 0
    off = np.abs(total[1:, 1:] / total[0, 0] - np.outer(mean, mean) - np.eye(k))[np.ix_(real, real)]
    error = float(off.max()) if real.any() else 0.0
    constants = {"identity_error": F.lit(error), "deviation_digits": F.lit(str(model.deviation))}
    return df.mapInArrow(rows, OUTPUT.partition(", identity_error")[0]).withColumns(constants)
