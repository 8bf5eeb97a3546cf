"""Whitening of embeddings: principal components of a covariance by cyclic Jacobi rotations.

Tasks add up sums and then the scatter of what is left after centring; the driver holds the d x d covariance alone, turns pairs of
its axes until no off-diagonal entry is left beside its two diagonal ones, sorts the eigenvalues and sends the whitening
matrix (d x k) to all tasks. Jacobi's rotations keep small eigenvalues accurate relative to themselves, which matters as
whitening divides by their roots. Vectors are quantised to whole numbers, so sums and n * x - S are exact."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: x = floor(SCALE * c) + SHIFT; entries are held within LARGEST, where doubles and sums of longs are exact.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 52
COMPONENTS = 16


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that are not null and hold no null or non-finite entry."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("v", lambda c: (F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))) + SHIFT).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column whose lists have length d."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def sums(d: int):
    """Arrow batches (x) -> (n, high, low): the number of rows, and each dimension's sums of the high and the low 32 bits."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "high": [high.tolist()], "low": [low.tolist()]}, pa.schema([("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))

    return of


def off_mean(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they suffice, else as Python's whole numbers."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, total), default=0)
    if most < 1 << 63:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def scatter(n: int, total: list[int], d: int, apply: np.ndarray | None = None, middle: np.ndarray | None = None):
    """Arrow batches (x) -> (i, row): the i-th row of the sum of centred outer products, a row a task and i. With apply, of
    (x - S / n) @ apply - middle."""
    k = d if apply is None else apply.shape[1]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, any_rows = np.zeros((k, k)), False
        for batch in batches:
            y = off_mean(matrix(batch.column(0), d), n, total).astype(np.float64) / n
            if apply is not None:
                y = y @ apply - middle
            out += y.T @ y
            any_rows |= len(y) > 0
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, k * k + 1, k, dtype=np.int32)), pa.array(out.ravel()))], names=["i", "row"])

    return of


def added(rows: DataFrame, k: int) -> np.ndarray:
    """The k x k sum of scatter()'s rows, entry by entry with partial sums; k * k numbers reach the driver."""
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((k, k))
    for r in cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row")).toLocalIterator():
        out[r["i"]] = [c["v"] for c in r["row"]]
    return (out + out.T) / 2


def jacobi(v: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix with no negative eigenvalue. A sweep turns every pair of axes
    once, in rounds of pairs that share none; it ends when each off-diagonal entry is within rounding of the root of its
    diagonal entries' product, or turned all that could be."""
    d = len(v)
    a, q = v.astype(np.float64).copy(), np.eye(d)
    seats = list(range(d + d % 2))
    eps = np.finfo(np.float64).eps
    floor = eps * eps * max(np.abs(np.diag(a)).max(initial=0.0), np.finfo(np.float64).tiny)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(min(i, j), max(i, j)) for i, j in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :]), strict=True) if max(i, j) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, r = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
            off, x, y = a[p, r], a[p, p], a[r, r]
            do = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(x * y)), floor)
            if not do.any():
                continue
            turned = True
            p, r, off, x, y = p[do], r[do], off[do], x[do], y[do]
            theta = (y - x) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            rows_p, rows_r = a[p].copy(), a[r].copy()
            a[p], a[r] = c[:, None] * rows_p - s[:, None] * rows_r, s[:, None] * rows_p + c[:, None] * rows_r
            cols_p, cols_r = a[:, p].copy(), a[:, r].copy()
            a[:, p], a[:, r] = cols_p * c - cols_r * s, cols_p * s + cols_r * c
            a[p, p], a[r, r], a[p, r], a[r, p] = x - t * off, y + t * off, 0.0, 0.0
            cols_p, cols_r = q[:, p].copy(), q[:, r].copy()
            q[:, p], q[:, r] = cols_p * c - cols_r * s, cols_p * s + cols_r * c
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    q = q[:, order]
    return e[order], q * np.where(q[np.abs(q).argmax(0), np.arange(d)] < 0, -1.0, 1.0)


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector and its first components.

    Vectors that are null or hold null or non-finite entries go, as do those of another length than most have (of equally
    frequent lengths the smallest counts); other rows stay, repeated and null vec_ids too. A row of the fit list is a distinct quantised vector,
    however many rows have it. A component without variance beyond rounding (all, if one vector is all there is) has whitened null and is left out of identity_error;
    deviation is null where it passes a long. Entries beyond 2^52 / 64 count as that. Empty vectors or tables give no rows. Columns besides vec_id
    and embedding are not read."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whitening")
    all_rows = quantised(vectors)
    lengths = all_rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 0
    if not d:
        return spark.createDataFrame([], f"{WHITE}, identity_error double")
    rows = all_rows.where(F.size("x") == d)
    fit = scratch.table(rows.select("x").distinct(), "fit")
    parts = fit.mapInArrow(sums(d), "n long, high array<long>, low array<long>")
    n = parts.agg(F.sum("n")).first()[0]
    total = [0] * d
    for r in parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("j", "s")).groupBy("j").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).toLocalIterator():  # a row a dimension
        total[r["j"]] = (r["high"] << 32) + r["low"]
    v = added(fit.mapInArrow(scatter(n, total, d), "i int, row array<double>"), d) / n
    e, q = jacobi(v)
    k, trace = min(components, d), float(np.trace(v))
    live = e[:k] > 16 * d * np.finfo(np.float64).eps * max(e[0], 0.0)
    apply = np.where(live, q[:, :k] / np.sqrt(np.where(live, e[:k], 1.0)), 0.0)
    explained = e[:k] / trace if trace > 0 else np.zeros(k)
    # the covariance of what comes out, centred on its own mean (zero but for rounding)
    white = added(fit.mapInArrow(scatter(n, total, d, apply, np.zeros(k)), "i int, row array<double>"), k) / n
    error = float(np.abs(white - np.eye(k))[np.ix_(live, live)].max(initial=0.0))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                ids, x = batch.column(0).slice(at, 4096), matrix(batch.column(1).slice(at, 4096), d)
                far = off_mean(x, n, total)
                if far.dtype == object or int(np.abs(far).max(initial=0)) ** 2 * d >= 1 << 63:
                    squares = [int(s) for s in (far.astype(object) ** 2).sum(1)]
                    deviation = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
                else:
                    deviation = pa.array((far * far).sum(1))
                y = (far.astype(np.float64) / n) @ apply
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), deviation.take(pa.array(each)), pa.array(y.ravel(), mask=np.tile(~live, len(x))), pa.array(np.tile(explained, len(x)))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return rows.mapInArrow(project, WHITE).withColumn("identity_error", F.lit(error))


def op12(vectors: DataFrame) -> DataFrame:
    """Every usable vector's first 16 whitened components; see whiten()."""
    return whiten(vectors.select("vec_id", "embedding"))
