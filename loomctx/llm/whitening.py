"""Whitening of vectors by a one-sided Jacobi singular value decomposition.

The fit list holds each distinct vector once. Its centred rows are compressed by a blockwise QR decomposition: every partition folds its rows, a
block at a time, into one triangle, and triangles are folded again in a tree of bounded fan-in until a few are left. Plane rotations
then make the columns of the last triangle R orthogonal: their lengths are the singular values of the centred rows, and the product
of all rotations holds the components. The covariance itself is never formed, so small deviations keep their digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx.llm.impact import WHOLE, matrix
from loomctx.llm.stage import release, small_batches, written

#: Added to quantised components.
SHIFT = 1_000_000
#: Rows folded into a triangle at once, and bytes of the triangles that a task or the driver folds together at most (two if one has more).
ROWS, FAN = 4096, 32 << 20


def integers(column: str = "embedding"):
    """``floor(64 * c) + SHIFT`` of each component as longs; null where the vector is null or a component is null, not finite or, times 64, not below 2 ** 53 in size."""
    scaled = F.transform(F.col(column).cast("array<double>"), lambda c: c * 64.0)
    usable = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WHOLE))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(scaled, lambda c: F.floor(c).cast("long") + SHIFT))


def jacobi(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of a square matrix by one-sided rotations.

    A sweep meets every pair of columns once, in rounds of disjoint pairs; it ends when all pairs are orthogonal to within the tolerance.
    """
    a, d = np.array(r, np.float64), r.shape[1]
    m = d + d % 2  # a round needs pairs: an odd number gets a column of zeros
    a = np.concatenate([a, np.zeros((len(a), m - d))], axis=1)
    v = np.eye(m)
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    a /= scale
    players = np.arange(m)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(m - 1):
            p, q = players[: m // 2], players[: m // 2 - 1 : -1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (np.einsum("ij,ij->j", s, t) for s, t in ((x, x), (y, y), (x, y)))
            size = np.sqrt(xx) * np.sqrt(yy)
            turn = np.abs(xy) > tolerance * size
            if turn.any():
                worst = max(worst, float((np.abs(xy[turn]) / np.maximum(size[turn], np.finfo(float).tiny)).max()))
                zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                c, s = np.where(turn, c, 1.0), np.where(turn, c * t, 0.0)
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                vx, vy = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vx - s * vy, s * vx + c * vy
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if worst <= tolerance * 8:
            break
    sigma = np.sqrt(np.einsum("ij,ij->j", a, a)) * scale
    # the column of zeros never turns
    sigma, v = sigma[:d], v[:d, :d]
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def _folded(blocks) -> np.ndarray | None:
    """The triangle of all rows of the blocks."""
    r = None
    for b in blocks:
        r = np.linalg.qr(b if r is None else np.concatenate([r, b]), mode="r")
    return r


def _sums(batches):
    """(part, dim, sum as text) of a partition's vectors; sums beyond a long are exact too."""
    total: dict[int, int] = {}
    for batch in batches:
        x = _longs(batch.column("x"))
        for s in range(0, len(x), 512):
            for j, value in enumerate(x[s : s + 512].sum(axis=0).tolist()):  # 512 components of 53 bits fit a long
                total[j] = total.get(j, 0) + value
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([str(x) for x in total.values()], pa.string())], names=["dim", "total"])


def _longs(column) -> np.ndarray:
    """Vectors as rows of longs; a shorter one is filled up with ``SHIFT``, the integer of zero."""
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(whole.value_lengths())
    width = max(int(sizes.max(initial=0)), 1)
    out = np.full((len(whole), width), SHIFT, np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(whole.flatten(), np.int64)
    return out


class Centre:
    """Exact n * x - S of rows, and x - S / n in double precision."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def exact(self, x: np.ndarray) -> np.ndarray:
        wide = np.full((len(x), len(self.sums)), SHIFT, np.int64)
        wide[:, : x.shape[1]] = x
        most = max(int(np.abs(wide).max(initial=0)), *map(abs, self.sums), 1)
        if self.n * most < 1 << 61 and max(map(abs, self.sums)) < 1 << 61:
            return wide * self.n - np.array(self.sums, np.int64)
        return wide.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, exact: np.ndarray) -> np.ndarray:
        return exact.astype(np.float64) / self.n

    def deviation(self, exact: np.ndarray) -> list[int | None]:
        """Sums of squares, null where a long can't hold them."""
        most = max(abs(int(exact.max(initial=0))), abs(int(exact.min(initial=0))))
        if exact.dtype != object and most * most * exact.shape[1] < 1 << 63:
            return (exact * exact).sum(axis=1).tolist()
        whole = [sum(int(v) ** 2 for v in row) for row in exact]
        return [w if w < 1 << 63 else None for w in whole]


def _triangles(centre: Centre):
    def kernel(batches):
        def blocks():
            for batch in batches:
                x = _longs(batch.column("x"))
                for s in range(0, len(x), ROWS):
                    yield centre.centred(centre.exact(x[s : s + ROWS]))

        r = _folded(blocks())
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return kernel


def _fold_group(width: int):
    def fold(table: pa.Table) -> pa.Table:
        r = _folded(np.frombuffer(b.as_py(), np.float64).reshape(-1, width) for b in table["r"])
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return fold


def compressed(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred fit list. The driver gets as many triangles as ``FAN`` bytes hold, two at least."""
    width = len(centre.sums)
    fan = max(2, FAN // (width * width * 8))
    level = written(fit.select("x").mapInArrow(_triangles(centre), "part long, r binary"), "triangles")
    while level.count() > fan:
        # parts keep distinct numbers: the quotient names the group
        numbered = level.withColumn("part", F.floor(F.col("part") / fan))
        folded = written(numbered.groupBy("part").applyInArrow(_fold_group(width), "part long, r binary"), "triangles")
        release(level)
        level = folded
    rows = [np.frombuffer(r["r"], np.float64).reshape(-1, width) for r in level.orderBy("part").collect()]
    release(level)
    r = _folded(rows)
    out = np.zeros((width, width))
    if r is not None:
        out[: len(r)] = r
    return out


def _moments(centre: Centre, axes: np.ndarray):
    """(rows, mean, sum of centred products) of a partition's whitened vectors."""

    def kernel(batches):
        total = None
        for batch in batches:
            x = _longs(batch.column("x"))
            for s in range(0, len(x), ROWS):
                w = centre.centred(centre.exact(x[s : s + ROWS])) @ axes
                mean = w.mean(axis=0)
                total = _merged(total, (len(w), mean, (w - mean).T @ (w - mean)))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())], names=["n", "mean", "products"])

    return kernel


def _merged(a, b):
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _merge_group(width: int):
    def merge(table: pa.Table) -> pa.Table:
        total = None
        for n, mean, products in zip(table["n"], table["mean"], table["products"]):
            total = _merged(total, (n.as_py(), np.frombuffer(mean.as_py(), np.float64), np.frombuffer(products.as_py(), np.float64).reshape(width, width)))
        return pa.table({"n": pa.array([total[0]], pa.int64()), "mean": pa.array([total[1].tobytes()], pa.binary()), "products": pa.array([total[2].tobytes()], pa.binary())})

    return merge


def identity_error(fit: DataFrame, centre: Centre, axes: np.ndarray) -> float | None:
    """Largest entry, in size, of the whitened fit list's covariance less the identity; null without a component of positive variance."""
    width = axes.shape[1]
    if not width:
        return None
    parts = fit.select("x").mapInArrow(_moments(centre, axes), "n long, mean binary, products binary")
    # partitions are merged in some hundreds of groups before one task sees them
    merged = parts.groupBy((F.xxhash64("mean") % 256).alias("g")).applyInArrow(_merge_group(width), "n long, mean binary, products binary")
    total = None
    for r in merged.orderBy("n", "mean").collect():
        total = _merged(total, (r["n"], np.frombuffer(r["mean"], np.float64), np.frombuffer(r["products"], np.float64).reshape(width, width)))
    return float(np.abs(total[2] / total[0] - np.eye(width)).max())


def _projected(centre: Centre, axes: np.ndarray, explained: list, error: float | None, most: int):
    def kernel(batches):
        for batch in batches:
            exact = centre.exact(_longs(batch.column("x")))
            whitened = centre.centred(exact) @ axes
            rows, some = whitened.shape
            values = np.zeros((rows, most))
            values[:, :some] = whitened
            at = np.repeat(np.arange(rows), most)
            part = np.tile(np.arange(most), rows)
            deviation = pa.array(centre.deviation(exact), pa.int64())
            columns = [
                batch.column("vec_id").take(pa.array(at)), pa.array((part + 1).astype(np.int32)), pa.array(np.full(len(at), centre.n, np.int64)), deviation.take(pa.array(at)),
                pa.array(values.ravel(), mask=part >= some), pa.array(explained, pa.float64()).take(pa.array(part)), pa.array([error] * len(at), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kernel


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``vectors`` (vec_id, embedding) and each of the first components.

    Vectors that are null or hold a component that is null, not finite or, times 64, 2 ** 53 or more in size are left out. There are as many components as dimensions, ``components``
    at most; a shorter vector, an empty one too, is filled up with zeros. Rows that repeat an id or a vector each have their rows, the fit list has
    a vector once. A component without variance (beyond rounding) has whitened null and explained 0, or null where nothing varies; identity_error
    covers the others and is null if there are none. A deviation that a long can't hold is null. An
    empty table gives an empty result; other columns aren't read.
    """
    small_batches(vectors.sparkSession, records=ROWS, size=32 << 20)
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers().alias("x")).where("x is not null"), "whiten-rows")
    width = max(rows.agg(F.max(F.size("x"))).first()[0] or 1, 1)
    # equal vectors of different lengths are one vector
    padded = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    fit = written(rows.select(padded.alias("x")).distinct(), "whiten-fit")
    n = fit.count()
    total = {r["dim"]: int(r["total"]) for r in fit.mapInArrow(_sums, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    centre = Centre(max(n, 1), [total.get(j, SHIFT) for j in range(width)])
    sigma, axes = jacobi(compressed(fit, centre)) if n else (np.zeros(width), np.eye(width))
    real = int((sigma > sigma[0] * width * 8 * np.finfo(float).eps).sum()) if sigma[0] > 0 else 0
    most, variance = min(components, width), sigma**2 / max(n, 1)
    some = min(most, real)
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(width)])
    scaled = (axes * np.where(signs == 0, 1, signs))[:, :some] / np.sqrt(variance[:some])
    trace = float(variance.sum())
    explained = [float(variance[i] / trace) if i < some else (0.0 if trace else None) for i in range(most)]
    error = identity_error(fit, centre, scaled)
    release(fit)
    return rows.mapInArrow(_projected(centre, scaled, explained, error, most), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
