"""Whitening of vectors: pivoted Cholesky of the scatter, then one-sided Jacobi on its factor.

Components are made whole numbers, ``x = floor(64 c) + 1000000``, and every distinct x vector counts
once. Tasks add up the scatter of their vectors about the exact mean, one matrix each; the sums are
one matrix of dimension squared, which alone reaches the driver. There the covariance is factored
by Cholesky with complete pivoting; one-sided Jacobi rotates the columns of the triangular factor
itself until they are orthogonal, so the covariance's condition is never squared. Norms of the
rotated columns are the roots of the eigenvalues, normalised columns the components. A second pass
over the distinct vectors measures the covariance of the whitened vectors; a narrow pass over
all rows projects them.

Sums of x are exact (decimals), and vectors are centred as ``(x - m) - (S - n m)/n`` with m the whole
number next to the mean, so nothing is lost to the offset of a million.

Defined cases: rows whose vector is null, empty or holds a null, non-finite or over-large entry (2^43 or more: its x times a
count does not fit a long) take no part; nor do vectors of another length than most (ties: the
shorter); rows that repeat an id are rows of their own; a null id stays; eigenvalues below ``SMALL`` times the
largest count as zero and give no component, so equal vectors only give no rows, as an empty table
does; a deviation that does not fit a long is null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import materialize

COMPONENTS = 16
SCALE, OFFSET, LARGE = 64, 1_000_000, float(2 ** 43)
SMALL = 1e-13
SWEEPS = 60
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x array<long>`` of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGE))
    rows = rows.where(F.coalesce(sound, F.lit(False)) & (F.size("v") > 0))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sum over all tasks of the arrays of ``width`` numbers that ``part`` makes of their batches."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += part(batch)
        yield pa.RecordBatch.from_pydict({"at": np.arange(width), "value": total})

    sums = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width)
    out[sums["at"].to_numpy()] = sums["value"].to_numpy()
    return out


def pivoted_cholesky(v: np.ndarray, small: float = SMALL) -> np.ndarray:
    """Columns L with L L' = v, up to diagonal rests of ``small`` times the largest; triangular in pivot order."""
    d = len(v)
    rest, factor, done = np.diag(v).copy(), np.zeros((d, d)), np.zeros(d, bool)
    least, rank = small * rest.max(initial=0.0), 0
    while rank < d:
        at = int(np.where(done, -np.inf, rest).argmax())
        if not rest[at] > least:
            break
        root = np.sqrt(rest[at])
        column = (v[:, at] - factor[:, :rank] @ factor[at, :rank]) / root
        column[done], column[at] = 0.0, root
        factor[:, rank] = column
        done[at] = True
        rest = np.where(done, 0.0, rest - column * column)
        rank += 1
    return factor[:, :rank]


def jacobi(factor: np.ndarray, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of ``factor factor'``, by rotating its columns.

    A round rotates disjoint pairs of columns, in the order of a round-robin tournament.
    """
    a = factor.copy()
    r = a.shape[1]
    players = list(range(r + r % 2))
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(players[:len(players) // 2], players[::-1]) if max(p, q) < r]
            players = [players[0], players[-1], *players[1:-1]]
            p, q = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            apart = np.abs(xy) / np.sqrt(np.maximum(xx * yy, 1e-300))
            worst = max(worst, float(apart.max(initial=0.0)))
            turn = apart > tolerance
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= tolerance * 10:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, a[:, order] / norms[order]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The first ``components`` whitened components of every row, one row each."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col)
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "d").first()
    if usual is None:
        return spark.createDataFrame([], RESULT)
    d = usual["d"]
    rows = materialize(rows.where(F.size("x") == d))
    distinct = materialize(rows.select("x").distinct())
    exact = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, sums = exact[0]["n"], [0] * d
    for r in exact:
        sums[r["i"]] = int(r["s"])
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    beside = np.array([(s - n * int(m)) / n for s, m in zip(sums, near)])

    def centred(batch):
        return (matrix(batch.column("x")) - near).astype(float) - beside

    def scatter(batch):
        x = centred(batch)
        return (x.T @ x).ravel()

    v = _summed(distinct, scatter, d * d).reshape(d, d) / n
    v = (v + v.T) / 2
    values, axes = jacobi(pivoted_cholesky(v))
    found = int((values[:components] > SMALL * values[:1].max(initial=0.0)).sum())
    if not found:
        return spark.createDataFrame([], RESULT)
    axes, roots = axes[:, :found], np.sqrt(values[:found])

    def moments(batch):
        w = centred(batch) @ axes / roots
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    seen = _summed(distinct, moments, found + found * found) / n
    mean, square = seen[:found], seen[found:].reshape(found, found)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(found)).max())
    explained = values[:found] / np.trace(v)
    s = np.array([x % 2 ** 64 for x in sums], np.uint64).view(np.int64)

    def project(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, m = matrix(batch.column("x")), len(batch)
            w = centred(batch) @ axes / roots
            wide = ((centred(batch) * n) ** 2).sum(axis=1) >= 9.2e18
            apart = x * np.int64(n) - s  # modulo 2^64, right wherever the sum of squares fits
            deviation = pa.array((apart * apart).sum(axis=1), pa.int64(), mask=wide)
            at = np.repeat(np.arange(m), found)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)),
                pa.array(np.full(m * found, n, np.int64)), deviation.take(pa.array(at)), pa.array(w.ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * found, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, RESULT)
