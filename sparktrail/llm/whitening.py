"""Embedding whitening: leading eigenvectors of a covariance that is never formed, by block Lanczos.

Vectors are scaled to whole numbers, and each different one counts once (the fit
list). The covariance V is only ever applied: one distributed pass over the fit
list gives the sum of (x - mean) ((x - mean)' Q) for a block Q, as partial sums of
dimension x block numbers a task, which Spark adds up. What the driver holds is a
basis of a few blocks of the vectors' dimension, whatever the number of rows.

Block Lanczos with full reorthogonalisation: the next block is the part of VQ that is
orthogonal to the basis. Where it loses rank (a breakdown: the basis holds an invariant subspace),
the lost directions are started again at random outside the basis. The Ritz pairs
of the basis have converged when the norms of their residuals, computed from the
stored images, are small against the largest eigenvalue; then the operator outside
them, from a random start, must have no larger eigenvalue, so that one which is repeated
more often than a block is wide is found as often. A basis that is full is
restarted with its best Ritz vectors.

Defined cases: a row whose vector is null, or has a null or non-finite entry, or one
beyond 2**50 in size, or is not as long as most of the vectors (the longer, if
equally many), is dropped; an empty table, or one of a single different vector, has no
components and gives no rows; components whose eigenvalue is nought within
rounding (below 1e-11 of the largest) are not given, nor more than there are dimensions; a deviation
beyond a long is null; rows are kept as often as they are in the table, and ids may be null, repeated and of any
type; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stored

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 50)
NOUGHT = 1e-11
Block = np.ndarray


def scaled(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows; x has whole numbers."""
    sound = lambda c: F.coalesce(F.abs(c.cast("double")) <= LIMIT, F.lit(False)) & ~F.isnan(c.cast("double"))
    v = F.col(vector)
    rows = df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, sound)).select(F.col(vec_id).alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _matrix(column) -> Block:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, kind: str, size: int, part: Callable[[Block], Block]) -> Block:
    """The sum over all x of part(matrix of x), an array of `size` numbers, which are added up in Spark."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches):
        total, any_ = np.zeros(size, dtype), False
        for batch in batches:
            if batch.num_rows:
                total, any_ = total + part(_matrix(batch.column(0))), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size, dtype)
    for r in map_arrow(rows.select("x"), run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


class Centre:
    """n and S of the fit list; gives n*x - S exactly, without large numbers on the way."""

    def __init__(self, n: int, sums: Block):
        self.n, self.sums = n, sums
        self.whole = sums // n
        self.rest = sums - self.whole * n

    def deviations(self, x: Block) -> Block:
        """n*x - S, as long as they fit, else as Python numbers."""
        off = x - self.whole
        if float(np.abs(off).max(initial=0)) * self.n < 2.0**62:
            return off * self.n - self.rest
        return off.astype(object) * self.n - self.rest.astype(object)

    def centred(self, x: Block) -> Block:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: Block) -> list[int | None]:
        """The sum of the squares of n*x - S by row; None if it doesn't fit a long."""
        d = self.deviations(x)
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (d * d).sum(axis=1).tolist()
        exact = (d.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def orthonormal(block: Block, basis: Block, least: float) -> Block:
    """The directions of `block` outside the basis, orthonormal, the strongest first, without those below `least` in size."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    kept = u[:, s > least]
    kept = kept - basis @ (basis.T @ kept)
    return np.linalg.qr(kept)[0] if kept.shape[1] else kept


def leading(apply: Callable[[Block], Block], d: int, k: int, block: int = 16, most: int = 128, tolerance: float = 1e-13, passes: int = 500, seed: int = 7) -> tuple[Block, Block, int]:
    """The k largest eigenvalues of the symmetric operator `apply` on blocks of d rows, their vectors, and the number of passes."""
    rng, done = np.random.default_rng(seed), 0

    def pairs(on: Callable[[Block], Block], start: Block, k: int, tolerance: float, least: float = 0.0) -> tuple[Block, Block, bool]:
        """Ritz pairs once their residuals are small, and whether the basis was all there is."""
        nonlocal done
        basis, image, new = np.zeros((d, 0)), np.zeros((d, 0)), start
        while done < passes:
            basis, image, done = np.hstack([basis, new]), np.hstack([image, on(new)]), done + 1
            small = basis.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            vectors, images, size = basis @ turn, image @ turn, max(values[0], least)
            whole = basis.shape[1] == d or size == 0.0
            residuals = images[:, :k] - vectors[:, :k] * values[:k]
            if whole or basis.shape[1] >= k and (np.linalg.norm(residuals, axis=0) <= tolerance * size * np.sqrt(d)).all():
                return values[:k], vectors[:, :k], whole
            width = min(block, d - basis.shape[1])
            # all residuals lie in what the last image has outside the basis
            new = orthonormal(image[:, -new.shape[1] :], basis, 1e-12 * size)[:, :width]
            if new.shape[1] < width:  # a breakdown: go on from elsewhere
                new = np.hstack([new, orthonormal(rng.standard_normal((d, width - new.shape[1])), np.hstack([basis, new]), 1e-9)])
            if basis.shape[1] + block > most:  # restart with what is best; the next block goes on from there
                basis, image = vectors[:, : k + block], images[:, : k + block]
        raise ArithmeticError(f"no convergence in {passes} passes")

    k, none = min(k, d), np.zeros((d, 0))
    most = max(most, 2 * k + 2 * block)
    fresh = lambda outside: orthonormal(rng.standard_normal((d, min(block, d - outside.shape[1]))), outside, 1e-9)
    values, vectors, whole = pairs(apply, fresh(none), k, tolerance)
    while not whole:
        out = lambda q: q - vectors @ (vectors.T @ q)  # noqa: B023, E731
        rest, more, _ = pairs(lambda q: out(apply(out(q))), fresh(vectors), 1, 1e-4, max(values[-1], 1e-10 * values[0]))
        if rest[0] <= values[-1] + 1e-12 * values[0]:
            break
        values, vectors, whole = pairs(apply, np.linalg.qr(np.hstack([vectors, more]))[0], k, tolerance)
    return values, vectors, done


def whitened(df: DataFrame, components: int = 16, vec_id: str = "vec_id", vector: str = "embedding", block: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component."""
    rows = scaled(df, vec_id, vector)
    fit = stored(rows.select("x").distinct(), "vectors")
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, first = fit.count(), fit.first()
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    d = len(first["x"])
    centre = Centre(n, _summed(fit, "long", d, lambda x: x.sum(axis=0)))
    trace = float(_summed(fit, "double", 1, lambda x: np.array([np.square(centre.centred(x)).sum()]))[0]) / n

    def apply(q: Block) -> Block:
        def part(x: Block) -> Block:
            c = centre.centred(x)
            return (c.T @ (c @ q)).ravel()

        return _summed(fit, "double", q.size, part).reshape(q.shape) / n

    values, vectors, _ = leading(apply, d, components, block)
    sound = values > NOUGHT * values[0]
    values, to = values[sound], vectors[:, sound] / np.sqrt(values[sound])
    k = len(values)

    def spread(x: Block) -> Block:
        w = centre.centred(x) @ to
        return np.r_[(w.T @ w).ravel(), w.sum(axis=0)]

    sums = _summed(fit, "double", k * k + k, spread) / n
    covariance = sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :])
    error = float(np.abs(covariance - np.eye(k)).max())
    shares = values / trace

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, d), np.int64)
            m = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            of = pa.array(centre.squares(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            same = lambda v, t: pa.array(np.full(m * k, v), t)  # noqa: E731, B023
            cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), same(n, pa.int64()), of, pa.array((centre.centred(x) @ to).ravel()), pa.array(np.tile(shares, m)), same(error, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, project, schema)
