"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are rounded to a grid of integers, so that sums over them are exact.  The leading
eigenvectors of their covariance V are found without V: a pass over the fit list gives
X'(XQ) / n for a block Q of vectors, X being the centred list.  One round of the iteration applies
a Chebyshev polynomial of V to the block by its three-term recurrence, a pass for each degree.
The polynomial is small on the unwanted part of the spectrum, between a lower bound from a few
Lanczos steps and the block's least Ritz value, and grows fast above it.  QR and a Rayleigh-Ritz
step follow.  Rounds end when the residuals of the wanted pairs certify them and no round makes
them smaller.

Each pass adds up a matrix of dimensions x block in its tasks; entries are summed by Spark, and
the driver only sees that matrix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Grid steps of a unit, and what makes grid values positive.
STEP, SHIFT = 64, 1_000_000
COMPONENTS = 16
DEGREE = 10
#: Residuals, as a share of the first eigenvalue, that certify a pair.
CERTIFIED = 1e-11
#: Residuals that are rounding alone.
ROUNDING = 1e-14
#: A component under this share of the first eigenvalue has no variance to divide by.
NO_VARIANCE = 1e-10


def on_grid(embeddings: DataFrame, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the vector on the grid, of every row whose entries are all finite numbers.

    Entries whose grid value has no 64 bits (2^55 and more) count as not finite.
    """
    def place(c):
        c = c.cast("double")
        return F.when(F.abs(c) < float(1 << 55), F.floor(c * STEP) + F.lit(SHIFT).cast("long"))

    return embeddings.select(
        F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), place).alias("x")
    ).where(F.forall("x", lambda c: c.isNotNull()))


@dataclass
class Center:
    """Size of the fit list and sums of its dimensions; ``wide`` where n * x needs over 62 bits."""

    n: int
    sums: list[int]
    wide: bool

    def spread(self, x: pa.Array) -> np.ndarray:
        """n * x - S, exact, for a list array of grid vectors."""
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.sums))
        if self.wide:
            return flat.astype(object) * self.n - np.array(self.sums, object)
        return flat * np.int64(self.n) - np.array(self.sums, np.int64)

    def centred(self, x: pa.Array) -> np.ndarray:
        return (self.spread(x) / self.n).astype(np.float64)


def _center(fit: DataFrame, dim: int) -> Center:
    facts = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("x")).alias("hi"),
                    F.min(F.array_min("x")).alias("lo")).collect()[0]
    top = max(abs(facts["hi"]), abs(facts["lo"]))

    def add_up(batches):
        total = np.zeros(dim, object)
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            total += (flat if top < 1 << 40 else flat.astype(object)).sum(0).astype(object)
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(dim), pa.int32()),
                                          "s": pa.array([str(t) for t in total])})

    rows = fit.mapInArrow(add_up, "j int, s string").groupBy("j").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["j"]: int(r["s"]) for r in rows}
    return Center(facts["n"], [sums[j] for j in range(dim)], facts["n"] * top >= 1 << 62)


def _summed(fit: DataFrame, center: Center, of: Callable[[np.ndarray], np.ndarray],
            size: int) -> np.ndarray:
    """The sum over the fit list of ``of`` (centred rows of a batch), ``size`` numbers."""
    def add_up(batches):
        total = np.zeros(size)
        for batch in batches:
            total += of(center.centred(batch.column("x")))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size, dtype=np.int32)),
                                          "v": pa.array(total)})

    rows = fit.mapInArrow(add_up, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    table = rows.toArrow()
    out = np.zeros(size)
    out[table.column("i").to_numpy()] = table.column("v").to_numpy()
    return out


class Operator:
    """V as a map of blocks; counts its passes and knows V's trace after the first one."""

    def __init__(self, fit: DataFrame, center: Center):
        self.fit, self.center, self.dim = fit, center, len(center.sums)
        self.passes, self.trace = 0, 0.0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        got = _summed(self.fit, self.center,
                      lambda x: np.append(x.T @ (x @ q), (x * x).sum()), q.size + 1)
        self.trace = got[-1] / self.center.n
        return got[:-1].reshape(q.shape) / self.center.n


def lower_bound(apply: Callable[[np.ndarray], np.ndarray], dim: int, rng, steps: int = 8) -> float:
    """A bound under the spectrum of a positive map, from a few Lanczos steps."""
    steps = min(steps, dim)
    basis = [rng.standard_normal(dim)]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(steps):
        w = apply(basis[-1][:, None])[:, 0]
        alpha.append(w @ basis[-1])
        for u in basis:
            w = w - (w @ u) * u
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(abs(alpha[0]), 1e-300):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, values[0] - beta[-1] * abs(vectors[-1, 0]))


def filtered(apply, q: np.ndarray, vq: np.ndarray, low: float, high: float, first: float,
             degree: int) -> np.ndarray:
    """The Chebyshev polynomial of V on [low, high], scaled at ``first``, applied to q."""
    high = max(high, low + 1e-6 * first)
    mid, half = (low + high) / 2, (high - low) / 2
    sigma1 = sigma = half / (first - mid)
    before, now = q, (vq - mid * q) * (sigma1 / half)
    for _ in range(degree - 1):
        then = 1 / (2 / sigma1 - sigma)
        before, now = now, 2 * (apply(now) - mid * now) * (then / half) - sigma * then * before
        sigma = then
    return now


def leading(apply, dim: int, k: int, degree: int = DEGREE, rounds: int = 60, seed: int = 7):
    """The ``k`` largest eigenvalues (falling) and their unit eigenvectors, certified.

    The block has 3 k vectors: the more, the farther the wanted part is from the damped one.
    """
    rng = np.random.default_rng(seed)
    k, m = min(k, dim), min(dim, 3 * k)
    q = np.linalg.qr(rng.standard_normal((dim, m)))[0]
    vq, low, last = apply(q), None, np.inf
    for _ in range(rounds):
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        first = max(values[0], 0.0)
        worst = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max()
        # A whole basis is exact after one step; else go on until rounding is all that is left.
        if m == dim or worst <= ROUNDING * first or (
                worst <= CERTIFIED * first and worst > last / 10):
            return values[:k], q[:, :k]
        last = worst
        if low is None:
            low = lower_bound(apply, dim, rng)
        q = np.linalg.qr(filtered(apply, q, vq, low, values[-1], first, degree))[0]
        vq = apply(q)
    raise ArithmeticError(f"no certificate after {rounds} rounds: residual {worst:.3g} of {first:.3g}")


@dataclass
class Whitening:
    """What turns a grid vector into whitened components."""

    center: Center
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of ``vectors`` (x, all of one length), each different one counted once.

    None where there is no vector.  Components without variance are left out.
    """
    listed = cut(vectors.select("x").distinct())
    row = listed.select(F.size("x").alias("d")).head()
    if row is None:
        return None
    center = _center(listed, row["d"])
    apply = Operator(listed, center)
    values, q = leading(apply, row["d"], components)
    keep = values > NO_VARIANCE * max(values[0], 1e-300)
    values, q = values[keep], q[:, keep]
    # Either sign would do; this one does not depend on the way there.
    q = q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])
    k, turn = len(values), q / np.sqrt(values)

    def moments(x):
        z = x @ turn
        return np.append((z.T @ z).ravel(), z.sum(0))

    error = 0.0
    if k:
        got = _summed(listed, center, moments, k * k + k) / center.n
        cov = got[:k * k].reshape(k, k) - np.outer(got[k * k:], got[k * k:])
        error = float(np.abs(cov - np.eye(k)).max())
    return Whitening(center, values, q, apply.trace, error, apply.passes)


def _deviation(spread: np.ndarray) -> pa.Array:
    """Sums of squares as 64-bit integers, exact; null where they do not fit."""
    if spread.dtype != object and (spread.astype(float) ** 2).sum(1).max(initial=0) < 2.0 ** 62:
        return pa.array((spread * spread).sum(1))
    exact = [int(v) for v in (spread.astype(object) ** 2).sum(1)]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def transform(vectors: DataFrame, made: Whitening) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, x) and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    k = len(made.values)
    turn, share = made.vectors / np.sqrt(made.values), made.values / (made.trace or 1.0)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            spread = made.center.spread(batch.column("x"))
            z = (spread / made.center.n).astype(np.float64) @ turn
            rows = pa.array(np.repeat(np.arange(len(z)), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(rows),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
                "n": pa.array(np.full(len(rows), made.center.n, np.int64)),
                "deviation": _deviation(spread).take(rows),
                "whitened": pa.array(z.ravel()),
                "explained": pa.array(np.tile(share, len(z))),
                "identity_error": pa.array(np.full(len(rows), made.identity_error))})

    return vectors.mapInArrow(
        project, f"vec_id {kind}, component int, n long, deviation long, whitened double,"
                 " explained double, identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every vector of ``embeddings``, with what the fit explains.

    Rows whose vector is null or empty, or holds a null or an entry that is not finite, are
    dropped.  The dimension is the most frequent length (ties: the greatest); rows of another
    length have no place in it and are dropped too.  The fit list holds each different grid
    vector once; rows repeat as they are given.  Where the list has no variance (one vector, or
    no row) there is no component and no row.  Of equal eigenvalues any unit basis is right.
    A deviation that passes 64 bits is null.  Only the two named columns are read.
    """
    told = on_grid(embeddings, id_col, vector_col).where(F.size("x") > 0)
    sizes = told.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    made = fit(told.where(F.size("x") == sizes["d"]), components) if sizes else None
    if made is None or not len(made.values):
        kind = told.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double,"
                " explained double, identity_error double")
    return transform(told.where(F.size("x") == sizes["d"]), made)
