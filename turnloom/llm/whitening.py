"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

X v = u products run row by row in tasks, X^T u products are sums over rows; both are done in one pass
over a written table of integer vectors, and only sums of fixed size leave a task. A left vector u is
never stored: as every u is X w for a short w, rows make the ones they need again, and u is
reorthogonalised against all earlier ones through their dot products, summed in the same pass. Right
vectors are short and reorthogonalised, twice, on the driver. The singular values and vectors of the
small bidiagonal matrix give components and deviations.

Bidiagonalisation ends when no wanted component can still move by more than rounding: its residual is
small against its distance from the other singular values; at the latest after as many steps as there
are dimensions, when the decomposition is complete. A vector that breaks the recurrence off is replaced
by one at right angles to all so far.

Defined cases: null vectors and those with null, infinite or not-a-number entries are left out; vectors
shorter than the longest one count as ending in zeros; rows with a null or repeated id are rows of their
own; directions without variance are no components, so equal vectors, one vector or an empty table have
none, hence no rows; other columns are not looked at. Deviations beyond 64 bits raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import arrow_map, give_back, scratch, small_batches

COMPONENTS = 8
_SETTLED = 1e-13
_FLAT = 1e-12  # a component's variance against the first one's


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and x of every row that remains: x is floor(1024 c) + 100000 of each entry c as double."""
    small_batches(rows.sparkSession)
    entries = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col(f"`{vector}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("id"), entries.alias("entries"), bad.alias("bad")
    ).where(~F.col("bad")).select(
        "id", F.transform("entries", lambda c: F.floor(c * 1024).cast("long") + 100000).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as whole numbers; short ones end in what a zero becomes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.full((len(lengths), width), 100000, np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def sums(rows: DataFrame, size: int, of_batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all batches of `size` numbers: one set of them leaves a task, sums meet by number."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        give_back()
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(size), pa.int32()), "v": pa.array(total, pa.float64())})

    out = np.zeros(size)
    for row in rows.mapInArrow(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out


@dataclass(frozen=True)
class Fit:
    """What rows need: count, sums per dimension, components as columns, their variances, the whole variance."""

    n: int
    totals: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.n * x - self.totals) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact."""
        off = self.n * x - self.totals
        if (off.astype(float) ** 2).sum(1).max(initial=0.0) >= 2.0**63:
            raise OverflowError("deviations of this many rows do not fit 64 bits")
        return (off * off).sum(1)


def _right_angled(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v without its share in the columns of basis; twice is enough."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonal(
    step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, wanted: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of X, the largest first.

    step(W) gives, for the last column w of W, with y = X w: the products of y with all columns of X W,
    and X^T y. Both come from one pass over the rows.
    """
    draw = np.random.default_rng(11)
    v = draw.normal(size=width)
    right, left = np.zeros((width, 0)), np.zeros((width, 0))  # left: columns w with u = X w
    images = np.zeros((width, 0))  # X^T u
    alphas, betas = [], []
    v /= np.linalg.norm(v)
    while True:
        right = np.column_stack([right, v])
        w = v - betas[-1] * left[:, -1] if betas else v
        dots, image = step(np.column_stack([left, w]))
        known = dots[:-1]  # shares of earlier left vectors, zero but for rounding
        w, image = w - left @ known, image - images @ known
        alpha = float(np.sqrt(max(0.0, dots[-1] - known @ known)))
        scale = max([alpha, *alphas])
        if alpha <= 1e-14 * scale or scale == 0:
            alpha, w, image = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, image = w / alpha, image / alpha
        left, images = np.column_stack([left, w]), np.column_stack([images, image])
        alphas.append(alpha)
        k = len(alphas)
        v = _right_angled(image - alpha * right[:, -1], right)
        beta = float(np.linalg.norm(v))
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, q = np.linalg.svd(small)
        if k == width:
            break
        if beta <= 1e-14 * scale:  # an invariant space: go on beside it, so that equal values are found, too
            beta, v = 0.0, _right_angled(draw.normal(size=width), right)
        else:
            gaps = np.array([np.min(np.abs(np.delete(s, i) - x), initial=x) for i, x in enumerate(s)])
            off = beta * np.abs(p[-1])
            if k > wanted and (off[:wanted] <= _SETTLED * gaps[:wanted]).all():
                break
        v /= np.linalg.norm(v)
        betas.append(beta)
    return right @ q.T, s


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of rows (id, x), a written table; None without rows or without variance."""
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = shape["n"], shape["width"] or 0
    if not n or not width:
        return None
    long = F.posexplode("x").alias("i", "v")
    missing = F.lit(n) - F.count("*")
    totals = rows.select(long).groupBy("i").agg((F.sum("v") + missing * 100000).alias("s")).orderBy("i").collect()
    centre = Fit(n, np.array([r["s"] for r in totals], np.int64), np.zeros((width, 0)), np.zeros(0), 0.0)
    trace = float(sums(rows, 1, lambda b: np.array([(centre.centred(matrix(b.column("x"), width)) ** 2).sum()]))[0]) / n
    if trace <= 0:
        return None

    def step(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def work(batch: pa.RecordBatch) -> np.ndarray:
            x = centre.centred(matrix(batch.column("x"), width))
            y = x @ w
            return np.concatenate([y.T @ y[:, -1], x.T @ y[:, -1]])

        found = sums(rows, w.shape[1] + width, work)
        return found[: w.shape[1]], found[w.shape[1] :]

    vectors, values = bidiagonal(step, width, min(components, width))
    variances = values**2 / n
    kept = min(components, int((variances > _FLAT * variances[0]).sum()))
    return Fit(n, centre.totals, vectors[:, :kept], variances[:kept], trace)


def identity_error(rows: DataFrame, shared: Broadcast, kept: int, width: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, centred before multiplying."""
    n = shared.value.n
    mean = sums(rows, kept, lambda b: shared.value.whitened(matrix(b.column("x"), width)).sum(0)) / n

    def work(batch: pa.RecordBatch) -> np.ndarray:
        off = shared.value.whitened(matrix(batch.column("x"), width)) - mean
        return (off.T @ off).ravel()

    covariance = sums(rows, kept * kept, work).reshape(kept, kept) / n
    return float(np.abs(covariance - np.eye(kept)).max())


def whitened(
    rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error per remaining row and component."""
    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    table = scratch(whole_vectors(rows, key, vector))
    found = fit(table, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    kept, width = found.components.shape[1], len(found.totals)
    shared = rows.sparkSession.sparkContext.broadcast(found)  # a few vectors
    error = identity_error(table, shared, kept, width)

    def work(batch: pa.RecordBatch) -> dict:
        model = shared.value
        x = matrix(batch.column("x"), width)
        m = len(x)
        return {
            "id": batch.column("id").take(pa.array(np.repeat(np.arange(m), kept))),
            "component": np.tile(np.arange(1, kept + 1), m), "n": np.full(m * kept, model.n),
            "deviation": np.repeat(model.deviations(x), kept), "whitened": model.whitened(x).ravel(),
            "explained": np.tile(model.variances / model.trace, m), "identity_error": np.full(m * kept, error)}

    return arrow_map(table, work, schema)
