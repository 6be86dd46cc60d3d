"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise TSQR.

Vectors are integers, x = floor(64 * c) + 1000000.  All statistics are over the
fit list: each distinct x once, so a vector that a third of all rows share is one
row of it (partial aggregation before the exchange).

1. The fit list is written to the shared folder; counts and exact per-dimension
   sums S come from one pass.
2. TSQR: each task reduces its centred rows (n * x - S, exact, then one rounding)
   block by block to a triangular R; the Rs are stacked and reduced again, FAN at
   a time, until one is left.  A task holds FAN + 1 matrices of d x d, whatever
   the number of rows.
3. Plane rotations orthogonalise R's columns (one-sided Jacobi).  The accumulated
   rotations are the components, the columns' lengths over sqrt(n) the standard
   deviations; the covariance itself is never formed, so small ones keep their
   digits.
4. One pass over the fit list measures the covariance of the whitened vectors,
   one over all rows returns them.

What the driver holds is sums, components and deviations: (COMPONENTS + 2) * d
numbers for each vector length, no row.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry
takes no part; vectors of different length are whitened apart, each length with
its own fit list; repeated rows are returned each; a null id stays null; a scaled
entry beyond 2^52 is held there; a deviation beyond a long is the largest long; a
component without variance (to double precision) has explained 0 and whitened
null; equal eigenvalues keep the order of the rotations' result; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veltrial.llm.common import released, shared_checkpoint, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Triangles that one task stacks, rows that one factorisation takes in, rows of an output batch.
FAN, STACK_ROWS, OUT_ROWS = 16, 4096, 1024
MOST = (1 << 63) - 1
HELD = float(1 << 52)


def whole_vectors(df: DataFrame, column: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows that take part, with x (array of longs) beside their columns."""
    c = F.transform(F.col(column), lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    held = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * F.lit(float(scale)), F.lit(-HELD)), F.lit(HELD))) + F.lit(shift))
    return df.where(fine & (F.size(column) > 0)).select("*", held.alias("_x"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a list column, by vector length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    lengths = np.diff(ends, prepend=0)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[(ends[at] - d)[:, None] + np.arange(d)]


@dataclass
class Moments:
    """Of the fit list's vectors of one length: how many, and their exact sums."""

    n: int
    total: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they hold it, else Python integers."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.total))
        if top < MOST // 2:
            return x * self.n - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        """Sum of squares of each row, exactly."""
        if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < MOST / 2:
            return (centred * centred).sum(1)
        return np.array([min(MOST, sum(int(v) ** 2 for v in row)) for row in centred], np.int64)


@dataclass
class Model:
    moments: Moments
    basis: np.ndarray  # d x components, columns of length 1
    deviation: np.ndarray  # of each component; 0 where it has none
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        """One row of whitened components for each centred row; nan without variance."""
        scale = np.where(self.deviation > 0, self.deviation, np.nan)
        return (centred.astype(float) / self.moments.n) @ self.basis / scale


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of r, largest first.

    Columns are rotated in disjoint pairs, so a round of d / 2 plane rotations is
    one numpy step; a sweep meets every pair once."""
    d = r.shape[1]
    a, v = np.array(r, float), np.eye(d)
    ring = np.arange(d + d % 2)  # d is a place without a column if d is odd
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, len(ring) - 1)):
            left, right = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            has = (left < d) & (right < d)
            left, right = left[has], right[has]
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
            p, q = a[:, left], a[:, right]
            pp, qq, pq = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            go = np.abs(pq) > np.finfo(float).eps * np.sqrt(pp * qq)
            if not go.any():
                continue
            turned = True
            left, right, pp, qq, pq = left[go], right[go], pp[go], qq[go], pq[go]
            zeta = (qq - pp) / (2 * pq)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, left], m[:, right]
                m[:, left], m[:, right] = c * x - s * y, s * x + c * y
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return v[:, order], sigma[order]


def triangle(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def _fit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums of each length and dimension, in halves that no long sum overflows."""
    part = TaskContext.get().partitionId()
    found: dict[int, list[np.ndarray]] = {}
    count: dict[int, int] = {}
    for batch in batches:
        for _, x in matrices(batch.column(0)):
            d = x.shape[1]
            own = found.setdefault(d, [np.zeros(d, np.int64), np.zeros(d, np.int64)])
            own[0] += (x >> 26).sum(0)
            own[1] += (x & ((1 << 26) - 1)).sum(0)
            count[d] = count.get(d, 0) + len(x)
    for d, (high, low) in found.items():
        yield pa.RecordBatch.from_pydict({"dim": np.full(d, d), "at": np.arange(d), "part": np.full(d, part), "n": np.full(d, count[d]), "high": high, "low": low})


def _fit_triangles(moments: dict[int, Moments]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                own = moments[x.shape[1]]
                for lo in range(0, len(x), STACK_ROWS):
                    y = own.centred(x[lo : lo + STACK_ROWS]).astype(float) / own.n
                    found[x.shape[1]] = triangle(np.vstack((found[x.shape[1]], y)) if x.shape[1] in found else y)
        for d, r in found.items():
            yield pa.RecordBatch.from_pydict({"dim": [d], "node": [part], "r": pa.array([r.tobytes()], pa.binary())}, schema=pa.schema([("dim", pa.int64()), ("node", pa.int64()), ("r", pa.binary())]))

    return run


def _stacked(pdf: pd.DataFrame) -> tuple[int, np.ndarray]:
    d = int(pdf["dim"].iloc[0])
    return d, triangle(np.vstack([np.frombuffer(r, float).reshape(-1, d) for r in pdf.sort_values("node")["r"]]))


def _combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    d, r = _stacked(pdf)
    return pd.DataFrame({"dim": [d], "node": [key[1]], "r": [r.tobytes()]})


def _solve(components: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, r = _stacked(pdf)
        v, sigma = jacobi(r)
        k = min(components, d)
        sigma = np.where(sigma > sigma[0] * d * np.finfo(float).eps, sigma, 0.0)
        lead = np.abs(v[:, :k]).argmax(0)
        basis = v[:, :k] * np.where(v[lead, np.arange(k)] < 0, -1.0, 1.0)  # the largest entry is positive
        total = float((sigma**2).sum())
        share = sigma[:k] ** 2 / total if total else np.zeros(k)
        return pd.DataFrame({"dim": [d], "basis": [basis.tobytes()], "sigma": [sigma[:k].tobytes()], "share": [share.tobytes()]})

    return run


def _fit_products(models: dict[int, Model]) -> Callable:
    """Sums of products and values of the whitened fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                d, model = x.shape[1], models[x.shape[1]]
                w = np.nan_to_num(model.whiten(model.moments.centred(x)))
                w = np.hstack((w, np.ones((len(w), 1))))
                found[d] = found.get(d, 0.0) + w.T @ w
        for d, s in found.items():
            i, j = np.divmod(np.arange(s.size), len(s))
            yield pa.RecordBatch.from_pydict({"dim": np.full(s.size, d), "i": i, "j": j, "v": s.ravel()})

    return run


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each vector length of a written table of distinct ``_x``."""
    sums = fit.mapInArrow(released(_fit_sums), "dim long, at long, part long, n long, high long, low long")
    rows = sums.groupBy("dim", "at").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")), F.max("part").alias("part")).collect()
    moments: dict[int, Moments] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["at"])):
        moments.setdefault(r["dim"], Moments(r["n"], [])).total.append((r["high"] << 26) + r["low"])
    if not moments:
        return {}
    nodes = fit.mapInArrow(released(_fit_triangles(moments)), "dim long, node long, r binary")
    last = max(r["part"] for r in rows)
    while last >= FAN:
        nodes = nodes.groupBy("dim", F.expr(f"node div {FAN}").alias("node")).applyInPandas(_combine, "dim long, node long, r binary")
        last //= FAN
    solved = nodes.groupBy("dim").applyInPandas(_solve(components), "dim long, basis binary, sigma binary, share binary").collect()
    models = {}
    for r in solved:
        d, n = r["dim"], moments[r["dim"]].n
        models[d] = Model(moments[d], np.frombuffer(r["basis"]).reshape(d, -1), np.frombuffer(r["sigma"]) / np.sqrt(n), np.frombuffer(r["share"]))
    products: dict[int, dict] = {}
    for r in fit.mapInArrow(released(_fit_products(models)), "dim long, i long, j long, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        products.setdefault(r["dim"], {})[r["i"], r["j"]] = r["v"]
    for d, own in products.items():
        model = models[d]
        k = len(model.deviation)
        s = np.array([[own[i, j] for j in range(k + 1)] for i in range(k + 1)]) / model.moments.n
        off = s[:k, :k] - np.outer(s[:k, k], s[:k, k]) - np.eye(k)
        has = model.deviation > 0
        model.identity_error = float(np.abs(off[np.ix_(has, has)]).max(initial=0.0))
    return models


def _whitened(models: dict[int, Model], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                model = models[x.shape[1]]
                k = len(model.deviation)
                for lo in range(0, len(at), OUT_ROWS):
                    centred = model.moments.centred(x[lo : lo + OUT_ROWS])
                    w, m = model.whiten(centred).ravel(), len(centred)
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(at[lo : lo + OUT_ROWS], k))),
                        np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                        np.full(m * k, model.moments.n),
                        np.repeat(model.moments.deviation(centred), k),
                        pa.array(w, mask=np.isnan(w)),
                        np.tile(model.explained, m),
                        np.full(m * k, model.identity_error),
                    ]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    return run


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per taking-part row and component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error."""
    rows = whole_vectors(df.select(F.col(id_column).alias("vec_id"), F.col(column).alias("_v")), "_v").select("vec_id", "_x")
    fit = shared_checkpoint(rows.select("_x").distinct())
    models = fit_whitening(fit, components)
    out = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    return rows.mapInArrow(released(_whitened(models, to_arrow_schema(out))), out)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
