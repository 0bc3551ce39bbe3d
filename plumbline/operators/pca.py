"""Principal components from partition sums, and projection of vectors.

A fit adds one mean and one second-moment matrix per partition of a bounded sample; the driver
holds D x D numbers. Where the vectors have no more dimensions than asked for they are centred only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 8


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass(frozen=True)
class Basis:
    """mean [D], components [K, D] (None: centre only) and the variances of all components."""

    mean: np.ndarray
    components: np.ndarray | None
    variances: np.ndarray

    def transform(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        return x if self.components is None else x @ self.components.T

    def dimension(self, share: float) -> int:
        """Components needed for ``share`` of the variance."""
        total = self.variances.sum()
        if total <= 0:
            return 0
        return int(np.searchsorted(np.cumsum(self.variances) / total, share - 1e-12) + 1)


def fit(sample: DataFrame, dim: int, column: str = "features") -> Basis:
    """The basis of the vectors of ``sample``, at most ``dim`` components, each with its largest
    loading positive. An empty sample is an error."""
    def sums(batches):
        n, total, moment = 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                moment = x.T @ x if moment is None else moment + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], names=["n", "total", "moment"])

    rows = sample.select(column).coalesce(PARTS).mapInArrow(sums, "n long, total binary, moment binary").collect()
    if not rows:
        raise ValueError("no vectors to fit a basis on")
    return solved(rows, dim)


def solved(rows, dim: int) -> Basis:
    """The basis of partial sums (n, total, moment)."""
    n = sum(r["n"] for r in rows)
    total = sum(np.frombuffer(r["total"]) for r in rows)
    d = len(total)
    mean = total / n
    cov = sum(np.frombuffer(r["moment"]).reshape(d, d) for r in rows) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(d), np.abs(vectors).argmax(1)])[:, None]
    return Basis(mean, None if d <= dim else vectors[: min(dim, d, n)], values)


def fit_by(sample: DataFrame, key: str, dim: int, column: str = "features") -> DataFrame:
    """(key, mean, components) of each value of ``key``, as bytes; sums are added by key on the
    executors, one matrix per partition and key."""
    def sums(batches):
        states: dict = {}
        for batch in batches:
            x, keys = matrix(batch.column(1)), np.array(batch.column(0).to_pylist(), object)
            for k in set(keys.tolist()):
                own = x[keys == k]
                state = states.setdefault(k, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
                state[0] += len(own)
                state[1] += own.sum(0)
                state[2] += own.T @ own
        if states:
            yield pa.RecordBatch.from_arrays([pa.array(list(states)), pa.array([v[0] for v in states.values()]), pa.array([v[1].tobytes() for v in states.values()], pa.binary()), pa.array([v[2].tobytes() for v in states.values()], pa.binary())], names=[key, "n", "total", "moment"])

    def solve(at, g):
        import pandas as pd

        basis = solved(g.to_dict("records"), dim)
        return pd.DataFrame({key: [at[0]], "mean": [basis.mean.tobytes()], "components": [None if basis.components is None else basis.components.tobytes()]})

    partial = sample.select(key, column).coalesce(PARTS).mapInArrow(sums, f"{key} string, n long, total binary, moment binary")
    return partial.groupBy(key).applyInPandas(solve, f"{key} string, mean binary, components binary")


def project_by(df: DataFrame, bases: DataFrame, key: str, column: str = "features", limit: int = 64 << 20) -> DataFrame:
    """``df`` with each row in the basis of its key. Bases reach the workers in groups of about
    ``limit`` bytes, each projecting its own keys' rows."""
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, F.col(column).cast("array<double>").alias(column))
    at, names = rest.index(key), rows.columns

    def projected(group: dict):
        sent = df.sparkSession.sparkContext.broadcast(group)

        def run(batches):
            for batch in batches:
                keys, x = np.array(batch.column(at).to_pylist(), object), matrix(batch.column(batch.num_columns - 1))
                for k in sorted(set(keys.tolist())):
                    y = sent.value[k].transform(x[keys == k])
                    kept = batch.filter(pa.array(keys == k))
                    ends = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=names)

        return rows.where(F.col(key).isin(*group)).mapInArrow(run, rows.schema)

    out, group, size = None, {}, 0
    for r in [*bases.toLocalIterator(), None]:  # one basis at a time
        if r is not None:
            mean = np.frombuffer(r["mean"])
            basis = Basis(mean, None if r["components"] is None else np.frombuffer(r["components"]).reshape(-1, len(mean)), np.zeros(0))
            size += len(r["mean"]) + len(r["components"] or b"")
            group[r[key]] = basis
        if group and (r is None or size > limit):
            part = projected(group)
            out, group, size = part if out is None else out.unionByName(part), {}, 0
    return rows if out is None else out


def project(df: DataFrame, basis: Basis, column: str = "features", out: str = "features") -> DataFrame:
    """``df`` with ``column`` in the basis, as ``out``."""
    rest = [c for c in df.columns if c not in (column, out)]
    schema = df.select(*rest, F.col(column).cast("array<double>").alias(out)).schema

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1))
            if len(x):
                y = basis.transform(x)
                at = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(at, pa.array(y.ravel()))], names=schema.fieldNames())

    return df.select(*rest, F.col(column).cast("array<double>").alias(out)).mapInArrow(run, schema)


def intrinsic_dimension(x: np.ndarray, shares: tuple[float, ...] = (0.9, 0.95)) -> list[int]:
    """Components that reach each share of the variance of the rows of x."""
    if len(x) < 2:
        return [0 for _ in shares]
    values = np.maximum(np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2, 0)
    if values.sum() <= 0:
        return [0 for _ in shares]
    return [int(np.searchsorted(np.cumsum(values) / values.sum(), s - 1e-12) + 1) for s in shares]
