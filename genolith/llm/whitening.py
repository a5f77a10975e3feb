"""Whitening of embeddings in integers and two passes.

Entries become integers, x = floor(scale c) + offset, so that sums, and the mean as the fraction S / n, are exact whatever the order of
rows. The fit is on distinct vectors. The first pass sums them; the second sums outer products of the centred vectors, a
matrix product for each batch (deviations are taken from the nearest integer, exactly, then from the rest of the mean). Partial sums of partitions are
merged by ``treeAggregate``. Components come from LAPACK's symmetric solver; the projection is d x 16 numbers, and is broadcast. A third pass measures the
covariance of what was whitened.

What reaches the driver are sums of d and d x d numbers, for each length d of vectors; vectors of different lengths are fitted apart.

Cases: rows whose vector is null, or holds null or non-finite entries, or entries beyond LARGEST (whose integers would not be exact), go; empty vectors have no
components; components without variance (at most d rounding errors of the largest eigenvalue) can't be whitened and are left out, so that one distinct
vector gives no rows; repeated rows come as often as they are there; null ids stay; extra columns are left out. OverflowError if a sum or a
deviation doesn't fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: The largest absolute entry.
LARGEST = 2.0**40

Partial = dict[int, tuple[np.ndarray, ...]]


def integers(embedding: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale c) + offset of each entry, as longs."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def sound(embedding: Column) -> Column:
    fits = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))
    return F.coalesce(embedding.isNotNull() & fits, F.lit(False))


def _by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, rows, vectors [row, d]) of each length above 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def _merged(a: Partial, b: Partial) -> Partial:
    return a | {d: tuple(x + y for x, y in zip(a[d], own)) if d in a else own for d, own in b.items()}


def totals(fit: DataFrame, part: Callable[[int, np.ndarray], tuple[np.ndarray, ...]]) -> Partial:
    """For each length, the sums over all vectors of ``fit`` (x) of the arrays that ``part`` makes of a batch: each partition adds up its own, which
    travel as one row, and are merged as a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Partial = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                own = _merged(own, {d: part(d, x)})
        for d, arrays in own.items():
            kinds, parts = [a.dtype.str for a in arrays], [np.ascontiguousarray(a).tobytes() for a in arrays]
            shapes = [list(a.shape) for a in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([kinds]), pa.array([shapes], pa.list_(pa.list_(pa.int64()))), pa.array([parts], pa.list_(pa.binary()))], ["d", "kinds", "shapes", "parts"])

    rows = fit.select("x").mapInArrow(run, "d long, kinds array<string>, shapes array<array<long>>, parts array<binary>").rdd
    read = lambda r: {r.d: tuple(np.frombuffer(p, k).reshape(s) for k, s, p in zip(r.kinds, r.shapes, r.parts))}
    return rows.treeAggregate({}, lambda total, r: _merged(total, read(r)), _merged)


@dataclass
class Whitening:
    """Of vectors of one length: n distinct ones with sums S; covariance V; the first components with variance, as columns, their eigenvalues and shares of
    the trace; the largest error of the whitened covariance."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        """The integer nearest the mean, about."""
        return (2 * self.sums + self.n) // (2 * self.n)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        c = self.centre
        return (x - c).astype(float) - (self.sums - self.n * c) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S)^2, exactly."""
        c = self.centre
        largest = float(self.n) * float(np.abs(x - c).max(initial=0)) + self.n
        if largest * largest * x.shape[1] < 2.0**62:
            y = self.n * (x - c) - (self.sums - self.n * c)
            return (y * y).sum(axis=1)
        found = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums.tolist())) for row in x.tolist()]
        if max(found) >= 1 << 63:
            raise OverflowError(f"a deviation over {self.n} vectors doesn't fit in 64 bits")
        return np.array(found, np.int64)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of the vectors ``distinct`` (x, arrays of longs, each once)."""
    context = distinct.sparkSession.sparkContext
    first = totals(distinct, lambda d, x: (np.array([len(x)]), x.sum(axis=0), np.abs(x).sum(axis=0, dtype=float)))
    if any(size.max() >= 2.0**61 for _, _, size in first.values()):
        raise OverflowError("sums of entries don't fit in 64 bits")
    models = {d: Whitening(int(n[0]), s, np.empty((0, 0)), np.empty((d, 0)), np.empty(0), np.empty(0)) for d, (n, s, _) in first.items()}
    shared = context.broadcast(models)

    def outer(d: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        y = shared.value[d].deviations(x)
        return (y.T @ y,)

    for d, (products,) in totals(distinct, outer).items():
        m = models[d]
        m.covariance = products / m.n
        values, vectors = np.linalg.eigh((m.covariance + m.covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > max(values.max(), 0) * d * np.finfo(float).eps]
        m.components, m.eigenvalues, m.explained = vectors[:, order], values[order], values[order] / max(np.trace(m.covariance), 1e-300)
    shared.unpersist()
    shared = context.broadcast(models)

    def whitened(d: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        y = shared.value[d].whitened(x)  # deviations: their mean is zero
        return y.sum(axis=0), y.T @ y

    for d, (sums, products) in totals(distinct, whitened).items():
        m = models[d]
        mean = sums / m.n
        m.identity_error = float(np.abs(products / m.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    shared.unpersist()
    return models


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each sound row of ``vectors`` and component."""
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.filter(sound(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), integers(F.col(vector_col), scale, offset).alias("x"))
    models = fit(written(rows.select("x").distinct(), "distinct"), components)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(1)):
                m = shared.value[d]
                k = len(m.eigenvalues)
                if k:
                    each = lambda v: pa.array(np.repeat(v, k))
                    ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                    columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), m.n)), each(m.deviation(x)), pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(k * len(x), m.identity_error))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
