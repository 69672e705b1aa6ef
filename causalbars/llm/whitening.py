"""Whitening with exact moments: bit-sliced scatter.

Entries become integers (floor of 64 times the entry, plus 1,000,000). A slice of vectors is shifted by each
dimension's least value, and the bits of what is left are laid out in planes: one bit of one dimension across 64 rows
is one word. The cross-products of two dimensions are the popcounts of the planes' conjunctions, weighted by powers of
two, so all sums are integers and exact; the shift is undone in integer arithmetic. Partitions send their sums
(d (d + 1) / 2 + d + 1 numbers, decimals of 38 digits), which are added by key.

Moments are those of the distinct integer vectors. The covariance is centred as integers (n Q - S S^T, over n^2) and
only then becomes floating point for ``eigh``. Components are numbered by falling eigenvalue; the sign is such that a
component's largest entry is positive.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; null and repeated ids
and repeated rows stay; vectors of each length are whitened among themselves; components without variance (eigenvalue
not above 1e-12 of the largest; all of them if there is one distinct vector) have null in ``whitened`` and 0 (null if
nothing varies) in ``explained``; empty vectors have no components; an empty table gives an empty table; only id and
vector are read. Entries beyond 2^40, deviations beyond a long, and more than MODEL_DOUBLES numbers of components over
all vector lengths raise an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, ship_package

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Rows of a slice whose planes are made at once.
SLICE_ROWS = 8192
#: Most doubles of all components that every task holds (32 MB): lengths of vectors, times COMPONENTS.
MODEL_DOUBLES = 4 << 20
_LARGEST = float(1 << 40)


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, d): the usable rows as integer vectors and their length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    fits = lambda c: F.when(F.abs(c) <= _LARGEST, c).otherwise(F.raise_error(F.lit("an entry is beyond 2^40")).cast("double"))
    x = F.transform("v", lambda c: F.floor(SCALE * fits(c)).cast("long") + OFFSET)
    return rows.select("id", x.alias("x"), F.size("v").alias("d"))


def _matrices(batch: pa.RecordBatch, column: str, d: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of each length of vectors in a batch."""
    lengths, flat = batch.column(d).to_numpy(), batch.column(column).flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, flat[starts[rows][:, None] + np.arange(length)[None, :]]


def planes_of(y: np.ndarray, bits: int) -> np.ndarray:
    """(d, bits, words): bit p of column j of the non-negative ``y``, 64 rows to a word."""
    rows, d = y.shape
    padded = np.zeros((d, -(-rows // 64) * 64), np.int64)
    padded[:, :rows] = y.T
    planes = [np.packbits((padded >> p) & 1 == 1, axis=1).view(np.uint64) for p in range(bits)]
    return np.stack(planes, axis=1) if planes else np.zeros((d, 0, padded.shape[1] // 64), np.uint64)


def scatter(x: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and cross-products (j from i on) of the columns, exact."""
    n, d = x.shape
    least = x.min(axis=0)
    y = x - least
    bits = int(y.max()).bit_length()
    planes = planes_of(y, bits)
    low = [int(v) for v in least]
    sums = [sum(int(c) << p for p, c in enumerate(np.bitwise_count(planes[j]).sum(axis=1, dtype=np.int64))) for j in range(d)]
    cross = []
    for i in range(d):
        own = [0] * (d - i)
        for p in range(bits):
            counts = np.bitwise_count(planes[i:] & planes[i, p]).sum(axis=2, dtype=np.int64)
            if p + bits < 40:
                weighted = (counts << np.arange(p, p + bits)).sum(axis=1).tolist()
            else:
                weighted = [sum(int(c) << (p + q) for q, c in enumerate(row)) for row in counts]
            own = [a + b for a, b in zip(own, weighted)]
        cross.append([v + low[i] * sums[i + k] + low[i + k] * sums[i] + n * low[i] * low[i + k] for k, v in enumerate(own)])
    return n, [s + n * m for s, m in zip(sums, low)], cross


@dataclass
class Model:
    """What whitens vectors of one length; ``axes`` are rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @staticmethod
    def fit(n: int, sums: list[int], cross: np.ndarray, most: int) -> Model:
        d = len(sums)
        v = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = (n * int(cross[i, j]) - sums[i] * sums[j]) / (n * n)
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:most], axes.T[::-1][:most].copy()
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        trace = sum(n * int(cross[i, i]) - sums[i] * sums[i] for i in range(d)) / (n * n)
        varied = values > 1e-12 * values[0] if trace > 0 else np.zeros(len(values), bool)
        explained = [float(e) / trace if ok else 0.0 for e, ok in zip(values, varied)] if trace > 0 else [None] * len(values)
        return Model(n, sums, np.where(varied, values, np.nan), axes, explained)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.axes.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        most = self.n * (int(np.abs(x - whole).max()) + 1)
        if most * most * x.shape[1] < 1 << 63:
            off = self.n * (x - whole) - rest
            return (off * off).sum(axis=1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]


def fit_models(distinct: DataFrame, most: int) -> dict[int, Model]:
    """A model for each length of the vectors of ``distinct(x, d)``."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # one triangle of sums a length, however many rows
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for d, _, x in _matrices(batch.slice(at, SLICE_ROWS), "x", "d"):
                    n, sums, cross = scatter(x)
                    flat = np.array([n, *sums, *(v for row in cross for v in row)], object)
                    total[d] = total[d] + flat if d in total else flat
        for d, flat in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int64()), pa.array([Decimal(int(v)) for v in flat], pa.decimal128(38, 0))], names=["d", "at", "s"])

    sums: dict[int, dict[int, int]] = {}
    for r in distinct.mapInArrow(moments, "d int, at long, s decimal(38,0)").groupBy("d", "at").agg(F.sum("s").alias("s")).collect():  # d^2 / 2 numbers
        sums.setdefault(r["d"], {})[r["at"]] = int(r["s"])
    if sum(d * min(d, most) for d in sums) > MODEL_DOUBLES:
        raise ValueError(f"components of vectors of {len(sums)} lengths are more than {MODEL_DOUBLES} numbers")
    models = {}
    for d, flat in sums.items():
        cross = np.zeros((d, d), object)
        cross[np.triu_indices(d)] = [flat[i] for i in range(1 + d, len(flat))]
        models[d] = Model.fit(flat[0], [flat[i] for i in range(1, 1 + d)], cross, most)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch, "x", "d"):
                z = models[d].whitened(x)
                z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
                total[d] = total.get(d, 0) + z.T @ z
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * s.size, pa.int32()), pa.array(range(s.size), pa.int64()), pa.array(s.ravel())], names=["d", "at", "s"])

    found: dict[int, dict[int, float]] = {}
    for r in distinct.mapInArrow(spread, "d int, at long, s double").groupBy("d", "at").agg(F.sum("s").alias("s")).collect():
        found.setdefault(r["d"], {})[r["at"]] = r["s"]
    for d, flat in found.items():
        k = len(models[d].values)
        s = np.array([flat[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1)
        live = np.flatnonzero(np.isfinite(models[d].values))
        mean = s[live, k] / models[d].n
        error = s[np.ix_(live, live)] / models[d].n - np.outer(mean, mean) - np.eye(len(live))
        models[d].identity_error = float(np.abs(error).max()) if len(live) else None
    return models


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error of each usable row."""
    ship_package(vectors.sparkSession)
    rows = integers(vectors, id_col, vector_col)
    models = fit_models(materialize(rows.select("x", "d").distinct(), "integers", "zstd"), components)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for d, own, x in _matrices(batch, "x", "d"):
                m = models[d]
                k = len(m.values)
                ids = batch.column("id").take(pa.array(np.repeat(own, k)))
                z = m.whitened(x).ravel()
                columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(z), m.n)), pa.array(np.repeat(np.array(m.deviations(x), np.int64), k)), pa.array(z, mask=np.isnan(z)), pa.array(m.explained * len(x), pa.float64()), pa.array([m.identity_error] * len(z), pa.float64())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return rows.mapInArrow(project, f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
