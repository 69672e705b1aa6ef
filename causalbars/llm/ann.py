"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means with a penalty on large clusters; a neighbour graph over them
is small enough for every task's memory and is searched best-first. Each vector goes to the posting list of its
nearest centroid, and boundary vectors also to others nearly as near. A query reads the lists whose centroids are
within a ratio of its nearest centroid's distance: queries inside a cluster read a few lists, queries in no
cluster read many. The ratio is calibrated on the sample for ``WANTED_RECALL``.

Only centroids, their graph and each list's size (at most MAX_LISTS entries) are held by every task. Long lists
are cut into pages, pages are dealt to cells of about CELL_VECTORS vectors, and queries are cut into portions, so a
task's memory is bounded however many vectors are alike; every page of a list is read, so nothing is dropped. A
query's vector travels once to each cell, with the lists it reads there, and a cell sends back its ``k`` best over
all of these (exact ties settled by id), which are merged by query.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part; rows with a null id take no part; repeated ids count once, by their best score; ties go to the
smaller id; queries with fewer candidates get all of them; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fields, ship_package

#: Most vectors that centroids and ratio are fitted on: those with the lowest hashes of their ids.
SAMPLE = 20_000
MAX_LISTS = 2048
#: Vectors a list, on average, until there are MAX_LISTS lists.
LIST_VECTORS = 200
#: Most lists that a boundary vector is written to, and how much farther than the nearest they may be.
COPIES, BOUNDARY = 2, 1.1
#: Vectors of a page and of a cell, queries of a portion, on average.
PAGE, CELL_VECTORS, PORTION = 4096, 65_536, 50_000
NEIGHBOURS = 24
WANTED_RECALL = 0.97
_CALIBRATION_QUERIES = 400


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squared, 0))


def balanced_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means whose distances grow with the size of the cluster, so clusters stay of like size."""
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    sizes = np.full(k, len(x) / k)
    for _ in range(rounds):
        d = _distances(x, centres)
        nearest = np.argmin(d * d + 0.05 * float(np.mean(d.min(1) ** 2) + 1e-9) * sizes[None, :] * k / len(x), axis=1)
        sizes = np.bincount(nearest, minlength=k).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


@dataclass
class Index:
    """Centroids, their neighbour graph, and the query ratio."""

    centres: np.ndarray
    graph: np.ndarray
    ratio: float = 1.0

    @staticmethod
    def build(centres: np.ndarray) -> Index:
        near = np.argsort(_distances(centres, centres), axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        ring = (np.arange(len(centres)) + 1) % len(centres)  # keeps the graph in one piece
        return Index(centres.astype(np.float32), np.concatenate([near, ring[:, None]], axis=1).astype(np.int32))

    def search(self, x: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances to the centroids that a best-first search of the graph meets (inf: not met).

        A row goes on while its nearest unexpanded centroid is within ``ratio`` of the best, or among the
        ``least`` best.
        """
        rows = np.arange(len(x))
        met = np.full((len(x), len(self.centres)), np.inf, np.float32)
        closed = np.zeros(met.shape, bool)
        norms = (self.centres * self.centres).sum(1)
        own = (x * x).sum(1)

        def meet(r: np.ndarray, c: np.ndarray) -> None:
            dots = np.einsum("rd,rcd->rc", x[r], self.centres[c])
            met[r[:, None], c] = np.sqrt(np.maximum(own[r][:, None] + norms[c] - 2 * dots, 0))

        starts = np.unique(np.linspace(0, len(self.centres) - 1, 8).astype(int))
        meet(rows, np.tile(starts, (len(x), 1)))
        active = rows
        while len(active):
            d = np.where(closed[active], np.inf, met[active])
            best = np.argmin(d, axis=1)
            at = d[np.arange(len(active)), best]
            if least < met.shape[1]:
                kth = np.partition(met[active], least - 1, axis=1)[:, least - 1]
            else:
                kth = np.full(len(active), np.inf)
            go = np.isfinite(at) & (at <= np.maximum(kth, ratio * met[active].min(1)))
            active, best = active[go], best[go]
            closed[active, best] = True
            if len(active):
                meet(active, self.graph[best])
        return met

    def lists_of_vectors(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists each vector is written to: the nearest, and for boundary vectors others nearly as near."""
        met = self.search(x, 1.0, min(16, len(self.centres)))
        order = np.argsort(met, axis=1)[:, :COPIES]
        found = np.take_along_axis(met, order, axis=1)
        return [o[d <= BOUNDARY * d[0] + 1e-6] for o, d in zip(order, found)]

    def lists_of_queries(self, x: np.ndarray) -> list[np.ndarray]:
        met = self.search(x, self.ratio, min(16, len(self.centres)))
        bound = self.ratio * met.min(1) + 1e-6
        return [np.flatnonzero(d <= b) for d, b in zip(met, bound)]


def fit(sample: np.ndarray, total: int, k: int) -> Index:
    """Index over unit vectors of a bounded sample of ``total`` vectors; the ratio is set for ``k`` neighbours."""
    distinct = np.unique(sample, axis=0)
    lists = int(np.clip(total // LIST_VECTORS, 1, min(MAX_LISTS, max(1, len(distinct) // 8))))
    index = Index.build(balanced_means(distinct, lists))
    queries = distinct[np.random.default_rng(1).choice(len(distinct), min(_CALIBRATION_QUERIES, len(distinct)), replace=False)]
    to_centres = _distances(queries, index.centres)
    scores = queries @ distinct.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, 1 : k + 1]
    if near.size:
        written = index.lists_of_vectors(distinct[near.ravel()])
        rows = np.repeat(np.arange(len(queries)), near.shape[1])
        needed = np.array([to_centres[r, w].min() for r, w in zip(rows, written)]) / np.maximum(to_centres.min(1)[rows], 1e-6)
        index.ratio = float(np.quantile(needed, WANTED_RECALL)) + 1e-3
    return index


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, largest entries near one: exact, and squares neither over- nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def best_of_cell(query_ids, queries, read, vec_ids, vectors, lists, k: int):
    """(query, vector, score) of the k best vectors of the lists that each query reads: exact cosine, ties to the
    smaller id. The query's own id is left out and the cut is widened until it holds k different ids, however often
    an id is repeated. ``read`` holds an array of list numbers for each query, ``lists`` the list of each vector."""
    out_q, out_v, out_s = [], [], []
    order = np.argsort(lists, kind="stable")
    vec_ids, vectors, lists, queries = vec_ids[order], _scaled(vectors[order]), lists[order], _scaled(queries)
    unit, norms = _unit(vectors), np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
    asked = _unit(queries)
    for i, own in enumerate(read):
        starts, ends = np.searchsorted(lists, own), np.searchsorted(lists, own, side="right")
        if (ends - starts).sum() > len(lists) // 2:
            scores = unit @ asked[i]
            open_ = np.zeros(len(lists), bool)
            for s, e in zip(starts, ends):
                open_[s:e] = True
            scores[~open_] = -np.inf
            rows = None
        else:
            rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]) if len(own) else np.zeros(0, np.int64)
            scores = unit[rows] @ asked[i]
        scores[(vec_ids if rows is None else vec_ids[rows]) == query_ids[i]] = -np.inf
        usable, keep = int(np.isfinite(scores).sum()), COPIES * k  # a vector may stand in several lists
        while True:
            bound = np.partition(scores, len(scores) - keep)[len(scores) - keep] - 1e-9 if usable > keep else -np.inf
            near = np.flatnonzero(np.isfinite(scores) & (scores >= bound))
            near = near if rows is None else rows[near]
            if keep >= usable or len(np.unique(vec_ids[near])) >= k:
                break
            keep *= 4
        q = queries[i]
        exact = np.einsum("nd,d->n", vectors[near], q) / (norms[near] * np.sqrt(np.einsum("d,d->", q, q)))
        order = np.lexsort((vec_ids[near], -exact))
        best = order[np.sort(np.unique(vec_ids[near][order], return_index=True)[1])[:k]]
        out_q += [query_ids[i]] * len(best)
        out_v += vec_ids[near][best].tolist()
        out_s += exact[best].tolist()
    return out_q, out_v, out_s


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found (largest cosine) of each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(f"`{vector_col}`")
    kind = vectors.schema[vector_col].dataType
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    usable = usable.where(finite & F.exists("v", lambda x: x != 0))
    out = "query_id long, rank int, vec_id long, score double"
    size = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], out)
    usable = usable.where(F.size("v") == size["n"])
    share = min(1.0, 2 * SAMPLE / size["count"])  # so that partitions send about 2 x SAMPLE rows together, not each
    some = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = some.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    index = fit(_unit(np.array([r["v"] for r in sample])), size["count"], k)
    lists = len(index.centres)

    def units(batch: pa.RecordBatch) -> np.ndarray:
        return _unit(_matrix(batch.column("v"))).astype(np.float32)

    def sizes(batches):
        for batch in batches:
            found = np.zeros(lists, np.int64)
            for at in range(0, batch.num_rows, 512):
                for own in index.lists_of_vectors(units(batch.slice(at, 512))):
                    found[own] += 1
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(found[used])], names=["list", "n"])

    counts = np.zeros(lists, np.int64)
    for r in usable.mapInArrow(sizes, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # at most MAX_LISTS rows
        counts[r["list"]] = r["n"]
    pages = np.maximum(1, -(-counts // PAGE))
    cells = int(max(1, -(-counts.sum() // CELL_VECTORS)))
    portions = int(max(1, -(-usable.where("q").count() // PORTION)))

    def cell_of(number, page):
        return (number * 7919 + page * 104_729) % cells

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, number, cell = [], [], []
                for i, (vec, own) in enumerate(zip(part.column("id").to_pylist(), index.lists_of_vectors(units(part)))):
                    for x in own.tolist():
                        at_cell = cell_of(x, vec * 2_654_435_761 % 2**32 % int(pages[x]))
                        for portion in range(portions):
                            rows.append(i)
                            number.append(x)
                            cell.append(at_cell * portions + portion)
                taken = part.select(["id", "v"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(number, pa.int32()), pa.array(cell, pa.int64())], names=["id", "v", "list", "cell"])

    def ask(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, read, cell = [], [], []
                for i, (vec, own) in enumerate(zip(part.column("id").to_pylist(), index.lists_of_queries(units(part)))):
                    wanted: dict[int, set[int]] = {}
                    for x in own.tolist():
                        for page in range(int(pages[x])):
                            wanted.setdefault(int(cell_of(x, page)), set()).add(x)
                    for c, numbers in sorted(wanted.items()):
                        rows.append(i)
                        read.append(sorted(numbers))
                        cell.append(c * portions + vec % portions)
                taken = part.select(["id", "v"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(read, pa.list_(pa.int32())), pa.array(cell, pa.int64())], names=["id", "v", "read", "cell"])

    def typed(ddl: str) -> T.StructType:
        return T.StructType([T.StructField("id", T.LongType()), T.StructField("v", kind), *fields(ddl)])

    posted = usable.mapInArrow(post, typed("list int, cell long"))
    asked = usable.where("q").mapInArrow(ask, typed("read array<int>, cell long"))

    def compare(queries: pa.Table, page: pa.Table) -> pa.Table:
        found = ([], [], [])
        if queries.num_rows and page.num_rows:
            read = [np.array(x, np.int64) for x in queries.column("read").to_pylist()]
            found = best_of_cell(queries.column("id").to_numpy(), _matrix(queries.column("v")), read, page.column("id").to_numpy(), _matrix(page.column("v")), page.column("list").to_numpy(), k)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    near = asked.groupBy("cell").cogroup(posted.groupBy("cell")).applyInArrow(compare, T.StructType(fields("query_id long, vec_id long, score double")))
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
