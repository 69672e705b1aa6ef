"""Near-duplicates of embeddings by navigable small-world graphs.

Equal vectors are one node. Nodes are dealt to shards by hash, and a task builds the graph of its shard. Every vector
queries every shard: two shards meet in one task, where each one's vectors search the other's graph (a shard meets
itself as well). Beams widen until an audit passes: probes turned from members of the searched shard to just above the
threshold, the hardest links there are, and a part of the real queries are compared with a scan of the shard, and
RECALL of their links must be found. Queries with a link, or nearly one, search again with a wider beam; those whose beam is half full of
links may have more of them than a beam holds and are answered by scanning the shard in blocks. Cosines of all candidates are computed in double precision.

A pair of shards gives one row for each vector with links: how many (counted with repeats), and a neighbour in a
spanning forest of the links found there. Links themselves are never sent, so a dense group of g vectors costs g rows
a pair of shards. The forests are joined by distributed connected components.

A shard holds at most SHARD_BYTES of vectors, so tasks stay of one size; their number grows with the square of the
number of shards, as every shard is queried.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing (their
own row stays); vectors of different lengths do not link; repeated rows are vectors of their own that link with each
other; rows with a null id link and count, and a component's id is its least id that is not null; an empty table gives
an empty table; only id and vector are read. Norms are taken after division by the largest component, so extreme
values neither over- nor underflow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hnsw import DEGREE, Graph
from ._spark import connected_components, materialize, ship_package

THRESHOLD = 0.95
#: Bytes of a shard's vectors as doubles; shards there are at least, if each has LEAST_ROWS.
SHARD_BYTES, LEAST_SHARDS, LEAST_ROWS = 24 << 20, 8, 256
#: Width of the first beam; share of audited links to be found; probes and real queries of an audit.
BEAM, RECALL, PROBES = 16, 0.99, 128
#: How much wider the beam of queries is that have a node within NEARLY of the threshold.
WIDER, NEARLY = 4, 0.05
#: What single precision may miss of a similarity.
_SLACK = 1e-4
_BLOCK = 64


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``a[i]`` and ``b[i]``; ``root`` names the least node of each node's tree."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root[:] = above


class Shard:
    """Nodes of one shard: ids, how many rows each stands for, unit vectors, graph."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, x: np.ndarray, layers: list[np.ndarray] | None = None):
        self.nodes, self.weights, self.x = nodes, weights, x
        single = x.astype(np.float32)
        self.graph = Graph.build(single) if layers is None else Graph(single, layers)

    def found(self, q: np.ndarray, width: int, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified links (query, node) of the queries, and whether each query's beam is half full of links. Queries
        with a link or nearly one search again with a beam of WIDER times the width."""
        single = q.astype(np.float32)
        ids, sims = self.graph.search(single, width)
        ids, sims = (np.pad(a, ((0, 0), (0, (WIDER - 1) * width)), constant_values=v) for a, v in ((ids, -1), (sims, -np.inf)))
        close = sims >= threshold - NEARLY
        if own:
            close &= ids != np.arange(len(q))[:, None]
        again = np.flatnonzero(close.any(1))
        if len(again):
            ids[again], sims[again] = self.graph.search(single[again], WIDER * width)
        near = (ids >= 0) & (sims >= threshold - _SLACK)
        full = near.sum(1) * 2 >= width
        i, at = np.nonzero(near & ~full[:, None])
        j = ids[i, at]
        linked = np.einsum("nd,nd->n", q[i], self.x[j]) >= threshold
        if own:
            linked &= i != j
        return i[linked], j[linked], full

    def audited(self, q: np.ndarray, width: int, threshold: float) -> bool:
        """Whether a beam finds RECALL of the links of probes and of a part of the queries."""
        rng = np.random.default_rng(len(q))
        some = self.x[np.unique(np.linspace(0, len(self.x) - 1, PROBES).astype(int))]
        aside = rng.standard_normal(some.shape)
        aside -= np.einsum("nd,nd->n", aside, some)[:, None] * some
        norm = np.sqrt(np.einsum("nd,nd->n", aside, aside))[:, None]
        cosine = threshold + (1 - threshold) / 50
        turned = unit(cosine * some + np.sqrt(1 - cosine * cosine) * np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9))
        asked = np.concatenate([turned, q[np.unique(np.linspace(0, len(q) - 1, PROBES).astype(int))]])
        i, j, full = self.found(asked, width, threshold, False)
        links = asked @ self.x.T >= threshold
        links[full] = False
        return links[i, j].sum() >= RECALL * links.sum()

    def links(self, other: Shard, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links (row of other, row of self) of the other's vectors, and the rows of other to be scanned instead."""
        width = BEAM
        while width < len(self.x) and not self.audited(other.x, width, threshold):
            width *= 2
        if width >= len(self.x):
            none = np.zeros(0, np.int64)
            return none, none, np.ones(len(other.x), bool)
        return self.found(other.x, width, threshold, own)


def compare(a: Shard, b: Shard | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, its number of links, a node of its tree) of the vectors of two shards, or of one (b: None)."""
    own = b is None
    other = a if own else b
    base = 0 if own else len(a.x)
    counts = np.zeros(base + len(other.x), np.int64)
    root = np.arange(len(counts))
    i, j, scan_a = other.links(a, threshold, own)
    if own:
        pairs, scan_b = np.stack([i, j], 1), scan_a
    else:
        back_j, back_i, scan_b = a.links(b, threshold, own)
        pairs = np.concatenate([np.stack([i, j], 1), np.stack([back_i, back_j], 1)])

    def scan(left: Shard, right: Shard, rows: np.ndarray, at: int, right_at: int, left_open: np.ndarray) -> None:
        """Whole rows of the link matrix; ``left_open``: columns that are not scanned themselves."""
        for start in range(0, len(rows), _BLOCK):
            block = rows[start : start + _BLOCK]
            linked = left.x[block] @ right.x.T >= threshold
            if own:
                linked[np.arange(len(block)), block] = False
            counts[at + block] += linked @ right.weights
            counts[right_at : right_at + len(right.x)] += np.where(left_open, left.weights[block] @ linked, 0)
            r, c = np.nonzero(linked)
            merge(root, at + block[r], right_at + c)

    scan(a, other, np.flatnonzero(scan_a), 0, base, ~scan_b)
    if not own:
        scan(b, a, np.flatnonzero(scan_b), base, 0, ~scan_a)
    pairs = pairs[~scan_a[pairs[:, 0]] & ~scan_b[pairs[:, 1]]]  # the others have been counted
    pairs = np.unique(np.sort(pairs, axis=1) if own else pairs, axis=0)
    np.add.at(counts, pairs[:, 0], other.weights[pairs[:, 1]])
    np.add.at(counts, base + pairs[:, 1], a.weights[pairs[:, 0]])
    merge(root, pairs[:, 0], base + pairs[:, 1])
    linked = np.flatnonzero(counts)
    nodes = a.nodes if own else np.concatenate([a.nodes, b.nodes])
    return nodes[linked], counts[linked], nodes[root[linked]]


_STORED = "d int, shard long, shards long, nodes binary, weights binary, x binary, layers array<binary>"


def _built(table: pa.Table) -> pa.Table:
    """The stored form of a shard's nodes."""
    d = table["d"][0].as_py()
    order = np.random.default_rng(0).permutation(table.num_rows)
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    shard = Shard(table["node"].to_numpy()[order], table["weight"].to_numpy()[order], unit(flat.reshape(-1, d)[order]))
    row = {"d": d, "shard": table["shard"][0].as_py(), "shards": table["shards"][0].as_py(), "nodes": shard.nodes.tobytes(), "weights": shard.weights.tobytes(), "x": shard.x.tobytes(), "layers": [x.tobytes() for x in shard.graph.layers]}
    kinds = {"d": pa.int32(), "shard": pa.int64(), "shards": pa.int64(), "nodes": pa.binary(), "weights": pa.binary(), "x": pa.binary(), "layers": pa.list_(pa.binary())}
    return pa.table({k: pa.array([row[k]], t) for k, t in kinds.items()})


def _stored(table: pa.Table, at: int) -> Shard:
    nodes, weights = (np.frombuffer(table[c][at].as_py(), np.int64) for c in ("nodes", "weights"))
    layers = [np.frombuffer(x, np.int32).reshape(-1, DEGREE) for x in table["layers"][at].as_py()]
    return Shard(nodes, weights, np.frombuffer(table["x"][at].as_py(), np.float64).reshape(len(nodes), -1), layers)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links (other rows with a cosine of ``threshold`` or more), component_id (least id reachable by links) and
    kept (the row's id is its component's) of each row."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    usable = F.coalesce(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    good = rows.where(usable)
    distinct = good.groupBy("v").agg(F.count("*").alias("weight"), F.min("id").alias("least")).withColumns({"d": F.size("v"), "node": F.monotonically_increasing_id()})
    nodes = materialize(distinct, "vectors", "zstd")
    room = F.ceil(F.col("n") * F.col("d") * 8 / SHARD_BYTES)
    sizes = nodes.groupBy("d").agg(F.count("*").alias("n")).select("d", F.greatest(room, F.least(F.lit(LEAST_SHARDS), F.ceil(F.col("n") / LEAST_ROWS))).alias("shards"))
    dealt = nodes.select("d", "node", "weight", "v").join(sizes, "d").withColumn("shard", F.pmod(F.xxhash64("node"), "shards"))
    dealt = dealt.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "d", "shard")  # by number: shards are heavy, whatever their bytes
    built = materialize(dealt.groupBy("d", "shard").applyInArrow(_built, _STORED), "graphs", "zstd")

    def meet(table: pa.Table) -> pa.Table:
        shards = [_stored(table, i) for i in np.argsort(table["shard"].to_numpy())]
        found = compare(shards[0], shards[1] if len(shards) > 1 else None, threshold)
        return pa.table(dict(zip(("node", "links", "tree"), map(pa.array, found))))

    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    meeting = built.withColumn("partner", partner).withColumns({"low": F.least("shard", "partner"), "high": F.greatest("shard", "partner")})
    links = materialize(meeting.drop("partner", "shards").groupBy("d", "low", "high").applyInArrow(meet, "node long, links long, tree long"), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    trees = connected_components(links.select(F.col("node").alias("a"), F.col("tree").alias("b"))).toDF("node", "tree")
    named = nodes.select("node", "v", "weight", "least").join(counts, "node", "left").join(trees, "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    named = materialize(named, "named", "zstd")
    least = named.groupBy("tree").agg(F.min("least").alias("component_id"))
    named = named.join(least, "tree").select(F.col("v").alias("w"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    done = good.join(named, F.col("v") == F.col("w")).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return done.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
