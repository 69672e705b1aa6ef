"""SimHash near-duplicates with BK-trees.

Each text gets a 64-bit fingerprint: a bit is set if over half of its shingles' hashes have it set. Distinct
fingerprints are dealt to shards by pigeonhole: fingerprints within ``radius`` bits agree in at least one of
``radius + 1`` blocks of bits, so each shard holds the fingerprints that agree in one block. A task builds a
BK-tree for each of its shards (children keyed by Hamming distance to the parent) and follows only the edges
within the radius. Found nodes are taken out of the tree, so a shard gives a spanning forest (fewer links than
fingerprints) and never all pairs of a dense group. The forests are joined by distributed connected components.

Shards go to the tasks by a shuffle rather than a broadcast, because their total size grows with the corpus.
A block value with more than ``max_shard`` fingerprints is split into chunks, and each pair of chunks is a
shard of its own, so a task's trees are bounded and no pair is lost. Equal fingerprints count once: copies cost
one node however many there are.

Defined results: null and empty texts have no words and fingerprint zero, and link like any other; texts with
fewer words than a shingle are one shingle; repeated rows give equal rows; a null id stays null in its row and
names a component only if all its ids are null; only the named columns are read; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import connected_components, fields, map_texts, materialize, ship_package

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Most fingerprints of one tree; larger shards are split into pairs of chunks.
MAX_SHARD = 50_000
#: Fingerprints that a task handles, on average, over all its shards.
TASK_ROWS = 20_000
#: Characters of texts that are hashed together, unless one text alone has more.
MAX_CHARS = 1 << 22
_CHUNK = 1 << 18


def fingerprints(texts: Sequence[str], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as uint64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(texts) > 1 and sum(map(len, texts)) > MAX_CHARS:  # the hashes of a part are in memory together
        half = len(texts) // 2
        return np.concatenate([fingerprints(texts[:half], shingle), fingerprints(texts[half:], shingle)])
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, SEED))
            sizes[i] = 1
            continue
        edges = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
        starts, ends = edges[:-shingle].tolist(), (edges[shingle:] - 1).tolist()
        hashes += [digest(joined[s:e], SEED) for s, e in zip(starts, ends)]
        sizes[i] = len(starts)
    every = np.array(hashes, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ones = np.zeros((len(texts), BITS), np.int64)
    for at in range(0, len(every), _CHUNK):
        part, own = every[at : at + _CHUNK], owner[at : at + _CHUNK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


class BKTree:
    """A BK-tree whose nodes can be taken out; subtrees without live nodes are not entered."""

    def __init__(self, keys: Sequence[int]):
        self.keys = list(keys)
        self.children: list[dict[int, int]] = [{} for _ in self.keys]
        self.parent = [-1] * len(self.keys)
        self.live = [1] * len(self.keys)
        self.taken = [False] * len(self.keys)
        for i in range(1, len(self.keys)):
            at = 0
            while True:
                self.live[at] += 1
                d = (self.keys[i] ^ self.keys[at]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = i
                    self.parent[i] = at
                    break
                at = below

    def take(self, i: int) -> None:
        self.taken[i] = True
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def near(self, key: int, radius: int) -> list[int]:
        """Live nodes within the radius."""
        found, open_nodes = [], [0] if self.live[0] else []
        while open_nodes:
            at = open_nodes.pop()
            d = (key ^ self.keys[at]).bit_count()
            if d <= radius and not self.taken[at]:
                found.append(at)
            children = self.children[at]
            for edge in range(d - radius, d + radius + 1) if len(children) > 2 * radius else children:
                below = children.get(edge)
                if below is not None and d - radius <= edge <= d + radius and self.live[below]:
                    open_nodes.append(below)
        return found


def link(keys: Sequence[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (indices) of a spanning forest of the graph "within the radius" over distinct keys."""
    tree, links = BKTree(keys), []
    for root in range(len(keys)):
        if tree.taken[root]:
            continue
        tree.take(root)
        reached = [root]
        while reached:
            for i in tree.near(keys[reached.pop()], radius):
                tree.take(i)
                links.append((root, i))
                reached.append(i)
    return links


def _blocks(fp: F.Column, radius: int) -> F.Column:
    """(block, value) of each of the radius + 1 blocks of bits."""
    cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ])


def near_links(distinct: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links (a, b) that join all of ``distinct`` (column fp, no repeats) that are within the radius."""
    spark = distinct.sparkSession
    ship_package(spark)
    rows = distinct.select("fp", F.explode(_blocks(F.col("fp"), radius)).alias("b")).select("fp", "b.block", "b.value")
    total = distinct.count()
    heavy = rows.groupBy("block", "value").count().where(F.col("count") > max_shard)
    heavy = materialize(heavy.select("block", "value", F.ceil(F.col("count") / max_shard).cast("int").alias("chunks")), "heavy")
    if heavy.isEmpty():
        sharded = rows.withColumn("pair", F.lit(0))
    else:  # each pair of chunks is a shard; a row goes to all pairs that hold its chunk
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j))
        sharded = rows.join(heavy, ["block", "value"], "left").withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("chunks")
    tasks = max(1, -(-total * (radius + 1) // TASK_ROWS))
    key = F.pmod(F.xxhash64("block", "value", "pair"), F.lit(tasks)).cast("int")

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("block", "value", "pair", "fp")]
        order = np.lexsort(columns[::-1])
        block, value, pair, fp = (c[order] for c in columns)
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])])
        edges = [*np.flatnonzero(new).tolist(), len(fp)]
        a, b = [], []
        unsigned = fp.astype(np.uint64).tolist()
        for s, e in zip(edges, edges[1:]):
            if e - s > 1:
                for i, j in link(unsigned[s:e], radius):
                    a.append(s + i)
                    b.append(s + j)
        return pa.table({"a": fp[np.array(a, np.int64)], "b": fp[np.array(b, np.int64)]})

    return sharded.withColumn("task", key).groupBy("task").applyInArrow(run, T.StructType(fields("a long, b long"))).distinct()


def fingerprint(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns plus fp (the fingerprint as a signed long) of each text."""
    return map_texts(docs, text_col, keep, "fp long", lambda texts: [pa.array(fingerprints(texts, shingle).view(np.int64))])


def components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (least id reachable) of each row."""
    prints = materialize(fingerprint(docs, text_col, (id_col,), shingle).toDF("id", "fp"), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = connected_components(near_links(distinct.select("fp"), radius)).toDF("fp", "root")
    rooted = distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents that name their component, columns unchanged; rows without an id are kept.

    Rows that share an id and all their other columns are reduced to one; rows that share only the id all stay.
    """
    found = components(docs, text_col, id_col, shingle, radius)
    winners = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("winner")).distinct()
    row = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = row.join(winners, F.col("own_id") == F.col("winner"), "left_semi")
    plain = not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema)  # such rows cannot be compared
    kept = kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return (kept.dropDuplicates() if plain else kept).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
