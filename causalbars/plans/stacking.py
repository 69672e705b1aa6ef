"""Nested stacking of ridges from one pass of sums, and paired comparison and ablation of feature families.

A ridge needs only sums of products, and so does a ridge over the predictions of ridges: predictions are linear in
the features, so their sums of products are products of the features' sums with the weights. Every train and
validation part of every outer and inner fold is a union of blocks of rows that lie between the same boundaries, by
their own ordinal and by that of their label's end (which is what purging looks at). One aggregate takes the sums of
each block; all base, inner and meta fits of a series are then small systems, solved on the executors by series. No row is
copied to a fold, and nothing reaches the driver.

Rows are (series, t, target_t, close, actual, features); times of a series are distinct, missing features count as
zero. Inner folds cut the train rows of an outer one in order of time, taking purged rows to be next to a boundary,
as they are when labels have one horizon; membership itself is exact for any horizon. Folds with fewer than ``least``
train rows or without inner validation rows give no predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.timeops import HOUR
from ..operators import linear, resampling
from ..operators.splits import CHUNK, ordinals


@dataclass(frozen=True)
class Base:
    """A base model: a ridge on some of the features."""

    name: str
    features: tuple[str, ...]
    alpha: float = 10.0


@dataclass(frozen=True)
class Inner:
    """Walk-forward folds inside a train part."""

    folds: int = 3
    start: float = 0.55
    least: int = 1


class Block:
    """The least ordinal and label ordinal of each block; all of a block's rows compare alike with boundaries."""

    def __init__(self, edges: Sequence[int], own: np.ndarray, label: np.ndarray):
        floor = np.array([0, *edges])
        self.n, self.label = floor[own], floor[label]


@dataclass(frozen=True)
class Outer:
    """A split: masks of its train and test blocks, and the ordinal of its i-th train row."""

    number: int
    train: Callable[[Block], np.ndarray]
    test: Callable[[Block], np.ndarray]
    train_rows: int
    at: Callable[[int], int]

    def inner(self, plan: Inner) -> list[int]:
        """Ordinals of the first validation rows of the inner folds."""
        head = int(self.train_rows * plan.start)
        size = (self.train_rows - head) // plan.folds
        return [self.at(head + size * i + 1) for i in range(plan.folds)] if size > 0 else []


class WalkForward:
    """Expanding folds: train rows' labels end before the fold's first row."""

    def __init__(self, folds: int = 4, start: float = 0.5):
        self.folds, self.start = folds, start

    def _first(self, k: int, rows: Column | int, floor: Callable) -> Column | int:
        head = floor(rows * self.start)
        return head + floor((rows - head) / self.folds) * k + 1

    def counts(self) -> list[Column]:
        """Train rows of each fold."""
        return [F.sum((F.col("label_n") < self._first(k, F.col("rows"), F.floor)).cast("long")) for k in range(self.folds)]

    def splits(self, rows: int, counts: Sequence[int]) -> tuple[list[Outer], list[int]]:
        firsts = [int(self._first(k, rows, np.floor)) for k in range(self.folds)] + [rows + 1]
        made = []
        for k, (u, v) in enumerate(zip(firsts, firsts[1:])):
            made.append(Outer(k + 1, lambda b, u=u: b.label < u, lambda b, u=u, v=v: (b.n >= u) & (b.n < v), int(counts[k]), lambda i: i))
        return made, firsts


class Combinatorial:
    """Each choice of ``held`` of ``groups`` time groups is a test; overlapping labels are purged, rows after a test
    group embargoed."""

    def __init__(self, groups: int = 6, held: int = 2, embargo: int = 24):
        self.groups, self.held, self.embargo = groups, held, embargo

    def _first(self, g: int, rows: Column | int, floor: Callable, least: Callable) -> Column | int:
        """The first ordinal of a group, dealt as evenly as ntile does."""
        return floor(rows / self.groups) * g + least(rows % self.groups, g) + 1

    def counts(self) -> list[Column]:
        """For each group: the greatest label ordinal in it, and how many rows before it have labels that reach it."""
        found = []
        for g in range(self.groups):
            first, after = (self._first(x, F.col("rows"), F.floor, lambda a, b: F.least(a, F.lit(b))) for x in (g, g + 1))
            found.append(F.max(F.when((F.col("n") >= first) & (F.col("n") < after), F.col("label_n"))))
            found.append(F.sum(((F.col("n") < first) & (F.col("label_n") >= first)).cast("long")))
        return found

    def splits(self, rows: int, counts: Sequence[int]) -> tuple[list[Outer], list[int]]:
        firsts = [int(self._first(g, rows, np.floor, min)) for g in range(self.groups + 1)]
        reach = [int(counts[2 * g] or 0) for g in range(self.groups)]
        before = [int(counts[2 * g + 1]) for g in range(self.groups)]
        edges = sorted({*firsts, *(r + 1 for r in reach), *(f + self.embargo for f in firsts[1:])})
        made = []
        for number, held in enumerate(combinations(range(self.groups), self.held)):

            def test(b: Block, held=held) -> np.ndarray:
                return np.any([(b.n >= firsts[g]) & (b.n < firsts[g + 1]) for g in held], axis=0)

            def train(b: Block, held=held, test=test) -> np.ndarray:
                out = [(b.n < reach[g] + 1) & (b.label >= firsts[g]) for g in held]
                out += [(b.n >= firsts[g + 1]) & (b.n < firsts[g + 1] + self.embargo) for g in held]
                return ~np.any([*out, test(b)], axis=0)

            kept = np.ones(rows, bool)
            for g in held:
                kept[max(0, firsts[g] - 1 - before[g]) : max(reach[g], firsts[g + 1] - 1 + self.embargo)] = False
            order = np.flatnonzero(kept) + 1
            made.append(Outer(number, train, test, len(order), lambda i, order=order: int(order[i - 1])))
        return made, edges


def label_ordinals(frame: DataFrame) -> DataFrame:
    """Adds ``n`` and ``rows`` (see :func:`ordinals`) and ``label_n``: how many rows of the series are not later than the
    row's label end. Counted inside chunks of 30 days and moved on, so one long series is many tasks."""
    numbered = ordinals(frame)
    whole = F.struct(*numbered.columns)
    starts = numbered.select("series", F.col("t").alias("_at"), F.lit(0).alias("_kind"), F.when(F.lit(False), whole).alias("_row"))
    ends = numbered.select("series", F.coalesce("target_t", F.col("t") + HOUR).alias("_at"), F.lit(1).alias("_kind"), whole.alias("_row"))
    both = starts.unionByName(ends).withColumn("_chunk", F.floor(F.col("_at") / CHUNK))
    is_start = (F.col("_kind") == 0).cast("long")
    counts = both.groupBy("series", "_chunk").agg(F.sum(is_start).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("series").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("series", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(is_start).over(Window.partitionBy("series", "_chunk").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn("_inside", inside).where("_kind = 1").join(counts, ["series", "_chunk"])
    return counted.select("_row.*", (F.col("_before") + F.col("_inside")).alias("label_n"))


def _block_sums(marked: DataFrame, edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """(series, own, label, m): sums of products of ("1", *names) over each block, the upper triangle as an array."""
    placed = marked.join(edges, "series")
    rank = lambda c: F.size(F.filter("edges", lambda e: e <= F.col(c)))
    values = [F.lit(1.0), *[F.col(x) for x in names]]
    products = [F.sum(a * b) for i, a in enumerate(values) for b in values[i:]]
    return placed.withColumns({"own": rank("n"), "label": rank("label_n")}).groupBy("series", "own", "label").agg(F.array(*products).alias("m"))


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    whole = np.zeros((len(flat), k, k))
    upper = np.triu_indices(k)
    whole[:, upper[0], upper[1]] = flat
    whole[:, upper[1], upper[0]] = flat
    return whole


def solve_nested(blocks: pd.DataFrame, splits: Sequence[Outer], edges: Sequence[int], names: Sequence[str], bases: Sequence[Base], meta_alpha: float, inner: Inner) -> Iterator[tuple]:
    """(split, model, offset, weights, train rows, meta rows, meta weights) of the bases and of their stack."""
    k = len(names) + 1  # "1", features, label
    sums = _square(np.stack(blocks["m"].to_numpy()), k)
    block = Block(edges, blocks["own"].to_numpy(), blocks["label"].to_numpy())
    label = k - 1

    def fit(part: np.ndarray, base: Base) -> np.ndarray:
        """Offset and weights over "1", features."""
        at = [1 + names.index(f) for f in base.features]
        offset, weights = linear.ridge_of(part, at, label, base.alpha)
        line = np.zeros(k)
        line[0], line[at] = offset, weights
        return line

    for split in splits:
        trains = split.train(block)
        part = sums[trains].sum(axis=0)
        if part[0, 0] < max(inner.least, 1):
            continue
        meta, starts = np.zeros((len(bases) + 2, len(bases) + 2)), split.inner(inner)
        for u, v in zip(starts, [*starts[1:], np.inf]):
            own = sums[trains & (block.label < u)].sum(axis=0)
            held = sums[trains & (block.n >= u) & (block.n < v)].sum(axis=0)
            if own[0, 0] < max(inner.least, 1) or not held[0, 0]:
                continue
            lines = np.stack([np.eye(k)[0], *[fit(own, b) for b in bases], np.eye(k)[label]])
            meta += lines @ held @ lines.T
        final = [fit(part, b) for b in bases]
        for base, line in zip(bases, final):
            yield split.number, base.name, line, int(part[0, 0]), int(meta[0, 0]), []
        if meta[0, 0] >= max(inner.least, 1):
            offset, weights = linear.ridge_of(meta, list(range(1, len(bases) + 1)), len(bases) + 1, meta_alpha)
            line = sum(w * x for w, x in zip(weights, final))
            line[0] += offset
            yield split.number, "stack", line, int(part[0, 0]), int(meta[0, 0]), weights.tolist()


_DDL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}
_SOLVED = {"series": pa.string(), "split": pa.int32(), "model": pa.string(), "offset": pa.float64(), "weights": pa.list_(pa.float64()), "train_rows": pa.int64(), "meta_rows": pa.int64(), "meta_weights": pa.list_(pa.float64())}


def nested_models(marked: DataFrame, bases: Sequence[Base], outer: WalkForward | Combinatorial, inner: Inner = Inner(), meta_alpha: float = 1.0) -> DataFrame:
    """Models of each split over rows of :func:`label_ordinals`: series, split, model (a base's name or ``stack``), offset,
    weights (over the sorted features of all bases; null for features that the base leaves out), train_rows, meta_rows,
    meta_weights."""
    features = sorted({f for b in bases for f in b.features})
    own = {b.name: b.features for b in bases} | {"stack": features}
    names = [*features, "actual"]
    stats = marked.groupBy("series").agg(F.max("rows").alias("rows"), F.array(*[F.coalesce(c, F.lit(0)).cast("long") for c in outer.counts()]).alias("counts"))

    def all_edges(rows: int, counts: Sequence[int]) -> tuple[list[Outer], list[int]]:
        splits, edges = outer.splits(rows, counts)
        return splits, sorted({*edges, *(u for s in splits for u in s.inner(inner))})

    def with_edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["edges"] = [all_edges(r, c)[1] for r, c in zip(frame["rows"], frame["counts"])]
            yield frame

    edges = stats.mapInPandas(with_edges, "series string, rows long, counts array<long>, edges array<long>")
    sums = _block_sums(marked, edges.select("series", "edges"), names).join(edges, "series")

    def solve(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        first = frame.iloc[0]
        splits, cuts = all_edges(int(first["rows"]), first["counts"])
        found = solve_nested(frame, splits, cuts, names, bases, meta_alpha, inner)
        rows = [(first["series"], s, model, float(line[0]), [w if f in own[model] else None for f, w in zip(features, line[1:-1].tolist())], n, m, meta) for s, model, line, n, m, meta in found]
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * len(_SOLVED), _SOLVED.values())], names=list(_SOLVED))

    return sums.groupBy("series").applyInArrow(solve, ", ".join(f"{k} {_DDL[v]}" for k, v in _SOLVED.items()))  # not pandas, to which NaN is null


def _tests(marked: DataFrame, outer: WalkForward | Combinatorial) -> DataFrame:
    """Rows of each split's test part (a row stands in one fold, or in each choice that holds its group)."""
    rows, n = F.col("rows"), F.col("n")
    if isinstance(outer, WalkForward):
        first = outer._first(0, rows, F.floor)
        size = F.floor((rows - first + 1) / outer.folds)
        fold = F.least(F.floor((n - first) / F.greatest(size, F.lit(1))), F.lit(outer.folds - 1)) + 1
        return marked.where(n >= first).withColumn("split", fold.cast("int"))
    group = F.lit(0)
    for g in range(1, outer.groups):
        group = F.when(n >= outer._first(g, rows, F.floor, lambda a, b: F.least(a, F.lit(b))), g).otherwise(group)
    held = F.array(*[F.array(*[F.lit(i) for i, c in enumerate(combinations(range(outer.groups), outer.held)) if g in c]) for g in range(outer.groups)])
    return marked.withColumn("_g", group).withColumn("split", F.explode(F.get(held, F.col("_g")))).drop("_g")


def nested_predictions(rows: DataFrame, bases: Sequence[Base], outer: WalkForward | Combinatorial, inner: Inner = Inner(), meta_alpha: float = 1.0) -> DataFrame:
    """Outer test predictions (series, model, fold, t, close, actual, pred) of each base and of the stack."""
    if len(bases) < 2 or len({b.name for b in bases} | {"stack"}) != len(bases) + 1:
        raise ValueError("stacking needs two base models or more, with names of their own")
    features = sorted({f for b in bases for f in b.features})
    kept = rows.where(F.col("actual").isNotNull()).select("series", "t", "target_t", "close", "actual", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    marked = label_ordinals(kept)
    models = nested_models(marked, bases, outer, inner, meta_alpha).select("series", "split", "model", "offset", "weights")
    scored = _tests(marked, outer).join(models, ["series", "split"])
    pred = linear.dot(features, "weights") + F.col("offset")
    return scored.select("series", "model", F.col("split").alias("fold"), "t", "close", "actual", pred.alias("pred"))


def family_subsets(families: dict[str, Sequence[str]], base: Sequence[str] = ()) -> dict[str, tuple[str, ...]]:
    """The feature sets of an ablation: none, all, each family added to ``base``, each left out of all."""
    names = [f for own in families.values() for f in own]
    if not families or not all(families.values()) or len(set(names)) != len(names) or set(names) & set(base):
        raise ValueError("families must be a partition of the candidate features, none empty")
    whole = (*base, *names)
    sets = {"base": tuple(base), "all": whole}
    sets |= {f"add:{k}": (*base, *own) for k, own in families.items()}
    return sets | {f"drop:{k}": tuple(f for f in whole if f not in own) for k, own in families.items()}


def subset_predictions(rows: DataFrame, subsets: dict[str, Sequence[str]], outer: WalkForward | Combinatorial, alpha: float = 10.0) -> DataFrame:
    """Outer test predictions of one ridge recipe over each feature set, on identical folds and from one pass; a set
    without features predicts the train mean."""
    bases = [Base(name, tuple(own), alpha) for name, own in subsets.items()]
    features = sorted({f for b in bases for f in b.features})
    kept = rows.where(F.col("actual").isNotNull()).select("series", "t", "target_t", "close", "actual", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    marked = label_ordinals(kept)
    models = nested_models(marked, bases, outer, Inner(folds=1, start=1.0)).where("model <> 'stack'").select("series", "split", "model", "offset", "weights")
    scored = _tests(marked, outer).join(models, ["series", "split"])
    return scored.select("series", "model", F.col("split").alias("fold"), "t", "close", "actual", (linear.dot(features, "weights") + F.col("offset")).alias("pred"))


def paired_comparison(predictions: DataFrame, pairs: Sequence[tuple[str, str]], resamples: int = 5000, block: int = 24, promising: int = 3, strong: int = 4) -> DataFrame:
    """One row a series and (base, candidate) pair: both errors, improvement, its block-bootstrap interval, the share of
    resamples in which the candidate is better, folds won, and the verdict of fixed rules.

    The two are compared row by row on identical folds; a row that only one of them predicts raises. The paired errors
    are written once, as the bootstrap reads them several times.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("base"), F.lit(b).alias("candidate")) for a, b in pairs]))
    error = F.abs(F.col("pred") - F.col("actual"))
    used = predictions.where(F.col("model").isin(sorted({m for p in pairs for m in p})))
    by_row = used.groupBy("series", "fold", "t").agg(F.map_from_entries(F.collect_list(F.struct("model", error.alias("e")))).alias("e"))  # one entry a model
    paired = by_row.withColumn("p", listed).select("series", "fold", "t", "p.*", F.col("e")[F.col("p.base")].alias("e_base"), F.col("e")[F.col("p.candidate")].alias("e_candidate"))
    whole = F.col("e_base").isNotNull() & F.col("e_candidate").isNotNull()
    paired = paired.withColumn("gain", F.when(whole, F.col("e_base") - F.col("e_candidate")).otherwise(F.raise_error(F.lit("rows of the two models differ")).cast("double")))
    keys = ["series", "base", "candidate"]
    paired = written(paired, "paired")
    folds = paired.groupBy(*keys, "fold").agg(F.avg("e_base").alias("b"), F.avg("e_candidate").alias("c"))
    wins = folds.groupBy(*keys).agg(F.count("*").alias("folds"), F.sum((F.round("c", 12) < F.round("b", 12)).cast("long")).alias("better_folds"))
    means = paired.groupBy(*keys).agg(F.avg("e_base").alias("base_mae"), F.avg("e_candidate").alias("candidate_mae"))
    keyed = paired.select(F.to_json(F.struct(*keys)).alias("key"), "t", F.col("gain"))
    draws = resampling.mean_interval(keyed, "key", "gain", resamples, block)
    parsed = draws.withColumn("k", F.from_json("key", "series string, base string, candidate string")).select("k.*", F.col("mean").alias("improvement"), "low", "high", "p_positive")
    joined = means.join(wins, keys).join(parsed, keys)
    better = F.round("improvement", 12) > 0
    level = F.when(better & (F.col("better_folds") >= strong) & (F.round("low", 12) > 0) & (F.col("p_positive") >= 0.95), "STRONG_EVIDENCE").when(better & (F.col("better_folds") >= promising) & (F.col("p_positive") >= 0.8), "PROMISING_NOT_CONCLUSIVE").otherwise("NO_STABLE_EVIDENCE")
    return joined.withColumn("evidence", level).withColumn("promote", F.col("evidence") != "NO_STABLE_EVIDENCE")


def ablation(predictions: DataFrame, families: Sequence[str], resamples: int = 5000, block: int = 24) -> DataFrame:
    """For each series and family: what adding it to the base gains and what leaving it out of all costs, each with a
    verdict. ``helps``: both directions improve; ``harms``: leaving it out improves with evidence."""
    pairs = [*(("base", f"add:{f}") for f in families), *((f"drop:{f}", "all") for f in families), *(("all", f"drop:{f}") for f in families)]
    done = paired_comparison(predictions, pairs, resamples, block)
    add = done.where(F.col("base") == "base").select("series", F.substring_index("candidate", ":", -1).alias("family"), F.col("improvement").alias("added_gain"), F.col("evidence").alias("added_evidence"))
    kept = done.where(F.col("candidate") == "all").select("series", F.substring_index("base", ":", -1).alias("family"), F.col("improvement").alias("kept_gain"), F.col("evidence").alias("kept_evidence"))
    left = done.where(F.col("base") == "all").select("series", F.substring_index("candidate", ":", -1).alias("family"), F.col("evidence").alias("dropped_evidence"))
    joined = add.join(kept, ["series", "family"]).join(left, ["series", "family"])
    return joined.withColumns({"helps": (F.round("added_gain", 12) > 0) & (F.round("kept_gain", 12) > 0), "harms": F.col("dropped_evidence") != "NO_STABLE_EVIDENCE"})
