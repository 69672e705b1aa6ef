"""Nested stacking, paired comparison and ablation against direct refits row by row."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalbars.operators import splits
from causalbars.plans import stacking
from causalbars.plans.stacking import Base, Combinatorial, Inner, WalkForward

HOUR = 3600
BASES = (Base("one", ("f1",), 10.0), Base("two", ("f2", "f3"), 3.0), Base("all", ("f1", "f2", "f3"), 1.0))


def made_rows(seed, n, horizon=1):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(np.arange(n * 2), n, replace=False)) * HOUR
    x = rng.normal(size=(n, 3))
    y = x @ np.array([0.4, -0.2, 0.1]) + rng.normal(size=n)
    return [(f"s{seed}", int(a), None if i % 41 == 7 else int(a) + horizon * HOUR, 100.0, float(b), float(c[0]), float(c[1]), None if i % 29 == 3 else float(c[2])) for i, (a, b, c) in enumerate(zip(t, y, x))]


@pytest.fixture(scope="module")
def table(spark):
    rows = made_rows(1, 400) + made_rows(2, 333, 5)
    return rows, spark.createDataFrame(rows, "series string, t long, target_t long, close double, actual double, f1 double, f2 double, f3 double").repartition(5).persist()


def plain_ridge(x, y, alpha):
    if not x.shape[1]:
        return lambda z: np.full(len(z), y.mean())
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda q: (q - m) / s @ w + y.mean()


def plain_nested(rows, parts, inner, bases=BASES, meta_alpha=1.0):
    """{(fold, model, t): pred} of one series by refitting everything on its own rows."""
    t = np.array([r[1] for r in rows])
    end = np.array([r[2] if r[2] is not None else r[1] + HOUR for r in rows])
    y = np.array([r[4] for r in rows])
    x = np.array([[0.0 if v is None else v for v in r[5:]] for r in rows])
    at = {b.name: [("f1", "f2", "f3").index(f) for f in b.features] for b in bases}
    found = {}
    for fold, train, test in parts(t, end):
        own = np.flatnonzero(train)
        head = int(len(own) * inner.start)
        size = (len(own) - head) // inner.folds
        meta_x, meta_y = [], []
        for i in range(inner.folds):
            held = own[head + i * size : (head + (i + 1) * size if i < inner.folds - 1 else len(own))]
            fitted = own[end[own] < t[held[0]]]
            meta_x.append(np.stack([plain_ridge(x[np.ix_(fitted, at[b.name])], y[fitted], b.alpha)(x[np.ix_(held, at[b.name])]) for b in bases], 1))
            meta_y.append(y[held])
        stack = plain_ridge(np.concatenate(meta_x), np.concatenate(meta_y), meta_alpha)
        final = np.stack([plain_ridge(x[np.ix_(own, at[b.name])], y[own], b.alpha)(x[np.ix_(test, at[b.name])]) for b in bases], 1)
        for k, b in enumerate(bases):
            found |= {(fold, b.name, int(a)): p for a, p in zip(t[test], final[:, k])}
        found |= {(fold, "stack", int(a)): p for a, p in zip(t[test], stack(final))}
    return found


def walk_parts(folds, start):
    def parts(t, end):
        head = int(len(t) * start)
        size = (len(t) - head) // folds
        for k in range(folds):
            test = np.arange(head + k * size, head + (k + 1) * size if k < folds - 1 else len(t))
            yield k + 1, end < t[test[0]], test

    return parts


def combinatorial_parts(groups, held, embargo):
    def parts(t, end):
        bounds = np.cumsum([0, *[len(t) // groups + (g < len(t) % groups) for g in range(groups)]])
        for number, chosen in enumerate(itertools.combinations(range(groups), held)):
            out = np.zeros(len(t), bool)
            test = np.zeros(len(t), bool)
            for g in chosen:
                lo, hi = bounds[g], bounds[g + 1]
                test[lo:hi] = True
                out |= (t <= end[lo:hi].max()) & (end >= t[lo])
                out[hi : hi + embargo] = True
            yield number, ~out & ~test, np.flatnonzero(test)

    return parts


@pytest.mark.parametrize("outer, parts", [(WalkForward(4, 0.5), walk_parts(4, 0.5)), (Combinatorial(5, 2, 24), combinatorial_parts(5, 2, 24))])
def test_nested_predictions_equal_refits(table, outer, parts):
    rows, frame = table
    got = {}
    for r in stacking.nested_predictions(frame, BASES, outer, Inner(3, 0.55)).collect():
        got[r["series"], r["fold"], r["model"], r["t"]] = r["pred"]
    expected = {}
    for s in ("s1", "s2"):
        expected |= {(s, *k): v for k, v in plain_nested([r for r in rows if r[0] == s], parts, Inner(3, 0.55)).items()}
    assert got.keys() == expected.keys()
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-9


def test_outer_parts_are_those_of_the_splitters(table):
    _, frame = table
    marked = stacking.label_ordinals(frame)
    tests = {(r["series"], r["split"], r["t"]) for r in stacking._tests(marked, Combinatorial(6, 2, 24)).collect()}
    assert tests == {(r["series"], r["split_id"], r["t"]) for r in splits.combinatorial(frame).where("role = 'test'").collect()}
    tests = {(r["series"], r["split"], r["t"]) for r in stacking._tests(marked, WalkForward(4, 0.5)).collect()}
    assert tests == {(r["series"], r["fold"], r["t"]) for r in splits.walk_forward(frame).where("role = 'validation'").collect()}


def test_nothing_is_solved_on_the_driver(table, monkeypatch):
    _, frame = table
    monkeypatch.setattr(type(frame), "collect", lambda self: pytest.fail("collected"))
    plan = stacking.nested_predictions(frame, BASES, WalkForward())
    monkeypatch.undo()
    assert plan.where("model = 'stack'").count() > 0


def test_folds_without_enough_rows_are_left_out(spark, table):
    rows, frame = table
    short = spark.createDataFrame(rows[:9], frame.schema)
    assert stacking.nested_predictions(short, BASES, WalkForward(), Inner(least=100)).count() == 0
    assert stacking.nested_predictions(frame.where("false"), BASES, WalkForward()).count() == 0
    with pytest.raises(ValueError):
        stacking.nested_predictions(frame, BASES[:1], WalkForward())


FAMILIES = {"first": ("f1",), "second": ("f2",), "noise": ("f3",)}


def test_ablation_finds_the_families_that_help(table):
    rows, frame = table
    sets = stacking.family_subsets(FAMILIES)
    assert sets["drop:second"] == ("f1", "f3") and sets["add:first"] == ("f1",) and sets["base"] == ()
    predictions = stacking.subset_predictions(frame, sets, WalkForward(4, 0.5)).persist()
    bases = tuple(Base(n, tuple(f), 10.0) for n, f in sets.items())
    own = [r for r in rows if r[0] == "s1"]
    expected = plain_nested(own, walk_parts(4, 0.5), Inner(3, 0.55), bases)
    got = {(r["fold"], r["model"], r["t"]): r["pred"] for r in predictions.where("series = 's1'").collect()}
    assert got.keys() == {k for k in expected if k[1] != "stack"}
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-9
    verdict = {(r["series"], r["family"]): r for r in stacking.ablation(predictions, list(FAMILIES), 300).collect()}
    assert verdict["s1", "first"]["helps"] and verdict["s1", "first"]["added_evidence"] == "STRONG_EVIDENCE"
    assert not any(r["harms"] for k, r in verdict.items() if k[1] == "first") and len(verdict) == 6
    with pytest.raises(ValueError):
        stacking.family_subsets({"a": ("f1",), "b": ("f1", "f2")})


def test_comparison_needs_the_same_rows(table):
    _, frame = table
    predictions = stacking.subset_predictions(frame, {"a": ("f1",), "b": ("f1", "f2")}, WalkForward())
    report = stacking.paired_comparison(predictions, [("a", "b")], 200).where("series = 's1'").first()
    errors = {}
    for r in predictions.where("series = 's1'").collect():
        errors.setdefault(r["model"], {})[r["fold"], r["t"]] = abs(r["pred"] - r["actual"])
    assert abs(report["base_mae"] - np.mean(list(errors["a"].values()))) < 1e-12
    assert abs(report["improvement"] - (report["base_mae"] - report["candidate_mae"])) < 1e-12 and report["folds"] == 4
    assert report["low"] <= report["improvement"] <= report["high"]
    with pytest.raises(Exception, match="rows of the two models differ"):
        stacking.paired_comparison(predictions.where(F.expr("model = 'a' OR t % 7200 = 0")), [("a", "b")], 50).collect()
