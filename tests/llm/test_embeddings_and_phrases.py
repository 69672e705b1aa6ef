"""Whitening, embedding near-duplicates and collocations against brute force, and on odd tables."""

import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causalbars.llm import _hnsw, graphs, phrases, queries, whitening

SF = "/root/testdata/sf0.001"


# 11


def plain_whitening(vectors):
    """{row: (n, deviation)}, covariance and mean of the distinct integer vectors, all exact."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(r[j] for r in fit) for j in range(d)]
    cov = np.array([[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit) / n**3 for j in range(d)] for i in range(d)])
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], cov, np.array([[c - s / n for c, s in zip(r, sums)] for r in x])


def check_whitening(rows, vectors, components=16):
    n, deviations, cov, centred = plain_whitening(vectors)
    by_id = collections.defaultdict(dict)
    for r in rows:
        by_id[r["vec_id"]][r["component"]] = r
    values = np.linalg.eigvalsh(cov)[::-1][:components]
    assert sorted(by_id) == list(range(len(vectors)))
    z = np.array([[by_id[i][k + 1]["whitened"] for k in range(len(values))] for i in range(len(vectors))])
    for i, deviation in enumerate(deviations):
        for k, e in enumerate(values):
            r = by_id[i][k + 1]
            assert r["n"] == n and r["deviation"] == deviation and abs(r["explained"] / (e / np.trace(cov)) - 1) < 1e-9
            assert r["identity_error"] < 1e-9
    first = {tuple(v): i for i, v in reversed(list(enumerate(map(tuple, vectors))))}
    fit = z[sorted(first.values())]
    assert np.abs(fit.T @ fit / len(fit) - np.eye(len(values))).max() < 1e-6
    axes = centred.T @ np.linalg.pinv(z.T)  # each whitened column is a projection of the centred rows
    assert np.abs(centred @ np.linalg.lstsq(centred, z, rcond=None)[0] - z).max() < 1e-6 and axes.shape[0] == centred.shape[1]


def test_whitening_of_a_table(spark):
    table = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    vectors = [v for _, v in table]
    rows = [{**r.asDict(), "vec_id": next(iter([r["vec_id"]]))} for r in queries.op11_whitening(spark, SF).collect()]
    place = {i: at for at, (i, _) in enumerate(table)}
    for r in rows:
        r["vec_id"] = place[r["vec_id"]]
    x = np.array(vectors)
    integer = np.floor(64 * x).astype(np.int64) + 1_000_000
    if len(np.unique(integer, axis=0)) == len(x):
        check_whitening(rows, vectors)


def test_scatter_is_exact():
    rng = np.random.default_rng(0)
    for n, d, top in ((1, 1, 1), (63, 3, 2), (64, 3, 255), (65, 4, 1 << 20), (200, 2, 1 << 45), (130, 5, 1)):
        x = rng.integers(-top, top, (n, d))
        count, sums, cross = whitening.scatter(x)
        assert count == n and sums == [sum(int(v) for v in x[:, j]) for j in range(d)]
        assert cross == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(i, d)] for i in range(d)]


def test_whitening_odd_vectors(spark):
    rng = np.random.default_rng(3)
    plain = [[float(c) for c in v] for v in rng.normal(0, 2, (300, 5))]
    plain[7] = [1e-200, -0.0, 5e-324, 0.5, -3.25]
    plain += [plain[0]] * 150  # a third of all rows are one vector
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (904, []), (None, [1.0, 2.0]), (905, [1.0, 2.0]), (906, [3.0, 7.0])]
    frame = spark.createDataFrame([*enumerate(plain), *odd], "vec_id long, embedding array<double>").repartition(5).withColumns({"x": F.lit("clash"), "id": F.lit(1), "d": F.lit(2)})
    rows = whitening.whiten(frame).collect()
    assert {r["vec_id"] for r in rows} & {900, 901, 902, 903, 904} == set()
    short = [r for r in rows if r["vec_id"] is None or r["vec_id"] > 900]
    assert len(short) == 6 and {r["n"] for r in short} == {2}
    assert [r["whitened"] is None for r in sorted(short, key=lambda r: r["component"])] == [False] * 3 + [True] * 3  # one direction varies
    own = [r for r in rows if r["vec_id"] is not None and r["vec_id"] < 900]
    check_whitening(own, plain)
    assert whitening.whiten(frame.where("vec_id > 10000")).count() == 0
    single = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in single] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    with pytest.raises(Exception, match="2\\^40"):
        whitening.whiten(spark.createDataFrame([(1, [1e200])], "vec_id long, embedding array<double>")).count()


# 12


def plain_links(table, threshold=0.95):
    """{row number: (n_links, component)} by all pairs."""
    usable = [i for i, (_, v) in enumerate(table) if v and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)]
    linked = {i: set() for i in range(len(table))}
    for d in {len(table[i][1]) for i in usable}:
        own = np.array([i for i in usable if len(table[i][1]) == d])
        x = graphs.unit(np.array([table[i][1] for i in own], float))
        cosine = x @ x.T
        for a in range(len(own)):
            linked[own[a]] |= set(own[np.flatnonzero(cosine[a] >= threshold)].tolist()) - {own[a]}
    seen, found = {}, {}
    for i in range(len(table)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in linked[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        ids = [table[j][0] for j in group if table[j][0] is not None]
        for j in group:
            seen[j] = min(ids, default=None)
    for i in range(len(table)):
        found[i] = (len(linked[i]), seen[i])
    return found


def planted(rng, d=32, strangers=3000):
    """Strangers; pairs just above and below the threshold; a dense group; a chain; one vector many times."""
    x = list(rng.normal(size=(strangers, d)))

    def turned(v, cosine):
        aside = rng.normal(size=d)
        u = v / np.linalg.norm(v)
        aside -= aside @ u * u
        return (cosine * u + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)) * rng.uniform(0.1, 9)

    x += [turned(x[i], c) for i in range(300) for c in (0.951, 0.949, 0.97)]
    x += [x[500] + rng.normal(size=d) * 0.03 for _ in range(700)]
    link = x[600]
    for _ in range(40):
        link = turned(link, 0.96)
        x.append(link)
    x += [x[700]] * 500
    return [[float(c) for c in v] for v in x]


def check_links(rows, table):
    expected = plain_links(table)
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows)
    assert got == collections.Counter((i, *expected[at], i == expected[at][1]) for at, (i, _) in enumerate(table))


def test_embedding_links_equal_all_pairs(spark, monkeypatch):
    vectors = planted(np.random.default_rng(5))
    ids = np.random.default_rng(6).permutation(len(vectors)).tolist()
    table = list(zip(ids, vectors))
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(6)
    rows = graphs.near_duplicates(frame).collect()
    expected = plain_links(table)
    got = {r["vec_id"]: r for r in rows}
    total = sum(n for n, _ in expected.values())
    assert len(rows) == len(table) and 0.99 * total <= sum(r["n_links"] for r in rows) <= total
    assert sum(got[i]["component_id"] == expected[at][1] for at, i in enumerate(ids)) >= 0.99 * len(table)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_embedding_links_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    table = [(5, v), (3, v), (3, v), (None, [2.0, 4.0, 6.0]), (9, None), (8, []), (7, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0]), (2, [1e-200, 0.0, 0.0]), (1, [1e200, 1.0, 0.0]), (10, [-1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [1e-310, 0.0]), (None, [0.0, 0.0, 1.0]), (13, [float("inf"), 1.0, 1.0])]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "v": F.lit("x"), "id": F.lit(0), "least": F.lit(0)})
    check_links(graphs.near_duplicates(frame).collect(), table)
    assert graphs.near_duplicates(frame.where("vec_id > 100")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 257, 2000):
        x = graphs.unit(rng.normal(size=(n, 16))).astype(np.float32)
        ids, sims = _hnsw.Graph.build(x).search(x, 48)
        best = np.argsort(-(x @ x.T), axis=1)[:, : min(5, n)]
        assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(ids.tolist(), best.tolist())]) > 0.95
        assert all(np.allclose(x[i[i >= 0]] @ q, s[i >= 0], atol=1e-5) for i, s, q in zip(ids, sims, x))


def test_scanned_rows_and_beams_agree():
    """With every share of scanned rows the counts are those of all pairs."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 12))
    x = graphs.unit(np.concatenate([c + rng.normal(size=(k, 12)) * 0.12 for c, k in zip(centres, rng.integers(1, 60, 20))]))
    weights = rng.integers(1, 4, len(x))
    a, b = (graphs.Shard(np.arange(len(x))[h], weights[h], x[h]) for h in (slice(0, None, 2), slice(1, None, 2)))
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    counts = np.zeros(len(x), int)
    for found in (graphs.compare(a, None, 0.95), graphs.compare(b, None, 0.95), graphs.compare(a, b, 0.95)):
        counts[found[0]] += found[1]
    expected = linked @ weights
    assert (counts <= expected).all() and counts.sum() >= 0.999 * expected.sum() and (counts == expected).mean() > 0.99


# 13


def plain_collocations(rows, least, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang, tuple(words[i : i + k])] += 1
    longest = collections.Counter()
    for (lang, w), f in counts.items():
        if len(w) == 3 and f >= least:
            for part in (w[:2], w[1:]):
                longest[lang, part] = max(longest[lang, part], f)
    found = collections.defaultdict(list)
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least and not (len(w) == 2 and 100 * longest[lang, w] >= 50 * a):
            score, k = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for lang, own in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


def found_rows(frame, **options):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(frame, **options).collect()}


def test_collocations_of_odd_texts(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "The", "THE", "of", "a\x00", "a\x01", "a", "é", "漢字", "\U0001f642", "x" * 3000, "b\x01\x01", "\x00", "don't", "-", "\x1f"]
    joints = [" ", " ", " ", "  ", "\t", "\n", ". ", ",", "\x0b", "\r\n", "!", "\xa0"]
    rows = [("".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", "x\x00y", ""])) for _ in range(400)]
    rows += [(None, "en"), ("", None), ("...", "de"), (" \t ", "de")] + [("one hot text of nine words in all rows", "en")] * 200
    frame = spark.createDataFrame([(t, lang, "clash", 1) for t, lang in rows], "text string, lang string, a string, f int").repartition(7)
    for least, slice_bytes in ((2, 12 << 20), (10, 300)):
        monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
        assert found_rows(frame, least=least) == plain_collocations(rows, least)
    assert found_rows(frame, least=2, top=7) == plain_collocations(rows, 2, 7)
    assert phrases.collocations(frame.where("false")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_windows_of_many_words(monkeypatch):
    """More words than numbers: slices are halved, and one text of too many words is counted all the same."""
    texts = [f"w{i} w{i + 1} w{i} z".encode() for i in range(50)]
    key, n = phrases.windows("en", texts)
    monkeypatch.setattr(phrases, "_WORDS", 20)
    few, m = phrases.windows("en", texts)
    one, k = phrases.windows("en", [b"\n".join(texts)])
    assert key.to_pylist() == few.to_pylist() == one.to_pylist() == sorted(key.to_pylist())
    assert n.tolist() == m.tolist() == k.tolist()


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(found_rows(docs.repartition(n)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_phrase_counts_of_streams():
    """Counts of cut streams add up to plain ones, with NUL and 0x01 in words; what is frequent comes out whole."""
    rng = random.Random(5)
    words = ["a", "b", "ab", "c\x00", "\x01", "é", "z\x01\x02"]
    keys, expected = collections.Counter(), collections.Counter()
    for _ in range(3000):
        window = (rng.choice(["", "de", "en"]), *(rng.choices(words, range(7, 0, -1))[0] for _ in range(rng.choice((1, 2, 3, 3)))))
        keys[b"\x00".join(phrases._escaped(x.encode()) for x in window)] += (n := rng.randrange(1, 3))
        for depth in range(len(window)):
            expected[window[: depth + 1]] += n
    stream = sorted((k, n) for k, total in keys.items() for n in ([total] if total < 2 else [1, total - 1]))
    for size in (1, 7, 100, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["key", "n"]) for part in (stream[at : at + size] for at in range(0, len(stream), size))]
        got, found = collections.Counter(), list(phrases.counted(iter(batches), 40))
        for r in (r for batch in found for r in batch.to_pylist()):
            got[tuple(r[c] for c in ("lang", "a", "b", "c") if r[c] is not None)] += r["f"]
        assert {k: n for k, n in got.items() if n >= 40} == {k: n for k, n in expected.items() if n >= 40}
        assert len([k for k in got if got[k] < 40]) <= 8 and all(got[k] == expected[k] for k in got)
    assert list(phrases.counted(iter([]), 40)) == []


def test_rare_windows_cost_little():
    """Counting a stream of rare windows takes less CPU than splitting its keys in Python once."""
    keys = sorted(b"en\x00w%d\x00w%d\x00w%d" % (i % 997, i % 10007, i) for i in range(300_000))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[at : at + 10_000], pa.binary()), pa.array(np.ones(10_000, np.int64))], names=["key", "n"]) for at in range(0, len(keys), 10_000)]
    start = time.process_time()
    split = [k.split(b"\x00") for batch in batches for k in batch.column(0).to_pylist()]
    plain = time.process_time() - start
    start = time.process_time()
    found = sum(batch.num_rows for batch in phrases.counted(iter(batches), 1000))
    assert len(split) == 300_000 and found < 100 and time.process_time() - start < 1.5 * plain
