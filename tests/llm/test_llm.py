"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd tables."""

import base64
import collections
import functools
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalbars.llm import _trie, ann, bpe, chat, lines, lm, packing, pii, quality, queries, secrets, simhash
from causalbars.llm._spark import connected_components

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("spans", T.StringType())])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 977} and the rest of it." for i in range(20_000))
    rows = [(1, "same text for two of us here", "en"), (2, "same text for two of us here", "en"), (3, None, None), (4, "", "en"), (None, "no id at all but words enough", "fr"), (5, long, "en"), (6, "\n\n \t\n", "en"), (1, "same text for two of us here", "en"), (7, "é ü 漢字 🙂 \x00 x", "de"), (8, "a" * 30_000, "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y") for i, t, lang in rows], DOCS).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_odd_tables(odd, empty):
    runs = {
        "secrets": secrets.scan_secrets, "pii": pii.scan_pii, "bpe": bpe.digests, "fingerprint": simhash.components, "quality": quality.assess, "lm": lm.score, "lines": lines.report,
    }
    for name, run in runs.items():
        assert run(odd).count() == 10, name
        assert run(empty).count() == 0, name
    assert packing.best_fit_pack(odd).select("doc_id", "piece").where("piece = 0").count() == 10
    assert packing.best_fit_pack(empty).count() == 0
    for keep in (quality.keep_good, lines.drop_repeats, simhash.keep_one, secrets.redact_secrets):
        kept = keep(odd)
        assert kept.columns == odd.columns and keep(empty).count() == 0
        assert kept.count() <= 10
    assert {r["doc_id"] for r in simhash.keep_one(odd).collect()} == {1, 3, None, 5, 7, 8}


# 1


def base_secrets(text):
    kinds = [("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    found = [(k, m.start(), m.end()) for k, p, ok in kinds for m in p.finditer(text) if ok(m)]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_secrets_base_and_method(docs, texts):
    for r in secrets.scan_secrets(docs).collect():
        base = base_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(secrets.span_text(base).encode()).hexdigest()
        assert set(secrets.span_text(base).split(",")) <= set(r["spans"].split(","))
    rng = random.Random(0)
    pieces = ["secret", "TOKEN", "api_key", "pass", "word", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "abcdef0123", "zz", "\n", "é", "ſecret", "x" * 8]
    encoding = secrets._vocabulary(secrets.default_ranks_path())
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert [s for s in secrets.find_secrets(text, encoding) if s[0] != "random"] == base_secrets(text), text
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_runs = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(300)]
    found = sum(secrets.is_random(x, encoding) for x in random_runs)
    clean = ["internationalization-of-documents", "2024_quarterly_report_final_v2", "https/www/example/com/pages/2023", hashlib.md5(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000", "the_quick_brown_fox_jumps_over"]
    assert found > 290 and not any(secrets.is_random(x, encoding) for x in clean)
    only_letters = ["".join(rng.choice(letters[:52]) for _ in range(26)) for _ in range(300)]
    camel = ["getUserAccountByIdFromDatabase", "XMLHttpRequestFactoryBuilder", "myHTTPSConnectionPoolManager", "NSMutableAttributedStringKey"]
    assert sum(secrets.is_random(x, encoding) for x in only_letters) > 280 and not any(secrets.is_random(x, encoding) for x in camel)
    placed = [(" ".join(["plain words before"] * 3) + " ", x, " and words after it") for x in random_runs]
    hits = sum(("random", len(a), len(a) + len(x)) in secrets.find_secrets(a + x + b, encoding) for a, x, b in placed)
    assert hits >= 0.95 * len(placed)


def test_secrets_are_masked(spark):
    text = 'key token = "abcdef123456" and 0123456789abcdef0123456789abcdef end'
    row = secrets.redact_secrets(spark.createDataFrame([(1, text, "en", "s", len(text), "", "")], DOCS)).first()
    assert row["text"] == 'key [SECRET]" and [SECRET] end' and row["n_chars"] == len(row["text"])


# 2


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer_path())
    tokenizer.encode_special_tokens = True
    rows = packing.best_fit_pack(docs, with_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"])
    for doc, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == ids
        assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
        assert all(r["length"] == 2048 for r in own[1:])
    total, used = 0, collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= math.ceil(total / 2048) * 1.02 + 1


def test_tokenizer_shortcuts_give_the_same_ids():
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "\x85", "　", "'s", "'ll", "aaaa", "é", "ß", "漢字", "🙂", "1", "23", "²", "_", "--", "the", "Word", ",", "!!", "<|endoftext|>", "́", "\x00", "of", " \n "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    own = packing._Tokenizer(packing.default_tokenizer_path())
    assert own._quick is not None
    theirs = own._full.encode_batch(texts, add_special_tokens=False)
    ours = packing._encoder(packing.default_tokenizer_path()).encode(texts)
    assert [list(x) for x in ours] == [e.ids for e in theirs]


def test_best_two():
    stock = packing._Stock(np.array([500, 500, 700, 900]), 2048)
    assert stock.best_two(1250, 600) == (500, 700) and stock.best_two(1000, 100) == (500, 500) and stock.best_two(900, 100) is None


# 3


def test_bpe_equals_tiktoken_and_round_trips(docs, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded).collect()}
    for r in encoded.collect():
        assert r["ids"] == theirs.encode_ordinary(texts[r["doc_id"]]) and back[r["doc_id"]] == texts[r["doc_id"]].encode()
    for r in bpe.digests(docs).collect():
        ids = theirs.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    own = bpe.encoder(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    pieces = ["aaaa", "a" * 12, "é", "ß", "漢字", "🙂", "the", "XYZ", "́", "\x00", "ing", "abab", "-", "--", "²", " ", "\n"]
    odd = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000]
    assert [x.tolist() for x in own.encode(odd)] == [theirs.encode_ordinary(x) for x in odd]
    words = [w.encode() for w in odd if w][:500]
    assert all(a.tolist() == own.replay.encode_word(w).tolist() for a, w in zip(own.replay.encode_words(words), words))


def test_merges_out_of_order_fall_back():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"abcd": 299, b"cd": 302}
    replay = bpe.MergeReplay(ranks)
    words = [b"abcd", b"abcdabcd", b"xabcdx", b"bcdab"]
    import tiktoken

    theirs = tiktoken.Encoding("odd", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for word, ids in zip(words, replay.encode_words(words)):
        assert ids.tolist() == theirs.encode_ordinary(word.decode())


# 4


def plain_print(text):
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(docs, texts):
    prints = {i: plain_print(t) for i, t in texts.items()}
    expected = groups_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for r in simhash.components(docs).collect():
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == expected[r["doc_id"]]


def test_split_shards_lose_no_link(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    keys = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(120)}
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    frame = spark.createDataFrame([(k,) for k in signed], "fp long")
    whole = groups_of(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    for most in (50_000, 7):
        links = simhash.near_links(frame, max_shard=most)
        found = {r["node"]: r["component"] for r in connected_components(links).collect()}
        assert all(found.get(k, k) == whole[k] for k in signed)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1200)] + [(5000, 5000)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 1000} and found[300] == 0 and found[1199] == 1000 and 5000 not in found


# 5


def base_pii(text):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    found = []
    for kind, pattern in patterns:
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base(docs, texts):
    for r in pii.scan_pii(docs).collect():
        base = base_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii._joined(base).encode()).hexdigest()
        assert set(pii._joined(base).split(",")) <= set(r["spans"].split(","))
    rng = random.Random(2)
    pieces = ["a", "@", ".", "-", " ", "+", "(", ")", "1", "22", "255", "256", "4111 1111 1111 1111", "b.c", "é", "+1 (555) 123-4567", "0001"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == base_pii(text), text


def test_pii_trees_find_disguised_data_and_leave_the_rest(spark):
    """Planted in whole texts of the corpus: spans of the method differ from the base, with few false ones."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    trees = pii.fit(table)
    rng = random.Random(11)
    texts = [t for t in (r["text"] for r in table.limit(400).collect()) if t and not pii.candidates(t)][:200]
    forms = {"email": ["jane.doe (at) example (dot) org", "bob[at]site.co.uk", "max.roe [at] shop [dot] net"], "phone": ["(415) 555-2671", "415-555-2671", "(212) 555-0199"], "ip": ["10[.]20[.]30[.]40", "172[.]16[.]0[.]9"], "card": ["4111.1111.1111.1111"]}
    harmless = ["2023-05-17", "1.234.567", "ISBN 978-3-16-148410-0", "(at) noon. Then", "9807915762804490", "12345678", "2001/2002"]
    planted, made = set(), []
    for i, text in enumerate(texts):
        kind = rng.choice(sorted(forms))
        span = rng.choice(forms[kind] if i % 2 else harmless)
        words = text.split(" ")
        at = rng.randrange(len(words) + 1)
        before = "".join(w + " " for w in words[:at])
        made.append((before + span + " " + " ".join(words[at:])).strip(" ") if at else span + " " + text)
        if i % 2:
            planted.add((i, kind, len(before), len(before) + len(span)))
    found = pii.find_all(made, trees)
    added = {(i, *s) for i, (base, spans) in enumerate(found) for s in spans if s not in base}
    assert len(planted & added) >= 0.6 * len(planted)
    assert len(planted & added) >= 0.95 * len(added)


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, pii.N_FEATURES))
    x[:, 0] = rng.integers(0, 4, 4000)
    y = ((x[:, 3] > 0) ^ (x[:, 5] > 0.5)).astype(float)
    trees = pii.calibrate(pii.fit_trees(x[:3000], y[:3000]), x[3000:], y[3000:])
    assert ((trees.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


# 6


def test_ann_recall_and_scores(spark):
    rows = queries.op6_ann(spark, SF).collect()
    table = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"]]
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    got = collections.defaultdict(dict)
    for r in rows:
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        cosine[i] = -2
        best = ids[np.lexsort((ids, -cosine))[:5]]
        own = got[ids[i]]
        assert sorted(own) == [1, 2, 3, 4, 5]
        hits += len(set(best) & {v for v, _ in own.values()})
        total += 5
        assert all(abs(cosine[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in own.values())
    assert hits / total >= 0.9


def test_ann_odd_vectors(spark):
    rows = [(i, [1.0, float(i % 7), 0.5]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0]), (63, [1.0, float("nan"), 2.0]), (64, [1.0]), (None, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in found if r["query_id"] == 0] == [7, 14, 21, 28, 35] and {r["query_id"] for r in found} == {0, 50}
    assert ann.search(frame.where("vec_id > 59"), F.lit(True)).count() == 0


def test_ann_extreme_vectors(spark):
    """Finite vectors whose squares under- or overflow have their cosines."""
    rows = [(i, [1.0, float(i)]) for i in range(1, 20)] + [(100, [1e-200, 0.0]), (50, [1e200, 1.0]), (60, [1.0, 0.0]), (61, [0.0, 5e-324])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(50, 100, 61)).collect()}
    assert [got[50, k][0] for k in (1, 2)] == [60, 100] and [got[100, k][0] for k in (1, 2)] == [50, 60] and got[50, 1][1] == got[100, 2][1] == 1.0
    assert got[61, 1][0] == 19 and abs(got[61, 1][1] - 19 / math.hypot(1, 19)) < 1e-12 and len(got) == 15


def test_ann_repeated_ids():
    """The query's own row and its nearest vector stand there 50 times each; an id counts by its best score."""
    angles = np.array([0.0] * 50 + [0.01] * 50 + [0.02, 0.03, 0.04, 0.05, 0.9, 0.06])
    ids = np.array([0] * 50 + [1] * 50 + [2, 3, 4, 5, 6, 6])
    vectors = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    for lists, read in ((np.zeros(len(ids), np.int64), [0]), (np.arange(len(ids)) % 2, [0, 1])):
        q, v, s = ann.best_of_cell(np.array([0]), vectors[:1], [np.array(read)], ids, vectors, lists, 6)
        assert q == [0] * 6 and v == [1, 2, 3, 4, 5, 6] and np.allclose(s, np.cos([0.01, 0.02, 0.03, 0.04, 0.05, 0.06]))


# 7


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 2**60), (1000, 2**48), (5000, 5000), (3000, 2**63), (100_000, 2**40)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        coded = _trie.EliasFano(_trie.mapped(_trie.EliasFano.parts(values)))
        assert (coded.find(values) == np.arange(len(values))).all()
        asked = rng.integers(0, top, 500, dtype=np.uint64)
        at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        assert (coded.find(asked) == np.where(values[at] == asked, at, -1)).all()
    counts = rng.integers(1, 10**6, 1000)
    assert np.abs(_trie.dequantise(_trie.quantise(counts)) / counts - 1).max() < 3e-4


def test_lm_against_plain_counts(docs, texts):
    rows = {r["doc_id"]: r for r in lm.score(docs).collect()}
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    counts, pairs = collections.Counter(), collections.Counter()
    for i, w in words.items():
        if not lm.held_out(i):
            counts.update(w)
            pairs.update(zip([b"", *w[:-1]], w))
    total, distinct = sum(counts.values()), len(counts)
    p1 = lambda w: (counts[w] + 0.1) / (total + 0.1 * (distinct + 1))
    base_held = own_held = 0.0
    for i, w in words.items():
        r = rows[i]
        base = sum(math.log10(p1(x)) for x in w)
        own = sum(math.log10((pairs[u, x] + lm.MU * p1(x)) / (counts[u] + lm.MU)) for u, x in zip([b"", *w[:-1]], w))
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(counts[x] > 0 for x in w) and r["train_tokens"] == total and r["held_out"] == lm.held_out(i)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], own, rel_tol=2e-3)
        if lm.held_out(i):
            base_held, own_held = base_held + r["base_score"], own_held + r["score"]
    assert own_held > base_held


# 8


def test_chat_layouts_agree(spark):
    said = [("user", "hi # <there> \\ you"), ("assistant", "a </turn>\n### user: b")]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    messages = spark.createDataFrame([(1, [{"role": r, "content": t} for r, t in said], "extra")], "conv_id long, messages array<struct<role: string, content: string>>, note string")
    prompts = spark.createDataFrame([(1, said[0][1], said[1][1])], "conv_id long, prompt string, completion string")
    results = [chat.digests(chat.format_chat(chat.canonical_turns(x))).collect() for x in (rows, messages, prompts)]
    assert results[0] == results[1] == results[2]
    row = results[0][0]
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(said[1][1].encode()).hexdigest() and row["loss_chars"] == len(said[1][1])
    formatted = chat.format_chat(chat.canonical_turns(rows)).first()
    spans = [formatted["formatted"][s["start"] : s["end"]] for s in formatted["loss_spans"]]
    assert [re.sub(r"(?s)\\(.)", r"\1", s) for s in spans] == [said[1][1]]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, blob string"))


def test_json_records_of_mixed_layouts(spark):
    import json

    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "lang": "en"}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "response": "a", "meta": {"k": 1}}, {"question": "q", "answer": "a"}, {"unknown": 1}]
    table = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "conv_id long, record string")
    got = {r["conv_id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"] or []]) for r in chat.json_turns(table).collect()}
    assert [got[i][0] for i in range(6)] == ["messages", "conversations", "instruction_input_output", "prompt_response", "question_answer", "unknown"]
    assert all(got[i][1] == [("user", "q"), ("assistant", "a")] for i in range(5)) and got[5][1] == []


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(chat.canonical_turns(rows))).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1
    assert chat.digests(chat.format_chat(chat.canonical_turns(rows.limit(0)))).count() == 0


def test_native_plans(docs, spark):
    for df in (queries.op8_chat_format(spark, SF), lines.report(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# 9


def test_line_dedup(spark):
    base = "the committee met on tuesday to discuss the budget for the coming year and agreed on all of the points that were raised by members " * 3
    near = base.replace("tuesday", "wednesday", 1)
    texts = [(1, f"{base}\nshort line\nan entirely different sentence about gardening and birds"), (2, f"{near}\nshort line"), (3, f"  {base.upper()} !!\nnew words that no other document holds at all"), (4, "words in another order: year coming the for budget the discuss to tuesday on met committee the"), (5, base)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t), "", "") for i, t in texts], DOCS)
    removed = {r["doc_id"]: r["removed"] for r in lines.report(frame).collect()}
    assert removed == {1: "", 2: "0,1", 3: "0", 4: "", 5: "0"}
    kept = {r["doc_id"]: r for r in lines.drop_repeats(frame).collect()}
    assert set(kept) == {1, 3, 4} and kept[3]["text"] == texts[2][1].split("\n")[1] and kept[3]["n_chars"] == len(kept[3]["text"]) and kept[1]["text"] == texts[0][1]


def test_lines_belong_to_rows(spark):
    """Rows that share an id keep what stands nowhere else; copies of a row, null ids, short and blank lines."""
    shared = "a line of quite enough words that stands in two documents of this table"
    unique = "words that no other document of all of them has ever held before"
    rows = [(0, shared), (1, shared), (1, unique), (2, "gamma rays and other things of enough words\nshort one"), (2, f"{shared}\nother"), (3, "Short  one!"), (4, "again words\n\nagain words"), (5, "copy of a row\n"), (5, "copy of a row\n"), (None, shared), (None, shared), (6, ""), (6, ""), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r["doc_id"], r["text"]) for r in lines.drop_repeats(frame).collect())
    assert got == collections.Counter([(0, shared), (1, unique), rows[3], (2, "other"), (4, "again words\n"), rows[7], rows[9], rows[9], (6, ""), (6, ""), (7, None)])
    found = collections.Counter((r["doc_id"], r["n_lines"], r["removed"], r["n_removed"]) for r in lines.report(frame).collect())
    assert found == collections.Counter([(0, 1, "", 0), (1, 1, "0", 1), (1, 1, "", 0), (2, 2, "", 0), (2, 2, "0", 1), (3, 1, "0", 1), (4, 3, "2", 1), (5, 2, "", 0), (5, 2, "0", 1), (None, 1, "", 0), (None, 1, "", 0), (6, 1, "", 0), (6, 1, "", 0), (7, 0, "", 0)])


def edits_of(a, b):
    """Inserted, deleted and changed words, by the plain table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def removed_and_expected(spark, texts):
    """Documents of one line that lose it, and those that connected groups of similar lines lose (brute force)."""
    frame = spark.createDataFrame([(i, t, "en", "s", len(t), "", "") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"] for r in lines.report(frame).collect() if r["n_removed"]}
    words = [t.split() for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            longest = max(len(words[i]), len(words[j]))
            if least[i] != least[j] and 5 * abs(len(words[i]) - len(words[j])) <= longest and 5 * edits_of(words[i], words[j]) <= longest:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return got, {i for i, x in enumerate(least) if x != i}


def test_line_dedup_recall(spark):
    rng = random.Random(9)
    vocabulary = [f"w{int(1000 * rng.random() ** 3)}" for _ in range(2000)]
    texts = []
    for n in (6, 8, 10, 15, 20, 28, 40):
        for share in (0.01, 0.05, 0.1, 0.15, 0.2):
            line = rng.choices(vocabulary, k=n)
            copy = list(line)
            for at in rng.sample(range(n), max(1, int(share * n))):
                kind = rng.randrange(3)
                copy[at] = [f"{copy[at]} x{rng.randrange(99)}", "", f"y{rng.randrange(99)}"][kind]
            texts += [" ".join(line), " ".join(" ".join(copy).split())]
    rng.shuffle(texts)
    got, expected = removed_and_expected(spark, texts)
    assert len(expected) >= 25 and got == expected


def test_line_dedup_followers_of_a_stranger(spark):
    """Lines in which one word dominates, each with a near copy: they share one SimHash and are strangers."""
    texts = []
    for i in range(12):
        own = [f"v{i}x{j}" for j in range(9)]
        texts += [" ".join(["pad"] * 11 + own), " ".join(["pad"] * 11 + own[:-1] + [f"changed{i}"])]
    got, expected = removed_and_expected(spark, texts)
    assert got == expected == set(range(1, 24, 2))


def test_similarity_of_very_long_lines(spark):
    a = [chr(0x4E00 + i % 97) for i in range(20_000)]
    near, far = list(a), list(a)
    for i in range(2500):
        near[8 * i] = "x"
    for i in range(4001):
        far[i] = "x"
    frame = spark.createDataFrame([("".join(a), "".join(near), "".join(far))], "a string, near string, far string")
    assert tuple(frame.select(lines.similar("a", "near"), lines.similar("a", "far")).first()) == (True, False)


def test_exact_line_repeats_against_plain(docs, texts):
    seen, expected = {}, collections.defaultdict(set)
    for i in sorted(texts):
        for n, line in enumerate(texts[i].split("\n")):
            norm = " ".join(re.findall(r"[^\W_]+", line.lower()))
            if norm:
                if norm in seen:
                    expected[i].add(n)
                seen.setdefault(norm, (i, n))
    got = {r["doc_id"]: {int(x) for x in r["removed"].split(",") if x} for r in lines.report(docs).collect()}
    assert all(expected[i] <= got[i] for i in expected)


def test_line_dedup_against_all_pairs(docs, texts):
    """All pairs of distinct lines of the corpus by the plain table of edit distances."""
    where = collections.defaultdict(list)
    for i in sorted(texts):
        for n, line in enumerate(texts[i].split("\n")):
            norm = " ".join(re.findall(r"[^\W_]+", line.lower()))
            if norm:
                where[norm].append((i, n))
    short = [x for x in where if x.count(" ") < 4]  # exact repeats only
    norms = sorted((x for x in where if x.count(" ") >= 4), key=lambda x: x.count(" "))
    words, bags = [x.split() for x in norms], [collections.Counter(x.split()) for x in norms]
    group = list(range(len(norms)))
    for i in range(len(norms)):
        for j in range(i + 1, len(norms)):
            n = len(words[j])
            if 5 * (n - len(words[i])) > n:
                break
            if 5 * (n - (bags[i] & bags[j]).total()) <= n and 5 * edits_of(words[i], words[j]) <= n and group[i] != group[j]:
                group = [group[i] if x == group[j] else x for x in group]
    members = collections.defaultdict(list)
    for k, norm in enumerate(norms):
        members[group[k]] += where[norm]
    expected = {place for places in [*members.values(), *(where[x] for x in short)] for place in sorted(places)[1:]}
    got = {(r["doc_id"], int(x)) for r in lines.report(docs).collect() for x in r["removed"].split(",") if x}
    assert got == expected


def test_line_dedup_of_repetitive_lines(spark):
    """Lines whose word pairs repeat, and permutations of the same words one swap apart."""
    rng = random.Random(21)
    twenty = [f"w{i}" for i in range(20)]
    texts = []
    for _ in range(12):
        own = rng.sample(twenty, 20)
        at = rng.randrange(19)
        texts += [" ".join(own), " ".join([*own[:at], own[at + 1], own[at], *own[at + 2 :]])]
    for n in (5, 9, 10, 14, 15, 30):
        for word in ("a", "bb"):
            line = [word, "the"] * n
            texts += [" ".join(line[:n]), " ".join([*line[: n - 1], "end"]), " ".join(["x", *line[:n]]), " ".join(line[1 : n + 1])]
    texts = sorted(set(texts))
    got, expected = removed_and_expected(spark, texts)
    assert got == expected and len(expected) >= 24


def test_lines_that_share_a_passage(spark):
    """Lines of 72 words of which 50 are common to all, and near copies of some: few pairs of strangers are compared, and
    the result is that of all pairs."""
    rng = random.Random(33)
    passage = [f"p{i}" for i in range(50)]
    texts = []
    for i in range(60):
        line = [*(f"o{rng.randrange(3000)}" for _ in range(22)), *passage]
        texts += [" ".join(line)]
        if i % 6 == 0:
            at = rng.sample(range(72), 1 + i // 5)  # up to 12 of 14 edits
            texts += [" ".join(f"n{i}" if k in at else x for k, x in enumerate(line))]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k1 long, norm string")
    levels = lines.bucket_levels(table)
    shared = functools.reduce(DataFrame.unionByName, [lines.shared_keys(table, levels, turn) for turn in range(lines.KEY_TURNS)])
    pairs = {(r["a"], r["b"]) for r in lines.near_pairs(shared, spark.createDataFrame([], "node long, root long")).collect()}
    assert len(pairs) <= 250  # of 2415
    got, expected = removed_and_expected(spark, texts)
    assert got == expected and len(expected) == 10


def test_strangers_just_below_the_threshold(spark, monkeypatch):
    """Lines of 100 words of which 78 are common to all: sketches let nearly all pairs pass, the words' hashes do not;
    similar lines meet about once, and the result is that of all pairs."""
    rng = random.Random(34)
    passage = [f"p{i}" for i in range(78)]
    texts = []
    for i in range(50):
        line = [*(f"o{rng.randrange(9000)}" for _ in range(11)), *passage, *(f"o{rng.randrange(9000)}" for _ in range(11))]
        texts += [" ".join(line)]
        if i % 5 == 0:
            at = rng.sample(range(100), 2 + i // 5 * 2)  # up to 20 of 20 edits
            texts += [" ".join(f"n{i}" if k in at else x for k, x in enumerate(line))]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k1 long, norm string")
    levels, none = lines.bucket_levels(table), spark.createDataFrame([], "node long, root long")
    shared = functools.reduce(DataFrame.unionByName, [lines.shared_keys(table, levels, turn) for turn in range(lines.KEY_TURNS)])
    with monkeypatch.context() as patch:
        patch.setattr(type(shared), "distinct", lambda self: self)
        met = [tuple(r) for r in lines.near_pairs(shared, none).collect()]
    assert len(met) <= 1.5 * len(set(met))
    compared, keep_similar = [], lines.keep_similar
    monkeypatch.setattr(lines, "keep_similar", lambda pairs: compared.append(pairs.count()) or keep_similar(pairs))
    got, expected = removed_and_expected(spark, texts)
    assert got == expected and len(expected) == 10
    assert compared[-1] <= 50  # of 1770


def test_large_similar_groups_do_not_meet_line_by_line(spark, monkeypatch):
    """Chains leave near copies of one line in two groups: their neighbours join them before all pairs are compared."""
    rng = random.Random(35)
    line = [f"w{i}" for i in range(40)]
    copies = [" ".join(f"n{i}" if k == at else x for k, x in enumerate(line)) for i in range(60) for at in [rng.randrange(40)]]
    table = spark.createDataFrame(list(enumerate(copies)), "k1 long, norm string")
    chained, compared, keep_similar = lines.chain_pairs, [], lines.keep_similar
    monkeypatch.setattr(lines, "chain_pairs", lambda shared: chained(shared).where("a % 2 = b % 2"))
    monkeypatch.setattr(lines, "keep_similar", lambda pairs: compared.append(pairs.count()) or keep_similar(pairs))
    assert {tuple(r) for r in lines.similar_groups(table).select("k1", "group").collect()} == {(i, 0) for i in range(60)}
    assert max(compared[1:]) <= 120 and compared[-1] == 0  # of 900


def test_clashing_names_and_ids_with_two_texts(spark):
    line = "a line of quite enough words that stands in two documents of this table"
    rows = [(1, line, "a", "b", "c", "d"), (1, "another text of the same id with other words in it", "a", "b", "c", "d"), (2, line, "a", "b", "c", "d"), (3, line + "\nand one more line that only this document has", "x", "y", "z", "w"), (1, line, "a", "b", "c", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, removed string, __id string, __kept string, id string")
    kept = lines.drop_repeats(frame)
    assert kept.columns == frame.columns
    assert {(r["doc_id"], r["text"], r["removed"], r["__kept"], r["id"]) for r in kept.collect() if r["doc_id"] == 3} == {(3, "and one more line that only this document has", "x", "z", "w")}
    once = simhash.keep_one(frame)
    assert sorted(r["text"] for r in once.collect() if r["doc_id"] == 1) == sorted([rows[0][1], rows[1][1]]) and once.columns == frame.columns


def test_words_that_share_a_letter_are_still_told_apart(spark, monkeypatch):
    """With four letters only, nearly all words share one; results stay those of whole words."""
    hashed = F.xxhash64
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: hashed(*c).bitwiseAND(F.lit(3)))
    rows = [("a b c d e f g h i j", "k l m n o p q r s t"), ("a b c d e f g h i j", "a b c d e f g h i x"), ("a b c d e f g h i j", "j i h g f e d c b a"), ("a b c d e f g h i j", "a b c d x e f g h i")]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text_a string, text_b string")
    assert [r["i"] for r in lines.keep_similar(pairs).orderBy("i").collect()] == [1, 3]


def test_simhash_lanes_agree(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (5, 6, 64, 127, 128, 400, 1000)]
    rows = spark.createDataFrame([(i, 0, t, i, i) for i, t in enumerate(texts)], "id long, line_no int, norm string, k1 long, k2 long")
    words = sorted({w for t in texts for w in t.split()})
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for most in (lines.LANE_WORDS, 100):
        monkeypatch.setattr(lines, "LANE_WORDS", most)
        got = {r["id"]: r["simhash"] for r in lines.with_simhash(rows).collect()}
        for i, t in enumerate(texts):
            own = [hashes[w] & (2**64 - 1) for w in t.split()]
            assert got[i] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


# 10


def test_quality_counts(docs, texts):
    for r in quality.assess(docs).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(repeated))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(repeated) > 30 * len(words)) and not (r["base_failed"] and r["kept"])


def test_quality_verdicts_match_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.assess(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(labels[i], kept[i][0]) for i in labels if not kept[i][1]]
    assert sum(bool(q) == k for q, k in judged) / len(judged) > 0.97
    assert quality.keep_good(spark.read.parquet(f"{folder}/documents.parquet")).count() == sum(k for k, _ in kept.values())


def test_sql_of_registered_queries(spark):
    from oracle import compare

    for name, sql in queries.ORACLES.items():
        compare(spark, queries.QUERIES[name], sql, SF)
