"""Phrase collocations from count streams in prefix and suffix order.

Each word occurrence opens one window: the word and up to two that follow it in its piece. Windows are counted a slice
of texts at a time and come out as sorted runs; the runs are dealt by ranges of the window order, so equal windows meet
in one partition, and each partition is sorted on disk where it has to be. In that order all windows of a phrase stand
together, so one pass over the stream gives the counts of words, word pairs and triples as sums of adjacent rows: no
hash table, no second shuffle of the corpus. Only a partition's first and last phrases can go on in a neighbour: their
parts are added up afterwards.

The frequent phrases are then kept in two orders, by prefix and by suffix, and sort-merge joins run through them in
lockstep: the prefix order gives a phrase the count of its first part and of its extensions to the right, the suffix
order that of its last part and of its extensions to the left. A part is at least as frequent as the phrase, so
nothing rarer than ``least`` is ever needed beyond the first pass.

Range bounds come from a bounded sample (SAMPLE_DOCS documents, SAMPLE_WINDOWS windows of each) and matter for balance
only. A phrase with very many different continuations spreads over several ranges, one with many repeats is a row a
slice.

Defined results: null texts are empty, a null language is ``und``; texts without words give nothing; rows are
counted as often as they are repeated; ids are not read, nor any column but text and language; an empty table gives
an empty table; score ties end with the phrase in UTF-8 byte order. A document's text of any length is read whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialize, ship_package

LEAST, TOP, MAJORITY = 10, 2000, 50
#: Documents, windows of each and bytes of a window that range bounds are taken from.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_BYTES = 2000, 50, 64
#: Bytes of text that are counted at once.
SLICE_BYTES = 12 << 20
#: Bits of a word's number within a slice, three to a 64-bit integer; most different words that are numbered so.
_BITS = 21
_WORDS = 1 << _BITS
#: Parts in which each language's best phrases are sought before they meet.
_RANK_PARTS = 64
#: A-Z to a-z; piece ends to line feeds; tabs to spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _escaped(word: bytes) -> bytes:
    """Words in keys hold no NUL, which ends a word and sorts below all that a word may go on with."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")


def _plain(word: bytes) -> bytes:
    return word.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01")


def windows(lang: str, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct windows of the texts in order, as keys ``lang NUL word [NUL word [NUL word]]``, and their counts."""
    data = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([data], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
    words = tokens.dictionary
    if len(words) >= _WORDS - 2 and len(texts) > 1:
        return merged(windows(lang, texts[: len(texts) // 2]), windows(lang, texts[len(texts) // 2 :]))
    order = pc.array_sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(1, len(words) + 1)
    for gone, number in ((b"", -1), (b"\n", 0)):
        if (at := words.index(gone).as_py()) >= 0:
            rank[at] = number
    w = rank[tokens.indices.to_numpy()]
    w = np.concatenate([w[w >= 0], [0, 0]])
    a, b = w[:-2], w[1:-1]
    c = np.where(b > 0, w[2:], 0)
    inside = a > 0
    a, b, c = a[inside], b[inside], c[inside]
    listed = words.take(pa.array(order))
    if any(b"\x00" in x or b"\x01" in x for x in texts):
        listed = pa.array([_escaped(x) for x in listed.to_pylist()], pa.large_binary())
    if len(words) < _WORDS - 2:
        numbers, counts = np.unique((a << 2 * _BITS) | (b << _BITS) | c, return_counts=True)
        a, b, c = (numbers >> shift & ((1 << _BITS) - 1) for shift in (2 * _BITS, _BITS, 0))
    else:  # one text with millions of different words
        numbers, counts = np.unique(np.stack([a, b, c], axis=1), axis=0, return_counts=True)
        a, b, c = numbers.T
    parts = [listed.take(pa.array(x - 1, mask=x == 0)) for x in (a, b, c)]
    head = pa.scalar(_escaped(lang.encode()), pa.large_binary())
    return pc.binary_join_element_wise(head, *parts, pa.scalar(b"\x00", pa.large_binary()), null_handling="skip"), counts


def merged(x: tuple[pa.Array, np.ndarray], y: tuple[pa.Array, np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """One run from two."""
    both = pa.table({"key": pa.concat_arrays([x[0], y[0]]), "n": np.concatenate([x[1], y[1]])}).group_by("key").aggregate([("n", "sum")]).sort_by("key")
    return both["key"].combine_chunks(), both["n_sum"].to_numpy()


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, up to SLICE_BYTES together (a longer text is alone)."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py()
            if sizes.get(lang, 0) + len(text) > SLICE_BYTES and by_lang.get(lang):
                yield lang, by_lang.pop(lang)
                sizes[lang] = 0
            by_lang.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
        yield from by_lang.items()


def _bounds(docs: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges - 1`` keys that cut the windows of a sample into like parts."""
    n = docs.count()
    if not n or ranges < 2:
        return []

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                keys = windows(lang, [text.encode()])[0]
                at = np.unique(np.linspace(0, len(keys) - 1, SAMPLE_WINDOWS).astype(int)) if len(keys) else []
                yield pa.RecordBatch.from_arrays([pa.array([keys[int(i)].as_py()[:SAMPLE_BYTES] for i in at], pa.binary())], names=["key"])

    found = sorted(r["key"] for r in docs.sample(min(1.0, SAMPLE_DOCS / n), 7).mapInArrow(some, "key binary").collect())
    return sorted({bytes(found[len(found) * i // ranges]) for i in range(1, ranges)}) if found else []


def _changes(values: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; true for the first."""
    return np.concatenate([[True], pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)


def _split(keys: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
    """Language and up to three words of each key (what is lacking: empty), and how many of them there are."""
    parts = pc.split_pattern(keys, pattern=b"\x00")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    return [pc.fill_null(parts.values.take(pa.array(offsets[:-1] + i, mask=size <= i)), b"") for i in range(4)], size


def counted(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, c, f) of the phrases of a sorted stream of windows that occur ``least`` times or more, and of each
    language (no words). The first and the last phrase of each length come out whatever their count.

    Whole columns are compared with themselves one row later; only phrases that come out are taken.
    """
    names = ["lang", "a", "b", "c", "f"]
    held: list[tuple[list[bytes], int] | None] = [None] * 4
    fresh = [True] * 4

    def text(values: pa.Array) -> pa.Array:
        if pc.any(pc.greater_equal(pc.find_substring(values, b"\x01"), 0)).as_py():
            values = pa.array([_plain(x.as_py()) for x in values], pa.binary())
        return values.cast(pa.string())

    def rows(columns: list[pa.Array], f: np.ndarray) -> pa.RecordBatch:
        columns = [text(x) for x in columns] + [pa.nulls(len(f), pa.string())] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([*columns, pa.array(f, pa.int64())], names=names)

    def one(phrase: list[bytes], n: int) -> pa.RecordBatch:
        return rows([pa.array([x], pa.binary()) for x in phrase], np.array([n]))

    for batch in batches:
        if not batch.num_rows:
            continue
        parts, size = _split(batch.column(0).cast(pa.binary()))
        count = batch.column(1).to_numpy()
        new, starts_at = np.zeros(batch.num_rows, bool), []
        for part in parts:
            new = new | _changes(part)
            starts_at.append(np.flatnonzero(new))
        for depth in (3, 2, 1, 0):
            starts = starts_at[depth]
            n, there = np.add.reduceat(count, starts), size[starts] > depth
            starts, n = starts[there], n[there]
            if not len(starts):
                continue
            first, last = ([part[int(starts[at])].as_py() for part in parts[: depth + 1]] for at in (0, -1))
            before, held[depth] = held[depth], None
            if before and before[0] == first:
                n[0] += before[1]
                before = None
            held[depth] = (last, int(n[-1]))
            keep = n[:-1] >= least
            if before:
                if before[1] >= least or fresh[depth]:
                    yield one(*before)
                fresh[depth] = False
            elif len(keep) and fresh[depth]:
                keep[0], fresh[depth] = True, False
            if keep.any():
                at = pa.array(starts[:-1][keep])
                yield rows([part.take(at) for part in parts[: depth + 1]], n[:-1][keep])
    for phrase in held:
        if phrase:
            yield one(*phrase)


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, a, b, c, f): counts of the phrases of up to three words that occur ``least`` times or more, and with
    no words at all the number of words of each language."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(texts, ranges)

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _slices(batches):
            key, n = windows(lang, own)
            part = np.zeros(len(key), np.int32)
            for bound in bounds:
                part[bisect.bisect_left(range(len(key)), bound, key=lambda i: key[i].as_py()) :] += 1
            for at in range(0, len(key), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(part[cut]), key[cut].cast(pa.binary()), pa.array(n[cut], pa.int64())], names=["part", "key", "n"])

    dealt = texts.mapInArrow(runs, "part int, key binary, n long").repartitionById(ranges, F.col("part"))
    sums = dealt.select("key", "n").sortWithinPartitions("key").mapInArrow(lambda batches: counted(batches, least), "lang string, a string, b string, c string, f long")
    whole = sums.groupBy("lang", "a", "b", "c").agg(F.sum("f").alias("f"))
    return whole.where((F.col("f") >= least) | F.col("a").isNull())


def _score(a: str, l: str, r: str) -> Column:
    big = lambda x: F.col(x).cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)"), big(l) * big(r))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, majority: int = MAJORITY, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of two or three words of each language by their lowest cut's score (see the module):
    lang, rank, phrase, a, l, r, n, score, and the words before the cut (k). Phrases that stand ``majority`` percent of
    the time inside one longer phrase are left out."""
    counts = materialize(phrase_counts(docs, least, text_col, lang_col), "phrases", "zstd")
    words = counts.where("a IS NOT NULL AND b IS NULL").select("lang", F.col("a").alias("w"), F.col("f").alias("f_w"))
    pairs = counts.where("b IS NOT NULL AND c IS NULL").select("lang", "a", "b", "f")
    triples = counts.where("c IS NOT NULL").select("lang", "a", "b", "c", "f")

    def lockstep(left: DataFrame, right: DataFrame, **on: str) -> DataFrame:
        """Both sides in one order, merged: left rows with what ``right`` says of their part (columns: on)."""
        renamed = right.withColumnsRenamed({v: f"_{v}" for v in on.values()}).withColumnRenamed("lang", "_lang")
        cond = F.col("lang") == F.col("_lang")
        for mine, theirs in on.items():
            cond = cond & (F.col(mine) == F.col(f"_{theirs}"))
        return left.join(renamed.hint("merge"), cond, "left").drop("_lang", *(f"_{v}" for v in on.values()))

    prefix = lockstep(pairs, words.withColumnRenamed("f_w", "l1"), a="w")
    two = lockstep(prefix, words.withColumnRenamed("f_w", "r1"), b="w")
    right_ext = triples.groupBy("lang", "a", "b").agg(F.max("f").alias("right_f"))
    left_ext = triples.groupBy("lang", F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("f").alias("left_f"))
    two = lockstep(lockstep(two, right_ext, a="a", b="b"), left_ext, a="a", b="b")
    longer = F.greatest(F.coalesce("right_f", F.lit(0)), F.coalesce("left_f", F.lit(0)))
    two = two.where(100 * longer < majority * F.col("f"))
    two = two.select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), F.col("f").alias("a"), F.array(F.struct(_score("f", "l1", "r1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r"))).alias("cuts"))

    three = lockstep(triples, words.withColumnRenamed("f_w", "l1"), a="w")
    three = lockstep(three, pairs.withColumnRenamed("f", "l2"), a="a", b="b")
    three = lockstep(three, pairs.withColumnRenamed("f", "r1"), b="a", c="b")
    three = lockstep(three, words.withColumnRenamed("f_w", "r2"), c="w")
    cuts = [F.struct(_score("f", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.col("f").alias("a"), F.array(*cuts).alias("cuts"))

    cut = F.array_min("cuts")  # lowest score, then smallest k
    found = two.unionByName(three).select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cut.k")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_RANK_PARTS))
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    found = found.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("a IS NULL").select("lang", F.col("f").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
