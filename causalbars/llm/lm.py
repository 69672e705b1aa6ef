"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is a bigram model over words with an end token, smoothed towards additive unigrams:
p(w | u) = (c(uw) + MU p1(w)) / (c(u) + MU) with p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Counts come from
every training document; nothing is pruned or capped, so the model grows with the corpus and is never held by
one machine. Instead of sending the model to the texts, each block of texts (an Arrow batch) asks for the words
and word pairs it holds:

1. Map: a block sends each shard its distinct words and pairs, with how often its training documents hold them.
2. Shard: a task adds up what all blocks sent, builds its trie (Elias-Fano contexts and successors, quantised
   logarithms of pair counts, i.e. of smoothed joint probabilities up to N, in a memory-mapped file), and answers
   every block.
3. Score: a block's documents (as numbers of its words) meet its answers and are scored.

Shuffles carry a block's distinct words and pairs, not its tokens. Words and pairs go to shards by hash; the
successors of one context are spread over ``FAN`` shards, so a very common context is no hot shard, and copies
are added up before they travel. Blocks are named by a hash of their contents, so a recomputed block meets its
own answers and no other's.

Defined results: a null or empty text is one end token; ids may be null (their documents train if crc32 of ""
says so) or repeated; only the named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import fields, materialize, ship_package
from ._trie import SUCCESSOR_BITS, Trie, dequantise

#: Pseudo-count of the unigram distribution in each context.
MU = 60.0
ADD = 0.1
#: Shards over which the successors of one context are spread.
FAN = 16
#: Documents a shard, on average.
SHARD_DOCS = 4096
_CONTEXT_MASK = np.uint64((1 << 48) - 1)
_SUCCESSOR_MASK = np.uint64((1 << SUCCESSOR_BITS) - 1)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Block:
    """The tokens of some documents as numbers of the block's words, which are in order of (shard, hash)."""

    def __init__(self, texts: list[str], train: np.ndarray, shards: int):
        import xxhash

        numbers: dict[bytes, int] = {b"": 0}  # no word is empty: this is the end token
        found = []
        for text in texts:
            words = text.encode().lower().split()
            own = np.empty(len(words) + 1, np.int32)
            own[:-1] = [numbers.setdefault(w, len(numbers)) for w in words]
            own[-1] = 0
            found.append(own)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashes, shard))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.tokens = place[np.concatenate(found)] if found else np.zeros(0, np.int32)
        self.end = int(place[0])
        self.hashes, self.shard = hashes[order], shard[order]
        self.train = np.repeat(train, self.sizes)

    def name(self, ids: list) -> int:
        import xxhash

        digest = xxhash.xxh64(self.tokens.tobytes())
        digest.update(self.sizes.tobytes())
        digest.update(self.hashes.tobytes())
        digest.update(repr(ids).encode())
        return digest.intdigest() - (1 << 63)


def pair_keys(tokens: np.ndarray, sizes: np.ndarray, end: int, width: int) -> np.ndarray:
    """context * width + word of each token; the first word of a document follows an end token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before.astype(np.int64) * width + tokens


def pair_shards(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """Shards of pairs from the shards of their words."""
    return (context + (word % FAN) * max(1, shards // FAN)) % shards


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them all; the first byte says how many."""
    size = next(s for s in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * s))
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _wide(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = data[at]
    return np.frombuffer(data, f"<u{size}", n, at + 1).astype(np.int64), at + 1 + n * size


def _cut(values: np.ndarray, size: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _uncut(data: bytes, at: int, n: int, size: int) -> tuple[np.ndarray, int]:
    full = np.zeros((n, 8), np.uint8)
    full[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    return full.view("<u8").ravel(), at + n * size


def requests(block: Block, shards: int):
    """(shard, words, pairs) as bytes for each shard that the block needs."""
    width = len(block.hashes)
    counts = np.bincount(block.tokens, weights=block.train, minlength=width).astype(np.int64)
    keys, inverse = np.unique(pair_keys(block.tokens, block.sizes, block.end, width), return_inverse=True)
    pair_counts = np.bincount(inverse, weights=block.train, minlength=len(keys)).astype(np.int64)
    context, word = keys // width, keys % width
    where = pair_shards(block.shard[context], block.shard[word], shards)
    order = np.argsort(where, kind="stable")
    context, word, pair_counts = context[order], word[order], pair_counts[order]
    word_ends = np.searchsorted(block.shard, np.arange(shards + 1))
    pair_ends = np.searchsorted(where[order], np.arange(shards + 1))
    for s in range(shards):
        a, b = word_ends[s : s + 2]
        words = _narrow(counts[a:b]) + block.hashes[a:b].astype("<u8").tobytes() if b > a else None
        c, d = pair_ends[s : s + 2]
        pairs = None
        if d > c:
            own, runs = np.unique(context[c:d], return_counts=True)
            pairs = len(own).to_bytes(8, "little") + _narrow(runs) + _cut(block.hashes[own] & _CONTEXT_MASK, 6) + _narrow(pair_counts[c:d]) + _cut(block.hashes[word[c:d]] & _SUCCESSOR_MASK, 5)
        if words or pairs:
            yield s, int(b - a), words, int(d - c), pairs


def _read_words(data: bytes, n: int):
    counts, at = _wide(data, 0, n)
    return np.frombuffer(data, "<u8", n, at), counts


def _read_pairs(data: bytes, n: int):
    contexts = int.from_bytes(data[:8], "little")
    runs, at = _wide(data, 8, contexts)
    own, at = _uncut(data, at, contexts, 6)
    counts, at = _wide(data, at, n)
    successors, _ = _uncut(data, at, n, 5)
    return np.repeat(own, runs), successors, counts


def answer(asked: list[tuple[int, bytes | None, int, bytes | None]]):
    """What one shard answers: (word counts, pair weights) of each request, then tokens and distinct words."""
    words = [_read_words(w, n) if w else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for n, w, _, _ in asked]
    every = np.concatenate([h for h, _ in words])
    own, inverse = np.unique(every, return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([c for _, c in words]).astype(float), minlength=len(own)).astype(np.int64)
    told_words = np.split(counts[inverse], np.cumsum([len(h) for h, _ in words])[:-1])
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    pairs = [_read_pairs(p, n) if p else none for _, _, n, p in asked]
    context, successor, times = (np.concatenate([p[i] for p in pairs]) for i in range(3))
    seen = times > 0
    order = np.lexsort((successor[seen], context[seen]))
    context, successor, times = context[seen][order], successor[seen][order], times[seen][order]
    if len(context):
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])])
        starts = np.flatnonzero(new)
        trie = Trie(context[starts], successor[starts], np.add.reduceat(times, starts))
        del context, successor, times, order
        told_pairs = [trie.weights(c, s) for c, s, _ in pairs]
    else:
        told_pairs = [np.zeros(len(c), np.uint16) for c, _, _ in pairs]
    return told_words, told_pairs, int(counts.sum()), int((counts > 0).sum())


def score_block(tokens, sizes, end, counts, word_shard, weights, total: int, distinct: int, shards: int):
    """n_known, base_score and score of each document of a block."""
    width = len(counts)
    p1 = (counts + ADD) / (total + ADD * (distinct + 1))
    base = np.log10(p1)
    keys, inverse = np.unique(pair_keys(tokens, sizes, end, width), return_inverse=True)
    context, word = keys // width, keys % width
    order = np.argsort(pair_shards(word_shard[context], word_shard[word], shards), kind="stable")
    together = np.empty(len(keys))
    together[order] = dequantise(weights)
    logs = np.log10((together + MU * p1[word]) / (counts[context] + MU))
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts), np.add.reduceat(base[tokens], starts), np.add.reduceat(logs[inverse], starts)


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    ship_package(spark)
    shards = max(16, -(-docs.count() // SHARD_DOCS))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = T.ArrayType(source.schema["id"].dataType)

    def blocks(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_pylist()
                train = np.array([not held_out(i) for i in ids])
                block = Block([t or "" for t in batch.column(1).to_pylist()], train, shards)
                yield block, block.name(ids), batch.column(0)

    def ask(batches):
        for block, name, _ in blocks(batches):
            rows = [[], [], [], [], []]
            for row in requests(block, shards):
                for column, value in zip(rows, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0]), pa.int64()), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=["block", "shard", "n_words", "words", "n_pairs", "pairs"])

    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        shard = table.column("shard")[0].as_py()
        asked = list(zip(*(table.column(c).to_pylist() for c in ("n_words", "words", "n_pairs", "pairs"))))
        words, pairs, total, distinct = answer(asked)
        names = [*table.column("block").to_pylist(), None]
        told = [*(_narrow(w) for w in words), None]
        return pa.table({
            "block": pa.array(names, pa.int64()), "shard": pa.array([shard] * len(names), pa.int64()), "n_words": pa.array([*(len(w) for w in words), total], pa.int64()),
            "words": pa.array(told, pa.binary()), "n_pairs": pa.array([*(len(p) for p in pairs), distinct], pa.int64()), "pairs": pa.array([*(p.astype("<u2").tobytes() for p in pairs), None], pa.binary()),
        })

    asked = source.mapInArrow(ask, T.StructType(fields("block long, shard long, n_words long, words binary, n_pairs long, pairs binary")))
    told = materialize(asked.groupBy("shard").applyInArrow(reply, asked.schema), "answers")
    sums = told.where("block IS NULL").agg(F.sum("n_words"), F.sum("n_pairs")).first()
    total, distinct = (int(x or 0) for x in sums)

    def tell(batches):
        import zstandard

        for block, name, ids in blocks(batches):
            data = zstandard.compress(block.end.to_bytes(8, "little") + block.sizes.astype("<i8").tobytes() + block.tokens.astype("<i4").tobytes(), 3)
            offsets = pa.array([0, len(ids)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([-1], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary()), pa.array([0], pa.int64()), pa.array([None], pa.binary()), pa.ListArray.from_arrays(offsets, ids)], names=["block", "shard", "n_words", "words", "n_pairs", "pairs", "ids"])

    with_ids = T.StructType([*asked.schema.fields, T.StructField("ids", id_type)])
    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *fields("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")])

    def finish(table: pa.Table) -> pa.Table:
        import zstandard

        table = table.sort_by("shard")
        shard = table.column("shard").to_pylist()
        texts = [i for i, s in enumerate(shard) if s < 0]
        answers = {s: i for i, s in enumerate(shard) if s >= 0}  # repeated blocks have equal answers
        n_words, words, pairs = table.column("n_words").to_pylist(), table.column("words"), table.column("pairs")
        made = []
        for t in texts:
            if not answers:
                raise RuntimeError("a block has no answers: the input gave other batches when it was read again")
            found = [(s, n_words[i], i) for s, i in sorted(answers.items())]
            counts = np.concatenate([_wide(words[i].as_py(), 0, n)[0] for _, n, i in found])
            word_shard = np.repeat([s for s, _, _ in found], [n for _, n, _ in found])
            weights = np.concatenate([np.frombuffer(pairs[i].as_py(), "<u2") for _, _, i in found])
            data = zstandard.decompress(words[t].as_py())
            n = n_words[t]
            end = int.from_bytes(data[:8], "little")
            sizes = np.frombuffer(data, "<i8", n, 8)
            tokens = np.frombuffer(data, "<i4", -1, 8 + 8 * n)
            known, base, logs = score_block(tokens, sizes, end, counts, word_shard, weights, total, distinct, shards)
            ids = table.column("ids")[t].values
            held = pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_())
            made.append(pa.Table.from_arrays([ids, held, pa.array(sizes), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(logs)], names=out.fieldNames()))
        return pa.concat_tables(made) if made else pa.Table.from_pylist([], pa.schema([(id_col, table.schema.field("ids").type.value_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    answers = told.where("block IS NOT NULL").withColumn("ids", F.lit(None).cast(id_type))
    return source.mapInArrow(tell, with_ids).union(answers).groupBy("block").applyInArrow(finish, out)
