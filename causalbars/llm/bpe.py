"""Byte-level BPE by corpus-level merge replay.

Texts are cut by the pre-tokenizer's pattern. The distinct words of a whole block of documents are laid out
as one array of byte tokens with links to their neighbours, and an inverted index from a pair's rank to the
positions where that pair stands is built once. Merges are then replayed over the block in rank order: each
rank's positions are merged together, and only the pairs that touch a merged token are looked up again and
re-indexed. A block is an Arrow batch, so blocks are encoded in parallel, nothing is shuffled and memory is
bounded by the batch; a word that other blocks share encodes to the same ids there.

Words in which a merge makes a pair of a lower or equal rank (possible only in vocabularies whose ranks are
not in the order in which tokens can be built) are encoded again one merge at a time, which keeps results
equal to one-word-at-a-time encoding for any rank file.

Defined results: a null text counts as empty and has no ids; repeated rows repeat their result; null ids pass
through; only the named columns are read; an empty table gives an empty table. Texts of any length are
encoded whole. ``decode`` restores the exact bytes of a text; ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._segments import MAX_REMEMBERED, SegmentEncoder
from ._spark import map_texts

_NONE = np.int64(1) << 40


class MergeReplay:
    """Encodes batches of distinct words by replaying all merges in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.width
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    values.append(rank)
        order = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int64)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NONE where the pair has none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. Words that are tokens themselves need no merges."""
        out: list[np.ndarray | None] = [None] * len(words)
        open_words = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = np.array([whole], np.int64)
            elif not word:
                out[i] = np.zeros(0, np.int64)
            else:
                open_words.append(i)
        if open_words:
            sizes = np.array([len(words[i]) for i in open_words])
            ends = np.cumsum(sizes)
            token, alive, odd = self._replay(np.frombuffer(b"".join([words[i] for i in open_words]), np.uint8), ends)
            kept = np.concatenate([[0], np.cumsum(alive)])
            ids = token[alive]
            for n, i in enumerate(open_words):
                out[i] = ids[kept[ends[n] - sizes[n]] : kept[ends[n]]]
            for n in odd:
                out[open_words[n]] = self.encode_word(words[open_words[n]])
        return out

    def _replay(self, data: np.ndarray, ends: np.ndarray):
        """Token of each place, whether it still starts a token, and the numbers of words to encode again."""
        n = len(data)
        token = self.byte_ids[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE)
        firsts = np.flatnonzero(after >= 0)
        rank[firsts] = self._rank(token[firsts], token[firsts + 1])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def note(places: np.ndarray) -> None:
            """Enters the places into the inverted index under their pair's rank."""
            own = rank[places]
            fine = own < _NONE
            places, own = places[fine], own[fine]
            if len(places):
                order = np.argsort(own, kind="stable")
                places, own = places[order], own[order]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist()
                for s, e, r in zip(starts, [*starts[1:], len(own)], own[starts].tolist()):
                    if r in index:
                        index[r].append(places[s:e])
                    else:
                        index[r] = [places[s:e]]
                        heapq.heappush(waiting, r)

        note(firsts)
        odd: set[int] = set()
        while waiting:
            r = heapq.heappop(waiting)
            lists = index.pop(r)
            at = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(lists) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            nxt = after[at]
            if (nxt[:-1] == at[1:]).any():  # overlapping pairs, as in "aaaa": leftmost first
                taken, used = [], -1
                for p, q in zip(at.tolist(), nxt.tolist()):
                    if p != used:
                        taken.append(p)
                        used = q
                at = np.array(taken)
                nxt = after[at]
            beyond = after[nxt]
            token[at] = r
            alive[nxt] = False
            rank[nxt] = _NONE
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            prior = before[at]
            touched = np.sort(np.concatenate([at, prior[prior >= 0]]))
            touched = touched[np.concatenate([[True], touched[1:] != touched[:-1]])]
            follow = after[touched]
            last = follow < 0
            rank[touched] = np.where(last, _NONE, self._rank(token[touched], token[np.where(last, 0, follow)]))
            back = touched[rank[touched] <= r]
            if len(back):
                odd.update(np.searchsorted(ends, back, side="right").tolist())
            note(touched)
        return token, alive, sorted(odd)

    def encode_word(self, word: bytes) -> np.ndarray:
        """One word alone: always the leftmost pair of the lowest rank."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[parts[i] + parts[i + 1]], i, 2) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or len(parts[i]) + len(parts[after[i]]) != size:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < len(parts):
                    pair = parts[p] + parts[after[p]]
                    if pair in self.ranks:
                        heapq.heappush(heap, (self.ranks[pair], p, len(pair)))
        return np.array([self.ranks[p] for p in parts if p is not None], np.int64)


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as file:
            self.replay = MergeReplay({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})
        self.decimal = [str(i) for i in range(self.replay.width)]
        self._pattern = regex.compile(pattern)
        self._segments = SegmentEncoder(self._encode_segments, at_once=AT_ONCE)
        self._words: dict[bytes, bytes] = {}

    def _encode_segments(self, segments: list[str]) -> list[bytes]:
        cut = [[s.encode()] if s.isalpha() or (s[0] == " " and s[1:].isalpha()) else [w.encode() for w in self._pattern.findall(s)] for s in segments]
        words = list(set().union(*cut).difference(self._words))
        if len(self._words) + len(words) > MAX_REMEMBERED // 2:
            self._words = {}
            words = list(set().union(*cut))
        self._words |= zip(words, (ids.astype("<u4").tobytes() for ids in self.replay.encode_words(words)))
        return [b"".join(map(self._words.__getitem__, own)) for own in cut]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self._segments.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder a worker; it keeps its vocabulary and segments from task to task."""
    return Encoder(ranks_path, pattern)


def _paths(ranks_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


#: Segments whose words are replayed together, at most: bounds the arrays of one replay.
AT_ONCE = 160_000
#: Documents of a block, at most: a whole Arrow batch.
BLOCK_ROWS = 16_384


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None) -> DataFrame:
    """``keep`` columns plus ids (array of int) of each text."""
    path, pattern = _paths(ranks_path)

    def compute(texts: list[str]):
        ids = encoder(path, pattern).encode(texts)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

    return map_texts(docs, text_col, keep, "ids array<int>", compute, BLOCK_ROWS)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None) -> DataFrame:
    """``keep`` columns plus decoded (binary) of each row's ids."""
    path, pattern = _paths(ranks_path)
    n = len(keep)
    names = [*keep, "decoded"]

    def run(batches):
        for batch in batches:
            back = [encoder(path, pattern).decode(np.array(x or [], np.int64)) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(back, pa.binary())], names=names)

    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])
    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass: ``keep`` columns plus n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = _paths(ranks_path)

    def compute(texts: list[str]):
        own = encoder(path, pattern)
        sizes, of_ids, of_bytes = [], [], []
        decimal = own.decimal.__getitem__
        for ids in own.encode(texts):
            sizes.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(decimal, ids.tolist())).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    return map_texts(docs, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", compute, BLOCK_ROWS)
