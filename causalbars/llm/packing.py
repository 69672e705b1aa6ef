"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

A document's ids are those of the tokenizer, then one end id. Longer documents are cut into full pieces with
the shorter piece first, so each document has at most one piece that needs packing. Sequences are filled
greedily with the longest piece that fits; then the smallest piece of the sequence is taken out again if two
unpacked pieces fill the wider gap more tightly.

Only piece lengths are packed. Pieces are dealt by a hash of their document into blocks of bounded size (their
number follows the row count), each block is packed by one task, and no text or id array is shuffled. A block
leaves about one sequence partly empty, which is little beside thousands of pieces.

Defined results: a null or empty text is a document of the end id alone; repeated rows and null ids are
packed like any other row; only the named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._segments import MAX_REMEMBERED, SegmentEncoder
from ._spark import fields, ship_package

SEQUENCE = 2048
END_ID = 0
#: Documents that one task packs, on average.
BLOCK_DOCS = 8192
_TOKENIZER_ROWS = 2048


#: Words of Latin letters, after at most a space; ASCII punctuation after them is a token run of its own.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


class _Tokenizer:
    """Ids of segments by the tokenizer's file.

    Words of Latin letters take a shorter way to the same ids: their merges are replayed from the ranks that the
    file's vocabulary implies. That needs ids in the order of merges, which is checked; all else, and every
    segment if the check fails, goes through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(path)
        self._full.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        self._quick = None
        if made == sorted(made) and len(set(made)) == len(made):
            to_byte = {c: b for b, c in _byte_letters().items()}
            keys = {bytes(to_byte[c] for c in t): i for t, i in vocabulary.items() if all(c in to_byte for c in t)}
            dense = {t: i for t, i in keys.items() if len(t) == 1 or i >= made[0]}
            self._quick = tiktoken.Encoding("packing", pat_str=r"[\s\S]+", mergeable_ranks=dense, special_tokens={})
        self._parts: dict[str, bytes] = {}

    def _plain(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            ids = array("I", self._quick.encode_ordinary(part)).tobytes()
            if len(self._parts) < MAX_REMEMBERED // 2:
                self._parts[part] = ids
        return ids

    def encode(self, segments: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(segments)
        rest = []
        for i, segment in enumerate(segments):
            m = _PLAIN.fullmatch(segment) if self._quick else None
            if m is None:
                rest.append(i)
            elif m[2]:
                out[i] = self._plain(m[1]) + self._plain(m[2])
            else:
                out[i] = self._plain(segment)
        for i, e in zip(rest, self._full.encode_batch_fast([segments[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: bytes that print stand for
    themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoder(path: str) -> SegmentEncoder:
    return SegmentEncoder(_Tokenizer(path).encode)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, the first may be shorter."""
    first = n % size or min(n, size)
    return [(0, first), *((start, size) for start in range(first, n, size))]


def pieces(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``keep`` columns plus piece, start, length, ids_crc32 (and ids, if wanted) of each piece of each text."""
    path = tokenizer_path or default_tokenizer_path()
    ship_package(docs.sparkSession)
    ddl = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = T.StructType([*[docs.schema[c] for c in keep], *fields(ddl)])
    names, n = schema.fieldNames(), len(keep)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _TOKENIZER_ROWS):
                part = batch.slice(at, _TOKENIZER_ROWS)
                rows, number, start, length, crc, ids = [], [], [], [], [], []
                for row, own in enumerate(_encoder(path).encode([t or "" for t in part.column(n).to_pylist()])):
                    own = np.append(own, np.uint32(END_ID))
                    for k, (s, size) in enumerate(cut(len(own))):
                        rows.append(row)
                        number.append(k)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(own[s : s + size].astype("<u4").tobytes()))
                        if with_ids:
                            ids.append(own[s : s + size].astype(np.int32))
                made = [pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in part.columns[:n]), *made], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


class _Stock:
    """Unpacked pieces by length: indices, and the lengths in stock as the bits of one integer."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.size = size
        self.of: list[list[int]] = [[] for _ in range(size + 1)]
        for i in np.arange(len(lengths) - 1, -1, -1).tolist():
            self.of[lengths[i]].append(i)
        self.bits = sum(1 << n for n in range(1, size + 1) if self.of[n])
        self.mirror = sum(1 << (size - n) for n in range(1, size + 1) if self.of[n])

    def longest(self, room: int) -> int:
        """The greatest length in stock of at most ``room``, or 0."""
        return max((self.bits & ((2 << room) - 1)).bit_length() - 1, 0) if room > 0 else 0

    def take(self, length: int) -> int:
        own = self.of[length]
        i = own.pop()
        if not own:
            self.bits ^= 1 << length
            self.mirror ^= 1 << (self.size - length)
        return i

    def put(self, length: int, i: int) -> None:
        if not self.of[length]:
            self.bits |= 1 << length
            self.mirror |= 1 << (self.size - length)
        self.of[length].append(i)

    def best_two(self, room: int, least: int) -> tuple[int, int] | None:
        """Two lengths in stock whose sum is greatest, at most ``room`` and over ``least``."""
        for total in range(room, least, -1):
            shift = self.size - total
            both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
            while both:
                low = (both & -both).bit_length() - 1
                if 2 * low != total or len(self.of[low]) > 1:
                    return low, total - low
                both &= both - 1
        return None


def pack(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; sequences are numbered from 0 and filled without gaps."""
    stock = _Stock(lengths, size)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while stock.bits:
        room, chosen = size, []
        while (n := stock.longest(room)) > 0:
            chosen.append((n, stock.take(n)))
            room -= n
        if room and len(chosen) > 1:
            n, i = chosen[-1]  # filled longest first, so the last one is the smallest
            two = stock.best_two(room + n, n)
            if two:
                chosen[-1:] = [(two[0], stock.take(two[0])), (two[1], stock.take(two[1]))]
                stock.put(n, i)
        at = 0
        for n, i in chosen:
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def best_fit_pack(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents plus sequence_id and offset (where the piece lies in its sequence)."""
    found = pieces(docs, text_col, keep, tokenizer_path, with_ids)
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    key = F.pmod(F.xxhash64(*[F.col(c) for c in keep], "piece", "length", "ids_crc32"), F.lit(blocks)).cast("int")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "ascending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        sequence, offset = pack(group.column("length").to_numpy())
        sequence += group.column("__block").to_numpy().astype(np.int64) << 32
        group = group.drop_columns(["__block"])
        return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = T.StructType([*found.schema.fields, *fields("sequence_id long, offset long")])
    return found.withColumn("__block", key).groupBy("__block").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each full sequence; ``packed`` is made with ``with_ids=True``."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
