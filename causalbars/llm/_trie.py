"""A two-level n-gram trie in Elias-Fano form, memory-mapped, with vectorised look-ups."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_U = np.uint64
#: Bits of a successor's number within its context.
SUCCESSOR_BITS = 40
#: Steps of a quantised logarithm for each doubling.
QUANTUM = 2048


def quantise(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts as uint16; 0 is kept for "never seen"."""
    return np.where(counts > 0, 1 + np.rint(np.log2(np.maximum(counts, 1)) * QUANTUM), 0).clip(0, 65535).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((codes.astype(float) - 1) / QUANTUM), 0.0)


class EliasFano:
    """A non-decreasing sequence of uint64: packed low bits, unary high bits, one rank entry a word."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits, self.buckets = (int(x) for x in parts["head"])
        self.low, self.high, self.zeros = parts["low"], parts["high"], parts["zeros"]

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(56, max(0, ((top + 1) // max(n, 1)).bit_length() - 1))
        packed = np.zeros((n * low_bits + 7) // 8 + 8, np.uint8)
        for at in range(0, n, 1 << 16):  # 2**16 values fill whole bytes
            lows = values[at : at + (1 << 16)] & _U((1 << low_bits) - 1)
            if low_bits:
                bits = np.unpackbits(lows.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low_bits]
                part = np.packbits(bits.ravel(), bitorder="little")
                packed[at * low_bits // 8 : at * low_bits // 8 + len(part)] = part
        highs = (values >> _U(low_bits)).astype(np.int64)
        buckets = int(highs[-1]) + 1 if n else 0
        words = (n + buckets) // 64 + 1
        flags = np.zeros(words * 64, np.uint8)
        flags[highs + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))[:-1]])
        return {"head": np.array([n, low_bits, buckets], np.int64), "low": packed, "high": high, "zeros": zeros.astype(np.uint32 if n < 1 << 31 else np.int64)}

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        byte = bit >> 3
        whole = np.zeros(len(at), np.uint64)
        for j in range(8):
            whole |= self.low[byte + j].astype(np.uint64) << _U(8 * j)
        return (whole >> (bit & 7).astype(np.uint64)) & _U((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of zero number k in the unary part."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left = k - self.zeros[word].astype(np.int64)
        bits, place = ~self.high[word], word.astype(np.int64) * 64
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & _U((1 << width) - 1)).astype(np.int64)
            go = left >= count
            left = np.where(go, left - count, left)
            bits = np.where(go, bits >> _U(width), bits)
            place += np.where(go, width, 0)
        return place

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, or -1: the successor search within its bucket of high bits."""
        out = np.full(len(values), -1, np.int64)
        high = (values >> _U(self.low_bits)).astype(np.int64)
        fine = np.flatnonzero(high < self.buckets)
        if not len(fine):
            return out
        high, low = high[fine], values[fine] & _U((1 << self.low_bits) - 1)
        first = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        last = self._zero(high) - high
        end = last.copy()
        while (open_ := np.flatnonzero(first < last)).size:
            middle = (first[open_] + last[open_]) >> 1
            below = self._lows(middle) < low[open_]
            first[open_[below]] = middle[below] + 1
            last[open_[~below]] = middle[~below]
        hit = np.flatnonzero(first < end)
        hit = hit[self._lows(first[hit]) == low[hit]]
        out[fine[hit]] = first[hit]
        return out


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays as read-only views of one memory-mapped file, which goes when nothing refers to it."""
    handle, path = tempfile.mkstemp(prefix="causalbars-trie-")
    try:
        places, at = {}, 0
        with os.fdopen(handle, "wb") as file:
            for name, array in arrays.items():
                at += file.write(b"\0" * (-at % 8))
                places[name] = at
                at += file.write(np.ascontiguousarray(array).tobytes())
            at += file.write(b"\0" * 8)
        whole = np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)
    return {k: whole[places[k] : places[k] + a.nbytes].view(a.dtype) for k, a in arrays.items()}


class Trie:
    """Contexts, pointers to their successors, and a quantised weight for each (context, successor).

    Successors are stored relative to their context: entry (rank of context, successor) is one number of a
    monotone sequence, so one search finds a pair.
    """

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray):
        """Distinct pairs in order of context, then successor (below 2 ** SUCCESSOR_BITS)."""
        own, starts = np.unique(contexts, return_index=True)
        ranks = np.repeat(np.arange(len(own), dtype=np.uint64), np.diff(np.append(starts, len(contexts))))
        chained = (ranks << _U(SUCCESSOR_BITS)) | successors
        levels = {f"context_{k}": v for k, v in EliasFano.parts(own).items()} | {f"pair_{k}": v for k, v in EliasFano.parts(chained).items()}
        levels["weight"] = quantise(counts)
        levels = mapped(levels)
        self.contexts = EliasFano({k[8:]: v for k, v in levels.items() if k.startswith("context_")})
        self.pairs = EliasFano({k[5:]: v for k, v in levels.items() if k.startswith("pair_")})
        self.weight = levels["weight"]

    def weights(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Quantised weights of pairs; 0 if never seen."""
        out = np.zeros(len(contexts), np.uint16)
        own, inverse = np.unique(contexts, return_inverse=True)
        rank = self.contexts.find(own)[inverse]
        known = np.flatnonzero(rank >= 0)
        at = self.pairs.find((rank[known].astype(np.uint64) << _U(SUCCESSOR_BITS)) | successors[known])
        seen = at >= 0
        out[known[seen]] = self.weight[at[seen]]
        return out
