"""Cutting texts where the byte-level pre-tokenizer always cuts, and remembering what the pieces encode to."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Characters with the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
#: White space and the word after it. The pre-tokenizer's pattern never matches across the start of white space
#: that follows other characters, and looks no further than the next word, so segments encode independently.
SEGMENT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_RUN_OF_WHITE_SPACE = re.compile(f"[{WHITE_SPACE}]{{2}}")
#: Segments that a worker remembers before it starts over; bounds its memory.
MAX_REMEMBERED = 600_000
#: Longer segments are encoded but not remembered.
MAX_LENGTH = 200


def segments(text: str) -> list[str]:
    """The segments of a text in order; those that a single space starts come without it,
    others come after a "\\0".

    Texts without runs of white space (nearly all) can be cut at each line feed and space by plain splits.
    """
    if _RUN_OF_WHITE_SPACE.search(text) or text[:1] in " \n\0" or "\0" in text:
        return ["\0" + s for s in SEGMENT.findall(text)]
    first, *lines = text.split("\n")
    cut = first.split(" ")
    cut[0] = "\0" + cut[0]
    for line in lines:
        words = line.split(" ")
        words[0] = "\0\n" + words[0]
        cut += words
    return cut


class SegmentEncoder:
    """Encodes texts by encoding each distinct segment once.

    ``encode`` gives the ids of segments as little-endian 32-bit integers; it gets ``at_once`` segments at most.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], at_once: int = 1 << 15):
        self._encode = encode
        self._at_once = at_once
        self._known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        cut = [segments(text) if text else [] for text in texts]
        new = list(set().union(*cut).difference(self._known))
        if len(self._known) + len(new) > MAX_REMEMBERED:
            self._known = {}
            new = list(set().union(*cut))
        long = {}
        for at in range(0, len(new), self._at_once):
            part = new[at : at + self._at_once]
            for key, ids in zip(part, self._encode([k[1:] if k[:1] == "\0" else " " + k for k in part])):
                (self._known if len(key) <= MAX_LENGTH else long)[key] = ids
        if long:
            found = [b"".join([self._known.get(s) or long[s] for s in own]) for own in cut]
        else:
            found = [b"".join(map(self._known.__getitem__, own)) for own in cut]
        if len(self._known) > MAX_REMEMBERED:
            self._known = {}
        return [np.frombuffer(x, "<u4") for x in found]
