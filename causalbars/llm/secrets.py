"""Secret scans: format rules plus a token-efficiency test.

Random strings are expensive under a byte-pair vocabulary: prose costs one token for four or more
characters, keys cost one token for about one and a half. Long runs of key characters whose ratio of
characters to tokens is low are reported, after known digests (hex of a digest's length), UUIDs and
identifiers are set aside. Format matches ("base" spans) are always reported.

Defined results: a null text counts as empty; an empty text has no spans; rows are treated one by one, so
repeated rows repeat their result and null ids pass through; only the named columns are read, so extra
columns cannot clash; an empty table gives an empty table. One narrow pass: no shuffle at any size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import map_texts, replace_texts

KINDS = ("assign", "access", "hex", "random")
#: Characters a token below which a run counts as random.
MAX_CHARS_PER_TOKEN = 2.2
#: Shortest run the token test judges.
MIN_RUN = 20

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Capitals and small letters that change places too often for words in camel case.
_MIXED = re.compile(r"(?:[a-z][A-Z]{1,2}[a-z]?[A-Z]|[A-Z][a-z][A-Z][a-z]?[A-Z]).*(?:[a-z][A-Z]{1,3}[a-z]|[A-Z]{2}[a-z])")
_IDENTIFIER = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})(?:[_/=+-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))+\Z")


@lru_cache(maxsize=4)
def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def is_random(run: str, encoding) -> bool:
    """The token-efficiency test for one run of key characters.

    A run of one kind of characters only (figures, capitals or small letters) is a number or a word; a run of letters
    is judged where capitals and small letters mix within its parts.
    """
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) and not _MIXED.search(run):
        return False
    if len(run) in _DIGEST_LENGTHS and _DIGEST.match(run) or _UUID.match(run) or (_IDENTIFIER.match(run) and not _MIXED.search(run)):
        return False
    return len(run) < MAX_CHARS_PER_TOKEN * len(encoding.encode_ordinary(run))


def _long_words(text: str):
    """(start, word) of the words of MIN_RUN or more characters: all but the assign rule lie in them."""
    at = 0
    for word in text.split():
        if len(word) >= MIN_RUN:
            at = text.index(word, at)
            yield at, word
            at += len(word)


def find_secrets(text: str, encoding) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind."""
    spans = []
    lowered = text.lower()
    if any(hint in lowered for hint in _ASSIGN_HINTS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    runs = []
    for at, word in _long_words(text):
        if "AKIA" in word:
            spans += [("access", at + m.start(), at + m.end()) for m in _ACCESS.finditer(word)]
        spans += [("hex", at + m.start(), at + m.end()) for m in _HEX.finditer(word)]
        runs += [(at + m.start(), at + m.end()) for m in _RUN.finditer(word)]
    base = list(spans)
    for start, end in runs:
        if not any(s < end and start < e for _, s, e in base) and is_random(text[start:end], encoding):
            spans.append(("random", start, end))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def span_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None) -> DataFrame:
    """``keep`` columns plus n_assign, n_access, n_hex, n_random, base_sha256 and spans of each text."""
    ranks = ranks_path or default_ranks_path()

    def compute(texts: list[str]):
        encoding = _vocabulary(ranks)
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, joined = [], []
        for text in texts:
            spans = find_secrets(text, encoding)
            for kind in KINDS:
                counts[kind].append(sum(s[0] == kind for s in spans))
            base = [s for s in spans if s[0] != "random"]
            digests.append(hashlib.sha256(span_text(base).encode()).hexdigest())
            joined.append(span_text(spans))
        return [*[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests), pa.array(joined, pa.string())]

    ddl = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return map_texts(docs, text_col, keep, ddl, compute)


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", ranks_path: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each maximal span of secrets replaced by ``mask``; other texts stay as they are."""
    ranks = ranks_path or default_ranks_path()

    def rewrite(texts: list[str]) -> list[str | None]:
        encoding = _vocabulary(ranks)
        return [redact(text, find_secrets(text, encoding), mask) for text in texts]

    return replace_texts(docs, text_col, size_col, rewrite)


def redact(text: str, spans: list[tuple[str, int, int]], mask: str) -> str | None:
    """The text with overlapping spans merged and masked; None if there are none."""
    if not spans:
        return None
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
