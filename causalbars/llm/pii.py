"""Personal data: candidate spans, gradient-boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans (plain and disguised e-mail addresses, dotted and defanged quads,
long digit groups, phone-like groups). Spans that satisfy a kind's exact format ("base" spans) are always reported.
The others are judged by boosted trees over format and context features. Only such others are in the training set,
which is a bounded, documented sample: positives are the corpus's own base spans, rewritten where they stand into
forms that miss the exact format (spelt-out signs, odd or dropped separators, no plus sign, defanged dots);
negatives are candidates that a validator refutes (wrong checksum, parts over 255, digits inside longer words) and
decoys put in the same places (dates, amounts, item numbers, plain words around "(at)"). Candidates that are neither
stay unlabelled. A held-out part of the sample calibrates scores (Platt) and picks each kind's threshold for the
wanted precision over what no validator refutes; a kind with few held-out positives takes the threshold of all kinds together.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows repeat their result;
null ids pass through; only the named columns are read; an empty table gives an empty table. One narrow pass
finds the sample (different candidates only are shuffled), one narrow pass reports: no shuffle of texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_texts, materialize

KINDS = ("email", "ip", "card", "phone")
#: Most candidates that the trees are fitted on (the lowest hashes of all different candidates).
SAMPLE_CANDIDATES = 20_000
#: Precision that a kind's threshold must reach on the held-out part, and positives that it needs for its own one.
WANTED_PRECISION, OWN_POSITIVES = 0.98, 20

_ANY = re.compile(r"[0-9@]|[(\[]\x20?at\x20?[)\]]", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT, _DOT = r"(?:[(\[]\x20?(?:at|AT)\x20?[)\]]|@)", r"(?:[(\[]\x20?(?:dot|DOT)\x20?[)\]]|\.)"
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?" + _AT + r"\x20?[A-Za-z0-9-]{1,63}(?:\x20?" + _DOT + r"\x20?[A-Za-z0-9-]{1,63}){1,8}")
_LOOSE_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])")
_LOOSE_DIGITS = re.compile(r"[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}")
_WORDS_NEAR = re.compile(r"phone|tel|call|fax|mobile|mail|contact|card|visa|credit|pay|host|server|addr|login", re.I)


def luhn(number: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def _quads(text: str) -> list[tuple[int, int]]:
    """Leftmost dotted quads; they can only start where a run of digits does."""
    found, last = [], 0
    for run in _DIGITS.finditer(text):
        if run.start() >= last and (m := _QUAD.match(text, run.start())):
            found.append((m.start(), m.end()))
            last = m.end()
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that satisfy the exact formats, by start, then kind."""
    spans = []
    if "@" in text:
        spans += [("email", s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        spans += [("ip", s, e) for s, e in _quads(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in text[s:e].split("."))]
        for m in _CARD.finditer(text):
            number = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(number) <= 19 and luhn(number):
                spans.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals; they may overlap."""
    if not _ANY.search(text):
        return []
    spans = set()
    if "@" in text or "(" in text or "[" in text:
        spans |= {("email", m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)}
    spans |= {("ip", s, e) for s, e in _quads(text)} | {("ip", m.start(), m.end()) for m in _LOOSE_QUAD.finditer(text)}
    for m in _LOOSE_DIGITS.finditer(text):
        n = sum(c.isdigit() for c in m.group())
        start = m.start() - (m.start() > 0 and text[m.start() - 1] == "+")
        if n <= 15:
            spans.add(("phone", start, m.end()))
        if 12 <= n <= 19:
            spans.add(("card", m.start(), m.end()))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    span = text[start:end].lstrip("+")
    groups = _DIGITS.findall(span)
    before, after = text[max(0, start - 32) : start], text[end : end + 12]
    number = "".join(groups)
    labels = re.split(r"\x20?(?:\.|[(\[]\x20?(?:dot|DOT)\x20?[)\]])\x20?", span)
    last = labels[-1]
    return [
        KINDS.index(kind), len(span), len(number), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, len({*number}), len(number) / max(1, len(span)),
        span.count("."), span.count("-"), span.count(" "), span.count("("), span.count("@"), sum(c.isalpha() for c in span),
        before[-1:].isalnum(), before[-1:] in "=:\"'", after[:1].isalnum(), before[-2:-1] in ".!?", bool(_WORDS_NEAR.search(before)),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        len(labels), len(last), last.islower() and last.isalpha(), span.count("["), span.count("/"), luhn(number) if 12 <= len(number) <= 19 else -1,
        max((int(g[-4:]) for g in groups), default=0), bool(re.match(r"(?:19|20)[0-9]{2}[-./]", span)), (groups[0][:1] if groups else "") == "0",
    ]


N_FEATURES = 32


def disguises(kind: str, span: str) -> list[str]:
    """Forms of a base span that miss the exact format."""
    if kind == "email":
        local, _, domain = span.partition("@")
        plain = re.sub(r"[0-9]+", "", local).strip(".") or local, re.sub(r"[0-9]+", "", domain)
        made = []
        for own, host in ((local, domain), plain):
            made += [f"{own} (at) {host}", f"{own}[at]{host}", f"{own} [at] " + host.replace(".", " [dot] "), f"{own}(at)" + host.replace(".", "(dot)"), f"{own} @ {host}", f"{own} (at) " + host.replace(".", " (dot) ")]
        return made
    groups = _DIGITS.findall(span)
    number = "".join(groups)
    if kind == "ip":
        return [d.join(groups) for d in ("[.]", "(.)", "[dot]", " . ")]
    if kind == "card":
        four = [number[i : i + 4] for i in range(0, len(number), 4)]
        return [d.join(four) for d in (".", "  ", " - ", "/")]
    own = number[-10:]
    a, b, c = own[:-7], own[-7:-4], own[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{number[:-10]} {a} {b} {c}", f"{number[:-10]}-{a}-{b}-{c}", f"{a} {b} {c}", f"{a}/{b}-{c}"]


def decoys(kind: str, seed: int, words: list[str], span: str) -> list[str]:
    """Harmless texts that the generators propose as this kind."""
    n = f"{seed % 10**8:08d}"
    if kind == "email":
        w = [words[(seed >> i) % len(words)] if words else "word" for i in (0, 3, 6)]
        return [f"{w[0]} (at) {w[1]}. {w[2].capitalize()}", f"{w[0]} @ {w[1]}. {w[2]}", f"{w[0]} (at) {w[1]}.{w[2].capitalize()}", f"{w[0]} @ {n[:2]}.{n[2:4]}"]
    if kind == "ip":
        parts = span.split(".")
        parts[seed % len(parts)] = str(256 + seed % 700)
        return [d.join(parts) for d in ("[.]", "(.)", "[dot]", " . ")]
    if kind == "card":
        return [f"{n[:4]}.{n[4:]}.{n[:4]}.{n[2:6]}", f"{n}  {n[::-1]}", f"{n[:6]}/{n}"]
    return [f"20{n[:2]}-{1 + seed % 12:02d}-{10 + seed % 18}", f"{10 + seed % 18}.{1 + seed % 12:02d}.19{n[:2]}", f"{n}", f"{n[:2]}.{n[2:5]}.{n[5:]}", f"20{n[:2]}/20{n[2:4]}", f"978-{n[0]}-{n[1:3]}-{n[2:8]}-{n[7]}", f"20{n[:2]}-{1 + seed % 12:02d}-{10 + seed % 18} {10 + seed % 13}"]


def refuted(kind: str, text: str, start: int, end: int) -> bool:
    """A validator rules the candidate out."""
    span = text[start:end]
    number = "".join(_DIGITS.findall(span))
    if kind != "email" and (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()):
        return True
    if kind == "card":
        return not luhn(number)
    return kind == "ip" and any(int(g[-4:]) > 255 for g in _DIGITS.findall(span))


def examples(text: str) -> list[tuple[str, list[float], bool, bool]]:
    """Training examples (a key, features, personal, refuted) of one text: no candidate that meets the exact format."""
    found = candidates(text)
    if not found:
        return []
    base, made = base_spans(text), []
    for kind, s, e in found:
        if not any(s < b and a < e for _, a, b in base) and refuted(kind, text, s, e):
            made.append((text[max(0, s - 8) : e + 8], describe(text, kind, s, e), False, True))
    for kind, s, e in base:
        left, right = text[max(0, s - 40) : s], text[e : e + 20]
        seed = zlib.crc32(text[max(0, s - 40) : e].encode())
        words = re.findall(r"[A-Za-z]{2,}", left)
        for personal, forms in ((True, disguises(kind, text[s:e])), (False, decoys(kind, seed, words, text[s:e]))):
            form = forms[seed % len(forms)]
            placed, a, b = left + form + right, len(left), len(left) + len(form)
            if (kind, a, b) in candidates(placed) and not any(x < b and a < y for _, x, y in base_spans(placed)):
                out = refuted(kind, placed, a, b)
                if personal or out or kind != "card":  # a decoy with a card's checksum is no decoy
                    made.append((form, describe(placed, kind, a, b), personal, out))
    return made


@dataclass
class Trees:
    """Boosted depth-limited trees as flat arrays (trees x nodes), with calibration."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (0.5,) * len(KINDS)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            total += self.value[t, node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.margin(x) + self.scale[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Second-order boosting of logistic loss; splits at quantiles of each feature."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16))) for f in range(x.shape[1])]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    nodes, leaves = 2**depth - 1, 2 ** (depth + 1) - 1
    trees = Trees(np.zeros((n_trees, nodes), np.int64), np.full((n_trees, nodes), np.inf), np.zeros((n_trees, leaves)), depth, float(np.log(share / (1 - share))))
    margin = np.full(len(y), trees.bias)
    below = [x[:, f][:, None] > cuts[f][None, :] for f in range(x.shape[1])]
    for t in range(n_trees):
        p = _sigmoid(margin)
        g, h = y - p, p * (1 - p)
        where = np.zeros(len(y), np.int64)
        for node in range(nodes):
            inside = where == node
            if inside.sum() >= 20:
                gi, hi = g[inside], h[inside]
                total_g, total_h = gi.sum(), hi.sum()
                best = 1e-6
                for f, over in enumerate(below):
                    o = over[inside]
                    right_g, right_h = gi @ o, hi @ o
                    gain = right_g**2 / (right_h + l2) + (total_g - right_g) ** 2 / (total_h - right_h + l2) - total_g**2 / (total_h + l2)
                    j = int(np.argmax(gain))
                    if gain[j] > best:
                        best, trees.feature[t, node], trees.cut[t, node] = gain[j], f, cuts[f][j]
            where[inside] = 2 * node + 1 + (x[inside, trees.feature[t, node]] > trees.cut[t, node])
        for leaf in range(nodes, leaves):
            inside = where == leaf
            trees.value[t, leaf] = rate * g[inside].sum() / (h[inside].sum() + l2)
        margin += trees.value[t, where]
    return trees


def calibrate(trees: Trees, x: np.ndarray, y: np.ndarray, precision: float = WANTED_PRECISION) -> Trees:
    """Platt scaling by Newton steps, then each kind's lowest threshold of the wanted precision."""
    z, a, b = trees.margin(x), 1.0, 0.0
    for _ in range(25):
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        grad = np.array([((y - p) * z).sum() - 1e-3 * a, (y - p).sum() - 1e-3 * b])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    trees.scale = (float(a), float(b))
    p = trees.probability(x)

    def lowest(own: np.ndarray) -> float:
        order = np.argsort(-p[own], kind="stable")
        right = (np.cumsum(y[own][order]) + 1) / (np.arange(1, own.sum() + 1) + 1)
        fine = np.flatnonzero(right >= precision)
        if not len(fine):
            return float(p[own].max(initial=0.5))
        last = fine[-1]
        below = own.nonzero()[0][order][last : last + 2]  # half way between the last accepted and the first rejected
        return float(_sigmoid(trees.scale[0] * z[below].mean() + trees.scale[1])) if len(below) == 2 else min(0.5, float(p[below[0]]))

    kinds = [x[:, 0] == kind for kind in range(len(KINDS))]
    together = lowest(np.ones(len(y), bool))
    trees.thresholds = tuple(lowest(own) if y[own].sum() >= OWN_POSITIVES else together for own in kinds)
    return trees


def fit(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_CANDIDATES) -> Trees | None:
    """Trees fitted on at most ``most`` candidates: those with the lowest hashes of their text and place."""

    def compute(texts: list[str]):
        rows = [[{"key": k, "x": [float(v) for v in x], "y": y, "refuted": r} for k, x, y, r in examples(text)] for text in texts]
        kind = pa.list_(pa.struct([("key", pa.string()), ("x", pa.list_(pa.float64())), ("y", pa.bool_()), ("refuted", pa.bool_())]))
        return [pa.array(rows, kind)]

    found = map_texts(docs, text_col, (), "found array<struct<key: string, x: array<double>, y: boolean, refuted: boolean>>", compute)
    different = materialize(found.select(F.explode("found").alias("c")).select("c.*").distinct(), "candidates")
    share = min(1.0, 2 * most / max(1, different.count()))  # so that partitions send about 2 x most rows together
    some = different.where(F.pmod(F.xxhash64("key", "x"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = some.orderBy(F.xxhash64("key", "x"), "key", "y", "x").limit(most).collect()
    if len(sample) < 50 or len({r["y"] for r in sample}) < 2:
        return None
    x, y = np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float)
    held = np.arange(len(y)) % 10 < 3
    asked = held & ~np.array([r["refuted"] for r in sample])  # refuted candidates are never asked about
    if len(set(y[~held])) < 2 or not asked.any():
        return None
    return calibrate(fit_trees(x[~held], y[~held]), x[asked], y[asked])


def find_all(texts: list[str], trees: Trees | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; candidates of all texts are scored at once."""
    results, asked, x = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if _ANY.search(text) else []
        results.append((base, list(base)))
        if trees is not None:
            for k, s, e in candidates(text):
                if not any(s < b and a < e for _, a, b in base) and not refuted(k, text, s, e):
                    asked.append((i, k, s, e))
                    x.append(describe(text, k, s, e))
    if asked:
        p = trees.probability(np.array(x, float))
        for j in np.argsort(-p, kind="stable"):
            i, k, s, e = asked[j]
            if p[j] >= trees.thresholds[KINDS.index(k)] and not any(s < b and a < e for _, a, b in results[i][1]):
                results[i][1].append((k, s, e))
    return [(base, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))) for base, spans in results]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_pii(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), trees: Trees | None = None) -> DataFrame:
    """``keep`` columns plus n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans of each text."""
    trees = trees or fit(docs, text_col)

    def compute(texts: list[str]):
        found = find_all(texts, trees)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
        return [*counts, pa.array(digests, pa.string()), pa.array([_joined(spans) for _, spans in found], pa.string())]

    return map_texts(docs, text_col, keep, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string", compute)
