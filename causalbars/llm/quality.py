"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule votes good (1), bad (0) or abstains on a document. Expectation-maximisation over the votes of all
documents estimates how accurate each rule is, and the posterior probability of quality replaces the usual
"pass every rule". The two hard base rules (under 20 words; over 30 % of words in repeated 8-word windows)
always reject.

EM runs on the histogram of vote patterns, which has at most 3 ** (number of rules) rows whatever the size of
the corpus, so it uses every document and never a sample.

Defined results: null and empty texts have no words and fail the base rules; repeated rows get the same
result; null ids pass through; only the named columns are read, so extra columns cannot clash; an empty table
gives an empty table (the prior is then never used).
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import SLICE_ROWS, map_texts, materialize, ship_package

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: A document is kept if its posterior probability of quality is at least this.
MIN_POSTERIOR = 0.5
#: The rules are written so that a good document seldom draws a bad vote: EM keeps that chance at most this.
MAX_FALSE_ALARM = 0.005
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
GOOD, BAD, ABSTAIN = 1, 0, 2


@dataclass(frozen=True)
class Rule:
    """Votes bad if ``value`` is outside ``[bad_below, bad_above]``, good inside ``[good_from, good_to]``."""

    name: str
    bad_below: float
    good_from: float
    good_to: float
    bad_above: float


RULES = (
    Rule("n_words", 20, 40, np.inf, np.inf),
    Rule("mean_word_chars", 2.2, 3.0, 9.0, 14.0),
    Rule("symbols_per_word", -1, 0, 0.05, 0.25),
    Rule("dup_line_share", -1, 0, 0.15, 0.4),
    Rule("repeat_word_share", -1, 0, 0.1, 0.3),
    Rule("letter_share", 0.55, 0.75, 1.0, 2.0),
    Rule("upper_share", -1, 0, 0.3, 0.7),
    Rule("distinct_word_share", 0.08, 0.15, 1.0, 2.0),
    Rule("echo_share", -1, 0, 0.05, 0.3),
)
_SALT = 0x9E3779B97F4A7C15
_PLACE_SALTS = [np.uint64((j + 1) * _SALT % 2**64) for j in range(WINDOW)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(word_hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words that lie in a window of WINDOW words found twice or more in their text, for each text.

    ``word_hashes`` (uint64) holds the words of all texts on end, ``sizes`` how many each text has. Windows
    are compared by a 64-bit polynomial hash that is salted with the text's number.
    """
    total, n, window = len(word_hashes), len(sizes), WINDOW
    ends = np.cumsum(sizes)
    if total < window:
        return np.zeros(n, np.int64)
    rolled = np.zeros(total - window + 1, np.uint64)
    for j, salt in enumerate(_PLACE_SALTS):
        rolled = rolled * np.uint64(0x100000001B3) + _mix(word_hashes[j : total - window + 1 + j] + salt)
    text_of = np.repeat(np.arange(n), sizes)
    whole = np.flatnonzero(np.arange(len(rolled)) + window <= ends[text_of[: len(rolled)]])
    keys = _mix(rolled[whole] + text_of[whole].astype(np.uint64) * np.uint64(_SALT))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(total + 1, np.int64)
    starts = whole[twice]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(text_of[covered], minlength=n).astype(np.int64)


def _votes(values: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of each document: one base-3 digit a rule."""
    pattern = np.zeros(len(values["n_words"]), np.int64)
    for rule in RULES:
        x = values[rule.name]
        vote = np.full(len(x), ABSTAIN)
        vote[(x >= rule.good_from) & (x <= rule.good_to)] = GOOD
        vote[(x < rule.bad_below) | (x > rule.bad_above)] = BAD
        pattern = pattern * 3 + vote
    return pattern


def features(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The contract's counts, the base verdict and the vote pattern of each text."""
    n = len(texts)
    counts = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    lines, letters, uppers, distinct, echoes = (np.zeros(n) for _ in range(5))
    hashes: list[int] = []
    for i, text in enumerate(texts):
        data = text.encode()
        words = data.split()
        hashed = list(map(hash, words))
        hashes += hashed
        counts["n_words"][i] = len(words)
        counts["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        counts["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        full = [x for x in text.split("\n") if x.strip(BLANKS)]
        lines[i] = len(full)
        counts["n_dup_lines"][i] = len(full) - len(set(full))
        distinct[i] = len(set(hashed))
        echoes[i] = sum(map(eq, hashed, hashed[1:]))
        raw = np.frombuffer(data, np.uint8)
        upper = np.count_nonzero((raw >= 65) & (raw <= 90))
        ascii_letters = np.count_nonzero(((raw | 32) >= 97) & ((raw | 32) <= 122))
        letters[i] = ascii_letters + (len(text) - np.count_nonzero(raw < 128))
        uppers[i] = upper / max(ascii_letters, 1)
    counts["n_repeat_words"] = repeated_words(np.array(hashes, np.int64).view(np.uint64), counts["n_words"])
    words = np.maximum(counts["n_words"], 1)
    chars = np.maximum(counts["word_chars"], 1)
    values = {
        "n_words": counts["n_words"].astype(float),
        "mean_word_chars": counts["word_chars"] / words,
        "symbols_per_word": counts["n_symbols"] / words,
        "dup_line_share": counts["n_dup_lines"] / np.maximum(lines, 1),
        "repeat_word_share": counts["n_repeat_words"] / words,
        "letter_share": letters / chars,
        "upper_share": uppers,
        "echo_share": echoes / words,
        "distinct_word_share": np.minimum(1, distinct / np.minimum(words, 500)),
    }
    failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    return counts, failed, _votes(values)


def digits(patterns: np.ndarray) -> np.ndarray:
    """Votes (documents x rules) of base-3 patterns."""
    powers = 3 ** np.arange(len(RULES) - 1, -1, -1)
    return (np.asarray(patterns)[:, None] // powers) % 3


def fit_posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """EM for the two-class model with independent rules: P(good | pattern) for each pattern.

    In either class each rule has its own chance to vote bad, given that it votes; an abstention says
    nothing. A weak Beta prior holds that good documents seldom draw a bad vote and bad ones often do, and
    so names the classes.
    """
    votes = digits(patterns)
    bad_vote, good_vote = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    weight = np.asarray(counts, float)
    strength = 0.02 * weight.sum() + 1.0
    share, in_good, in_bad = 0.8, np.full(len(RULES), 0.002), np.full(len(RULES), 0.3)
    posterior = np.zeros(len(weight))
    for _ in range(rounds):
        of_good = np.log(share) + bad_vote @ np.log(in_good) + good_vote @ np.log1p(-in_good)
        of_bad = np.log(1 - share) + bad_vote @ np.log(in_bad) + good_vote @ np.log1p(-in_bad)
        posterior = 1 / (1 + np.exp(np.clip(of_bad - of_good, -500, 500)))
        p, q = weight * posterior, weight * (1 - posterior)
        share = float(np.clip((p.sum() + 4) / (weight.sum() + 5), 0.05, 0.99))
        in_good = np.minimum((p @ bad_vote + 0.002 * strength) / (p @ (bad_vote + good_vote) + strength), MAX_FALSE_ALARM)
        in_bad = np.maximum((q @ bad_vote + 0.3 * strength) / (q @ (bad_vote + good_vote) + strength), 0.05)
    return posterior


def _compute(texts: list[str]):
    counts, failed, pattern = features(texts)
    return [*[pa.array(c) for c in counts.values()], pa.array(failed), pa.array(pattern)]


def _posteriors(measured: DataFrame) -> tuple[list[int], list[float]]:
    """Fits on the histogram of patterns; at most 3 ** rules rows reach the driver."""
    rows = measured.groupBy("pattern").count().orderBy("pattern").collect()
    patterns = [r["pattern"] for r in rows]
    fitted = fit_posteriors(np.array(patterns, np.int64), np.array([r["count"] for r in rows])) if rows else np.array([])
    return patterns, fitted.tolist()


def assess(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus the counts, base_failed, pattern, posterior and kept of each document."""
    measured = materialize(map_texts(docs, text_col, keep, f"{FEATURES}, base_failed boolean, pattern long", _compute), "quality")
    patterns, fitted = _posteriors(measured)
    spark = docs.sparkSession
    table = spark.createDataFrame(list(zip(patterns, fitted)), "pattern long, posterior double")
    joined = measured.join(F.broadcast(table), "pattern", "left")  # at most 3 ** rules rows
    kept = ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= MIN_POSTERIOR)
    return joined.select(*measured.columns, "posterior", kept.alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the posterior keep, columns unchanged.

    Two narrow passes over the texts (votes, then verdicts) instead of a join on ids, so ids need not be
    unique or present and nothing but the histogram is shuffled.
    """
    patterns, fitted = _posteriors(map_texts(docs, text_col, (), "pattern long", lambda t: [pa.array(features(t)[2])]))
    good = {p for p, x in zip(patterns, fitted) if x >= MIN_POSTERIOR}
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                _, failed, pattern = features([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([not f and p in good for f, p in zip(failed.tolist(), pattern.tolist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
