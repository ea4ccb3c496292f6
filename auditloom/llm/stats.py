"""Statistics of whole texts: the inputs of the quality rules and of the quality classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

from auditloom.llm.textarrays import Texts, byte_table, mix, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digits_per_char",
    "stops_per_word", "distinct_share", "bars_per_word", "shouts_per_word", "lines_per_word", "short_share",
    "wide_share", "echo_share", "capital_share",
]

COUNT_FIELDS = [T.StructField(c, T.LongType()) for c in COUNTS]
FEATURE_FIELDS = [T.StructField(c, T.DoubleType()) for c in FEATURES]

SYMBOLS = byte_table(b"#*$%&|<>")
UPPER = byte_table(range(65, 91))
LETTERS = UPPER | byte_table(range(97, 123))
DIGITS = byte_table(range(48, 58))
STOPS = byte_table(b".,;:?")
BARS = byte_table(b"|")
SHOUTS = byte_table(b"!")
#: Bytes that continue a code point.
INNER = byte_table(range(0x80, 0xC0))
WIDE = byte_table(range(0xC0, 0x100))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(keys) else np.zeros(0, bool)
    twice = same | np.concatenate([same[1:], [False]]) if len(keys) else same
    out = np.empty(len(keys), bool)
    out[order] = twice
    return out


def later(keys: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """By text, how many keys are equal to an earlier one; keys of different texts must differ."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.bincount(owner[order[same]], minlength=texts)


def measure(texts: Texts) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(counts, features) of each text; the empty text has zeros everywhere."""
    data, n = texts.data, len(texts)
    words = texts.words()
    n_words = words.counts()
    owner = words.owner()
    hashes = texts.hashes(words)
    salted = mix(np.arange(n, dtype=np.uint64) + np.uint64(11))

    start_of_char = ~INNER[data]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.starts] += 1
    np.subtract.at(inside, words.ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    word_chars = texts.count(inside & start_of_char)
    n_chars = texts.count(start_of_char)

    lines = texts.lines()
    line_owner = lines.owner()
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_keys = texts.hashes(lines) + salted[line_owner]
    dup_lines = later(line_keys[worded], line_owner[worded], n)

    triples, first = windows(hashes, words.marks, 3)
    hit = first[repeated(triples + salted[owner[first]])]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[hit + k] = True
    repeat_words = words.per_text(covered)

    counts = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": texts.count(SYMBOLS[data]),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
    }
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    per_word = np.maximum(n_words, 1)
    features = {
        "log_words": np.log1p(n_words),
        "word_length": word_chars / per_word,
        "symbols_per_word": counts["n_symbols"] / per_word,
        "dup_line_share": dup_lines / np.maximum(lines.per_text(worded), 1),
        "repeat_share": repeat_words / per_word,
        "upper_share": texts.count(UPPER[data]) / np.maximum(texts.count(LETTERS[data]), 1),
        "digits_per_char": texts.count(DIGITS[data]) / np.maximum(n_chars, 1),
        "stops_per_word": texts.count(STOPS[data]) / per_word,
        "distinct_share": (n_words - later(hashes + salted[owner], owner, n)) / per_word,
        "bars_per_word": texts.count(BARS[data]) / per_word,
        "shouts_per_word": texts.count(SHOUTS[data]) / per_word,
        "lines_per_word": lines.counts() / per_word,
        "short_share": words.per_text(words.ends - words.starts <= 2) / per_word,
        "wide_share": texts.count(WIDE[data]) / np.maximum(n_chars, 1),
        "echo_share": words.per_text(echo) / per_word,
        "capital_share": words.per_text(UPPER[data[words.starts]]) / per_word,
    }
    return counts, {k: v.astype(np.float64) for k, v in features.items()}


def features(texts: Texts) -> list[np.ndarray]:
    """FEATURES of each text, in order."""
    found = measure(texts)[1]
    return [found[c] for c in FEATURES]


def counts_and_features(texts: Texts) -> list[np.ndarray]:
    """COUNTS and FEATURES of each text, in order."""
    counted, found = measure(texts)
    return [*(counted[c] for c in COUNTS), *(found[c] for c in FEATURES)]
