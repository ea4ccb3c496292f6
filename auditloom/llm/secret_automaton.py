"""Secrets: all rules in one deterministic automaton, run over bytes once; spans from the texts it flags."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from auditloom.llm.common import add_columns
from auditloom.llm.textarrays import Texts

# ---- regular expressions as trees -----------------------------------------------------------


def chars(members: str) -> tuple:
    return ("set", frozenset(members.encode()))


def seq(*parts) -> tuple:
    return ("seq", tuple(parts))


def either(*parts) -> tuple:
    return ("or", tuple(parts))


def many(part) -> tuple:
    return ("many", part)


def maybe(part) -> tuple:
    return ("or", (part, ("seq", ())))


def times(part, n: int) -> tuple:
    return ("seq", (part,) * n)


def word(text: str, any_case: bool = False) -> tuple:
    return seq(*(chars(c.lower() + c.upper() if any_case else c) for c in text))


UPPERS, LOWERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM = UPPERS + LOWERS + DIGITS
SPACES = many(chars(" "))
QUOTE = maybe(chars("\"'"))
KEYWORD = either(
    word("password", True), word("passwd", True), word("secret", True), word("token", True),
    seq(word("api", True), maybe(chars("_")), word("key", True)),
)


def letters(text: str) -> str:
    """A pattern for ``text`` in either case of its ASCII letters."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in text)


@dataclass(frozen=True)
class SecretRule:
    """``core`` is a string that every match holds; ``spans`` finds the matches exactly."""

    kind: str
    core: tuple
    spans: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds come first and in the order of their contract.
RULES = (
    SecretRule(
        "assign", seq(KEYWORD, QUOTE, SPACES, chars(":="), SPACES, QUOTE, times(chars(ALNUM + "+/_.=-"), 6)),
        f"(?:{'|'.join(map(letters, ['password', 'passwd', 'secret', 'token', 'api_?key']))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1, 6, True),
    SecretRule("access", seq(word("AKIA"), times(chars(UPPERS + DIGITS), 16)), "AKIA[A-Z0-9]+", 0, 20, True),
    SecretRule("hex", times(chars(DIGITS + "abcdef"), 24), "[0-9a-f]+", 0, 24, True),
    SecretRule("private_key", seq(word("-----BEGIN "), many(chars(UPPERS + " ")), word("PRIVATE KEY-----")), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    SecretRule("github", seq(word("gh"), chars("pousr"), word("_"), times(chars(ALNUM), 2)), r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("slack", seq(word("xox"), chars("abprs"), word("-")), r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    SecretRule("web_token", seq(chars(ALNUM + "_-"), word(".eyJ")),
               r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    SecretRule("stripe", word("sk_live_"), r"sk_live_[A-Za-z0-9]+", 0, 24),
)

# ---- automaton ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """next[state * classes + classes_of[byte]]; accepts[state] has a bit for each rule."""

    classes_of: np.ndarray
    next: np.ndarray
    accepts: np.ndarray
    n_classes: int

    def resets(self) -> np.ndarray:
        """Bytes after which the state is the start state, whatever came before."""
        columns = self.next.reshape(-1, self.n_classes)
        return (columns == 0).all(axis=0)[self.classes_of]


def positions(tree, moves: list, ends: dict) -> tuple[set, set, bool]:
    """First and last character positions of a tree and whether it can be empty (Glushkov)."""
    kind, body = tree
    if kind == "set":
        moves.append((body, set()))
        return {len(moves) - 1}, {len(moves) - 1}, False
    if kind == "or":
        found = [positions(x, moves, ends) for x in body]
        return set().union(*(f for f, _, _ in found)), set().union(*(e for _, e, _ in found)), any(x for *_, x in found)
    if kind == "many":
        first, last, _ = positions(body, moves, ends)
        for k in last:
            moves[k][1].update(first)
        return first, last, True
    first, last, empty = set(), set(), True
    for x in body:
        f, e, void = positions(x, moves, ends)
        for k in last:
            moves[k][1].update(f)
        first |= f if empty else set()
        last = e | (last if void else set())
        empty = empty and void
    return first, last, empty


def compile_rules(cores: list[tuple]) -> Automaton:
    """Subset construction over all rules at once, then minimisation by refining classes of states."""
    moves: list[tuple[frozenset, set]] = []
    starts, final = set(), {}
    for bit, core in enumerate(cores):
        first, last, empty = positions(core, moves, {})
        if empty:
            raise ValueError("a rule matches the empty string")
        starts |= first
        for k in last:
            final[k] = final.get(k, 0) | 1 << bit
    signature: dict[tuple, int] = {}
    classes_of = np.zeros(256, np.uint8)
    for byte in range(256):
        key = tuple(k for k, (members, _) in enumerate(moves) if byte in members)
        classes_of[byte] = signature.setdefault(key, len(signature))
    reads = [frozenset(key) for key in signature]

    # A state is the set of positions just read; a match may begin anywhere.
    known, rows, masks, todo = {frozenset(): 0}, [], [], [frozenset()]
    while todo:
        after = []
        for state in todo:
            may = set(starts).union(*(moves[k][1] for k in state))
            row = []
            for read in reads:
                target = frozenset(may & read)
                if target not in known:
                    known[target] = len(known)
                    after.append(target)
                row.append(known[target])
            rows.append(row)
            mask = 0
            for k in state:
                mask |= final.get(k, 0)
            masks.append(mask)
        todo = after
    table, accepts = np.array(rows, np.int64), np.array(masks, np.int64)

    # Moore: states are equal while they accept alike and go to equal states.
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.concatenate([[block[0]], np.setdiff1d(np.arange(block.max() + 1), block[:1])])
    name = np.empty(len(order), np.int64)
    name[order] = np.arange(len(order))
    block = name[block]
    one = np.unique(block, return_index=True)[1]
    return Automaton(classes_of, block[table[one]].astype(np.int32).ravel(), accepts[one].astype(np.int32), len(reads))


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return compile_rules([r.core for r in RULES])


def flags(machine: Automaton, texts: Texts, lane: int = 1024) -> np.ndarray:
    """Bits of the rules found in each text: one pass over the bytes, many lanes side by side.

    Texts are cut into lanes after bytes that reset the automaton, so every lane begins in the
    start state. A stretch without such a byte is one lane, however long.
    """
    data = texts.data
    out = np.zeros(len(texts), np.int32)
    if not len(data):
        return out
    resets = np.flatnonzero(machine.resets()[data]) + 1
    targets = np.arange(lane, len(data), lane)
    at = np.searchsorted(resets, targets)
    cuts = resets[at[at < len(resets)]]
    starts = np.unique(np.concatenate([texts.offsets[:-1][texts.lengths() > 0], cuts[cuts < len(data)]]))
    lengths = np.diff(np.append(starts, len(data)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    classes = machine.classes_of[data].astype(np.int32)
    state = np.zeros(len(starts), np.int32)
    seen = np.zeros(len(starts), np.int32)
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for step, n in enumerate(alive):
        state[:n] = machine.next[state[:n] * machine.n_classes + classes[starts[:n] + step]]
        seen[:n] |= machine.accepts[state[:n]]
    np.bitwise_or.at(out, np.searchsorted(texts.offsets, starts, side="right") - 1, seen)
    return out


PATTERNS = [re.compile(r.spans) for r in RULES]


def exact_spans(text: str, bits: int) -> list[tuple[int, int, int]]:
    """(start, rule, end) of all matches of the flagged rules, in code points."""
    found = []
    for k, rule in enumerate(RULES):
        if bits >> k & 1:
            for m in PATTERNS[k].finditer(text):
                if len(m[rule.group]) >= rule.least:
                    found.append((m.start(), k, m.end()))
    return sorted(found)


FIELDS = [
    *(T.StructField(f"n_{r.kind}", T.LongType()) for r in RULES),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
]


def found_columns(texts: Texts, machine: Automaton) -> list:
    counts = np.zeros((len(RULES), len(texts)), np.int64)
    nothing = hashlib.sha256(b"").hexdigest()
    digests, spans = [nothing] * len(texts), [""] * len(texts)
    bits = flags(machine, texts)
    for i in np.flatnonzero(bits):
        text = texts.data[texts.offsets[i]:texts.offsets[i + 1]].tobytes().decode()
        found = exact_spans(text, int(bits[i]))
        for _, k, _ in found:
            counts[k, i] += 1
        shown = [f"{RULES[k].kind}:{a}:{b}" for a, k, b in found]
        base = [s for s, (_, k, _) in zip(shown, found, strict=True) if RULES[k].base]
        digests[i], spans[i] = hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(shown)
    return [*counts, digests, spans]


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, a count for each base kind, base_sha256, spans, a count for each further kind.

    A null text counts as empty; repeated rows are searched each; other columns are not used;
    an empty table gives an empty table. Spans of one kind never overlap; of two kinds they may.
    """
    # Compiled once; its size depends on the rules only.
    machine = docs.sparkSession.sparkContext.broadcast(automaton())
    found = add_columns(docs.select("doc_id", "text"), FIELDS, lambda t: found_columns(t, machine.value))
    base, further = ([f"n_{r.kind}" for r in RULES if r.base == kind] for kind in (True, False))
    return found.select("doc_id", *base, "base_sha256", "spans", *further)
