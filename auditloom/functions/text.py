"""Predicates over text columns. All are plain Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Case-insensitive with Unicode classes and folding.
ANY_CASE = "(?iuU)"

# What ends a line of text; \R lacks the three separator controls.
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\x{2028}\x{2029}]"
RARE_LINE_BREAK = r"[\x0B\x0C\r\x1C-\x1E\x85\x{2028}\x{2029}]"

# An assignment of a quoted literal to a secret-looking name.
HARDCODED_SECRET = r"""(password|secret|api[_-]?key|token)\s*=\s*["'][^"']{8,}["']"""

# Secret signatures, (label, pattern, case matters).
SECRET_PATTERNS = [
    ("Clé privée", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", True),
    ("Clé AWS potentielle", r"aws_access_key_id\s*=\s*[A-Z0-9]{16,}", False),
    ("Secret AWS potentiel", r"aws_secret_access_key\s*=\s*[A-Za-z0-9/+]{40,}", False),
    ("Token GitHub potentiel", r"github_pat_[A-Za-z0-9_]{20,}", False),
    ("Token GitHub (nouveau format)", r"ghp_[A-Za-z0-9_]{36,}", False),
    ("Mot de passe codé en dur", r"""password\s*=\s*["'][^"']{8,}["']""", False),
    ("Secret codé en dur", r"""secret\s*=\s*["'][^"']{8,}["']""", False),
    ("Clé API codée en dur", r"""api[_-]?key\s*=\s*["'][^"']{8,}["']""", False),
    ("Token codé en dur", r"""token\s*=\s*["'][^"']{8,}["']""", False),
]

# Statement shapes, tried on lower-cased text with single spaces.
SQL_SHAPES = [
    r"\bselect\b.+\bfrom\b",
    r"\binsert\s+into\b",
    r"\bupdate\b.+\bset\b",
    r"\bdelete\s+from\b",
]

# Ways of splicing values into a statement.
SQL_RISKS = [
    r'f""?SELECT.*\{.*\}.*"',
    r'f""?INSERT.*\{.*\}.*"',
    r'f""?UPDATE.*\{.*\}.*"',
    r'f""?DELETE.*\{.*\}.*"',
    r"\.format\(.*\)",
    r"%s.*%",
    r"\+.*WHERE",
    r"\+.*VALUES",
]

# Words whose presence anywhere means a repository talks SQL.
STATEMENTS = ["select", "insert", "update", "delete"]
SQL_WORDS = r"\b(select|insert|update|delete)\b"

# Characters beyond ASCII that ANY_CASE takes for an ASCII letter.
FOLDED = ["\u0130", "\u0131", "\u017f", "\u212a"]

# Parts of a name that suggest a secret.
SENSITIVE_WORDS = [
    "password", "secret", "key", "token", "credential", "auth", "jwt", "oauth",
    "api_key", "private_key", "access_key", "secret_key", "bearer", "session",
]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(column: Column, words: list[str]) -> Column:
    """True when any of a fixed list of words occurs in the column."""
    return any_of([F.contains(column, F.lit(w)) for w in words])


def words_found(column: Column, words: list[str]) -> Column:
    """Array of the words that occur in the column, in list order."""
    hits = F.array(*[F.when(F.contains(column, F.lit(w)), F.lit(w)) for w in words])
    return F.filter(hits, lambda w: w.isNotNull())


def ends_with_any(whole: list[str], suffix: Column) -> Column:
    """True when some entry of a fixed list ends with the column's value."""
    return any_of([F.endswith(F.lit(w), suffix) for w in whole])


def assigns_literal(text: Column) -> Column:
    """A cheap test that every quoted assignment passes and most texts fail."""
    return F.contains(text, F.lit("=")) & text.rlike(r"""(?U)=\s*["']""")


def has_hardcoded_secret(line: Column) -> Column:
    return assigns_literal(line) & line.rlike(ANY_CASE + HARDCODED_SECRET)


def secret_hits(text: Column) -> Column:
    """Labels of every secret signature found in a text: one pass, no pattern join.

    A signature is only searched for in texts that hold a character it needs.
    """
    hits = []
    for label, pattern, exact in SECRET_PATTERNS:
        found = text.rlike(pattern if exact else ANY_CASE + pattern)
        if "[\"']" in pattern:
            found = assigns_literal(text) & found
        elif "_" in pattern:
            found = F.contains(text, F.lit("_")) & found
        hits.append(F.when(found, F.lit(label)))
    return F.filter(F.array(*hits), lambda label: label.isNotNull())


def looks_like_sql(text: Column) -> Column:
    """The text has the structure of a statement, not merely a word such as 'update'.

    The cheap word test runs first; only texts that pass pay for whitespace folding.
    """
    low = F.lower(text)
    folded = F.regexp_replace(low, r"(?U)[\s\x1C-\x1F]+", " ")
    shape = folded.rlike("(?U)" + "|".join(f"(?:{s})" for s in SQL_SHAPES))
    return contains_any(low, STATEMENTS) & shape


def is_sql_risk(line: Column) -> Column:
    return line.rlike(ANY_CASE + "|".join(f"(?:{p})" for p in SQL_RISKS))


def has_sql_words(text: Column) -> Column:
    """A cheap test runs first that every text with such a word passes, and most others fail."""
    held = contains_any(F.lower(text), STATEMENTS) | contains_any(text, FOLDED)
    return held & text.rlike(ANY_CASE + SQL_WORDS)


def is_sensitive_name(name: Column) -> Column:
    """One pass over the name; a longer word that holds a shorter one adds nothing."""
    short = [w for w in SENSITIVE_WORDS if not any(o != w and o in w for o in SENSITIVE_WORDS)]
    return F.lower(name).rlike("|".join(short))
