"""One pass over contents for all rules that read text.

File contents are by far the largest input, and many rules look at them. Instead of
scanning contents once per rule, a file row is marked once with everything any rule
wants to know about its text, and a line row likewise. Stored without the text, the
marks are small; the rules read only them. Used on unmarked rows, the same functions add
the marks lazily and Catalyst drops the ones a single rule does not need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text

# Words whose presence in lower-cased text sets a feature flag.
FLAG_WORDS = {
    "fastapi": ["from fastapi", "import fastapi"],
    "pydantic": ["pydantic"],
    "sqlalchemy": ["sqlalchemy"],
    "alembic": ["alembic"],
    "oauth2": ["oauth2"],
    "cors": ["corsmiddleware"],
    "redis": ["redis"],
    "celery": ["celery"],
    "pytest": ["pytest"],
    "graphql": ["graphql"],
    "openapi": ["openapi"],
    "kubernetes": ["kubernetes"],
}

# Whole words in lower-cased text that set a feature flag.
WHOLE_WORDS = {
    "jwt": ["jwt", "jose", "pyjwt"],
    "rbac": ["rbac", "role", "permission", "is_admin", "admin_required"],
    "postgresql": ["postgresql", "asyncpg", "psycopg"],
}

# Path words of the domain layer, and frameworks it should not use.
DOMAIN_WORDS = ["domain", "model", "entity", "value_object", "service"]
FRAMEWORKS = ["fastapi", "sqlalchemy", "flask", "django", "requests"]

# Path words of the interface layer, and signs of database work in exact case.
INTERFACE_WORDS = ["api", "route"]
DATABASE_WORDS = ["session.query", "db.query", "SELECT", "INSERT", "UPDATE", "DELETE"]

# Texts that show a route is protected.
SECURITY_MARKERS = [
    "Security(", "OAuth2PasswordBearer", "HTTPBearer", "HTTPBasic", "JWTBearer", "APIKeyHeader",
    "APIKeyQuery", "APIKeyCookie",
]

# Fixed values: (argument, rule) pairs that switch documentation off.
DISABLED_DOCS = [
    ("openapi_url", "FASTAPI-OPENAPI-DISABLED"),
    ("docs_url", "FASTAPI-DOCS-DISABLED"),
    ("redoc_url", "FASTAPI-REDOC-DISABLED"),
]

SHOWN_LINE = 100  # characters of a line that a finding may quote


def word_flags(column: Column, words: dict[str, list[str]]) -> dict[str, Column]:
    """A boolean per flag: any of its words occurs."""
    return {flag: text.contains_any(column, needles) for flag, needles in words.items()}


def whole_word(column: Column, words: list[str]) -> Column:
    """True when one of the words occurs between word borders; only texts that hold one pay for the pattern."""
    return text.contains_any(column, words) & column.rlike(rf"(?U)\b({'|'.join(words)})\b")


def first_word(path: Column, content: Column, path_words: list[str], words: list[str]) -> Column:
    """The first listed word in the text of a file whose path holds one of the path words."""
    found = F.try_element_at(text.words_found(F.lower(content), words), F.lit(1))
    return F.when(text.contains_any(F.lower(path), path_words), found)


def may_hold_secrets() -> Column:
    """Files the secret scan looks at: texts, tests only if dotenv files."""
    return F.col("is_text") & (~F.col("is_test") | F.col("is_dotenv"))


def mark_files(files: DataFrame) -> DataFrame:
    """Add what the file rules and the stack detection need to know about the content."""
    if "secrets" in files.columns:
        return files
    content = F.coalesce("content", F.lit(""))
    low_text = F.when(F.col("is_text"), F.lower(content)).otherwise("")
    flags = word_flags(low_text, FLAG_WORDS)
    flags |= {flag: whole_word(low_text, words) for flag, words in WHOLE_WORDS.items()}
    is_dockerfile = F.lower("name") == "dockerfile"
    return files.withColumns({
        "has_text": content != "",
        "flags": F.struct(*[test.alias(flag) for flag, test in flags.items()]),
        "sql_words": F.col("is_py") & text.has_sql_words(content),
        "secrets": F.when(may_hold_secrets(), text.secret_hits(content)),
        "framework": F.when(F.col("is_py"), first_word(F.col("path"), content, DOMAIN_WORDS, FRAMEWORKS)),
        "no_user": is_dockerfile & ~content.rlike(r"(?md)^\s*USER\s+\S+"),
        "remote_add": is_dockerfile & text.contains_any(content, ["ADD http://", "ADD https://"]),
    })


# The groups of rules that look at one line.
LINE_GROUPS = ["secrets", "sql", "docs"]


def mark_lines(lines: DataFrame, groups: list[str] = LINE_GROUPS) -> DataFrame:
    """Add what the line rules, and the rules that look up a line, need to know of it.

    ``broken`` holds the ids of the line rules of the given groups that the line breaks.
    """
    if "broken" in lines.columns:
        return lines
    line = F.col("line")
    none = F.array().cast("array<string>")
    secret = F.when(text.has_hardcoded_secret(line), F.array(F.lit("SEC-HARDCODED-SECRET")))
    statement = F.array(
        F.when(text.is_sql_risk(line), F.lit("SQL-INJECTION-PATTERN")),
        F.when(text.contains_any(line, ['f"', "f'"]), F.lit("SQL-INJECTION-FSTRING")),
        F.when(F.contains(line, F.lit(".format(")), F.lit("SQL-INJECTION-FORMAT")),
    )
    docs = F.when(
        F.contains(line, F.lit("None")),
        F.array(*[F.when(F.contains(line, F.lit(arg)), F.lit(rule)) for arg, rule in DISABLED_DOCS]),
    )
    is_sql = text.looks_like_sql(line)
    in_interface = text.contains_any(F.lower("path"), INTERFACE_WORDS)
    by_group = {"secrets": secret, "sql": F.when(is_sql, statement), "docs": docs}
    broken = F.concat(*[F.coalesce(by_group[g], none) for g in groups])
    # Arrays are only built for lines that may break a rule.
    tests = {"secrets": text.has_hardcoded_secret(line), "sql": is_sql, "docs": F.contains(line, F.lit("None"))}
    suspect = text.any_of([tests[g] for g in groups])
    return lines.withColumns({
        "head": F.substring(line, 1, SHOWN_LINE),
        "is_sql": is_sql,
        "broken": F.when(suspect, F.filter(broken, lambda r: r.isNotNull())).otherwise(none),
        "database_word": in_interface & text.contains_any(line, DATABASE_WORDS),
        "guard": text.contains_any(line, SECURITY_MARKERS),
        "awaits": F.contains(line, F.lit("await ")),
        "async_with": F.contains(line, F.lit("async with")),
        "validator": text.contains_any(line, ["@validator", "@root_validator"]),
        "alias": F.contains(line, F.lit("Field(")) & F.contains(line, F.lit("alias=")),
    })


LINE_FLAGS = ["is_sql", "database_word", "guard", "awaits", "async_with", "validator", "alias"]


def marked_only(lines: DataFrame) -> DataFrame:
    """Marked lines that some rule may want, without their full text."""
    wanted = reduce(lambda a, b: a | b, [F.col(f) for f in LINE_FLAGS]) | (F.size("broken") > 0)
    return mark_lines(lines).filter(wanted).drop("line")
