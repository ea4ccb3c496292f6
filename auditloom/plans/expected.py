"""Hand-labelled findings of the seeded corpus, and oracle SQL built from them.

Each row says which finding the program with that number must produce, written down from
the meaning of the rules, not from a run. The oracle joins the rows with `documents`.
"""

from __future__ import annotations

SECRET = "Signature d'un secret potentiellement réel détectée."
FSTRING = "F-strings in SQL statements can lead to injection vulnerabilities."
KEYWORDS = "F-string appears to contain SQL keywords, which could indicate injection risk."
PATTERN = "SQL statement with potential injection pattern: "

# (template, rule, line, severity, confidence, detail)
EXPECTED = [
    (1, "PY-SYNTAX", 1, "CRITICAL", "MEDIUM", "'(' was never closed"),
    (2, "SEC-EVAL", 3, "HIGH", "MEDIUM", "eval() détecté."),
    (3, "SEC-HARDCODED-SECRET", 1, "HIGH", "MEDIUM",
     "Une valeur sensible semble assignée directement dans le code."),
    (3, "SEC-SECRET-SCAN", None, "CRITICAL", "MEDIUM", SECRET),
    (3, "DATAFLOW-PRINT-LEAK", 3, "MEDIUM", "MEDIUM",
     "Variable 'api_token' appears to contain sensitive data and is being printed."),
    (3, "DATAFLOW-LOGGING-LEAK", 2, "HIGH", "MEDIUM",
     "Variable 'api_token' appears to contain sensitive data and is being passed to logging function."),
    (4, "PY-UNTYPED", 1, "LOW", "MEDIUM", "`dropped` contient des paramètres sans annotation: shop."),
    (4, "SQL-INJECTION-PATTERN", 3, "HIGH", "MEDIUM",
     PATTERN + "    return f\"DELETE FROM stock WHERE shop = '{wanted}'\"..."),
    (4, "SQL-INJECTION-FSTRING", 3, "HIGH", "MEDIUM", FSTRING),
    (4, "SQL-INJECTION-FSTRING-KEYWORDS", 3, "HIGH", "MEDIUM", KEYWORDS),
    (5, "ASYNC-BLOCKING-IO", 3, "MEDIUM", "MEDIUM", "Blocking call 'time.sleep' used in an async function."),
    (6, "DOCKER-NONROOT", None, "MEDIUM", "MEDIUM",
     "Le conteneur pourrait s'exécuter avec un utilisateur privilégié."),
    (6, "DOCKER-REMOTE-ADD", None, "LOW", "MEDIUM",
     "Le téléchargement direct pendant le build peut réduire la reproductibilité."),
    (7, "PY-UNTYPED", 1, "LOW", "MEDIUM", "`labels` contient des paramètres sans annotation: codes, names."),
    (8, "PY-UNTYPED", 1, "LOW", "MEDIUM", "`evens` contient des paramètres sans annotation: numbers."),
    (9, "PY-UNTYPED", 1, "LOW", "MEDIUM", "`stock_of` contient des paramètres sans annotation: db, shops."),
    (9, "PERF-N-PLUS-ONE", 4, "MEDIUM", "HIGH",
     "L'appel base de données `db.query()` est exécuté dans une boucle."),
    (11, "PY-UNTYPED", 1, "LOW", "MEDIUM", "`greeting` contient des paramètres sans annotation: guest."),
    (12, "SEC-SHELL", 2, "HIGH", "MEDIUM",
     "Risque d'injection de commande si des entrées non fiables influencent la commande."),
    (13, "PROD-DEBUG", 1, "HIGH", "MEDIUM", "FastAPI est instancié avec `debug=True`."),
    (13, "API-CORS-WILDCARD", 2, "MEDIUM", "MEDIUM", "La configuration autorise toutes les origines."),
    (14, "AUTH-JWT-NONE", 1, "CRITICAL", "MEDIUM",
     "Un appel JWT accepte explicitement l'algorithme non signé `none`."),
    (15, "PY-LONG-FUNCTION", 1, "MEDIUM", "MEDIUM", "`f` s'étend sur environ 82 lignes."),
    (16, "SQL-INJECTION-PATTERN", 1, "HIGH", "MEDIUM",
     PATTERN + 'db.execute(sa.text(f"SELECT a FROM t WHERE id = {i}"))...'),
    (16, "SQL-INJECTION-FSTRING", 1, "HIGH", "MEDIUM", FSTRING),
    (16, "SQLALCHEMY-FSTRING-TEXT", 1, "HIGH", "MEDIUM", "F-strings in SQLAlchemy text() can lead to SQL injection."),
    (16, "SQL-INJECTION-FSTRING-KEYWORDS", 1, "HIGH", "MEDIUM", KEYWORDS),
    (17, "SQL-CONCAT-EXECUTE", 1, "CRITICAL", "MEDIUM",
     "String concatenation in execute() calls is highly vulnerable to SQL injection."),
    (18, "ASYNC-NESTED-FUNCTION", 2, "LOW", "LOW",
     "La fonction async `b` est recréée à chaque appel de sa fonction parente."),
    (19, "ASYNC-BLOCKING-AWAIT", 2, "MEDIUM", "MEDIUM", "Blocking function 'sleep' is being awaited."),
    (19, "ASYNC-BLOCKING-IO", 2, "MEDIUM", "MEDIUM", "Blocking I/O function 'sleep' called in async function."),
    (20, "ASYNC-MISSING-AWAIT", 2, "MEDIUM", "MEDIUM",
     "Function call 'fetch_all' in async function may need await."),
    (21, "ASYNC-CONTEXT-MANAGER", 2, "LOW", "MEDIUM", "Context manager 'connect' may need 'async with'."),
    (22, "PERF-COMPLEX-COMPREHENSION", 1, "LOW", "MEDIUM",
     "List comprehension with multiple generators may be inefficient."),
    (22, "PERF-COMPLEX-DICT-COMP", 2, "LOW", "MEDIUM",
     "Dict comprehension with multiple generators may be inefficient."),
    (23, "PERF-EXPENSIVE-IN-LOOP", 2, "MEDIUM", "MEDIUM", "Expensive function 'sorted' called inside a loop."),
    (23, "PERF-LIST-IN-LOOP", 3, "LOW", "HIGH", "Une grande structure semble être créée à chaque itération."),
    (24, "PERF-LARGE-DATA-STRUCTURE", 1, "LOW", "MEDIUM", "Data structure with 51 elements defined inline."),
    (25, "ARCH-GOD-CLASS", 1, "LOW", "MEDIUM", "Class 'G' has 16 methods and ~0 lines."),
    (26, "PYDANTIC-CUSTOM-INIT", 1, "MEDIUM", "MEDIUM", "Model 'M' defines a custom __init__ method."),
    (26, "PYDANTIC-MUTABLE-DEFAULT", 2, "MEDIUM", "MEDIUM", "Field 'tags' in model 'M' has mutable default value."),
    (26, "PYDANTIC-SENSITIVE-NO-VALIDATOR", 3, "LOW", "MEDIUM",
     "Sensitive field 'api_key' in model 'M' has no validator."),
    (26, "PYDANTIC-OPTIONAL-NO-DEFAULT", 4, "LOW", "MEDIUM", "Field 'note' is Optional but has no default value."),
    (27, "PYDANTIC-NO-BASEMODEL", 1, "LOW", "MEDIUM", "Class 'M' doesn't appear to inherit from BaseModel."),
    (28, "FASTAPI-UNPROTECTED-ROUTE", 1, "MEDIUM", "MEDIUM",
     "GET route at src/pkg/mDOCID.py:1 has no detected security mechanism."),
    (29, "FASTAPI-MISSING-DEP", None, "LOW", "MEDIUM",
     "Dependency 'nowhere_DOCID' is referenced but not found in the codebase."),
    (30, "FASTAPI-OPENAPI-DISABLED", 1, "MEDIUM", "MEDIUM",
     "OpenAPI documentation appears to be disabled in production."),
    (30, "FASTAPI-DOCS-DISABLED", 1, "LOW", "MEDIUM", "Swagger UI documentation appears to be disabled."),
    (30, "FASTAPI-REDOC-DISABLED", 1, "LOW", "MEDIUM", "ReDoc documentation appears to be disabled."),
    (31, "ARCH-MIXED-CONCERNS", None, "LOW", "MEDIUM", "File appears to mix api, model concerns."),
    (31, "ARCH-CLEAN-VIOLATION", None, "MEDIUM", "MEDIUM", "Domain file imports framework code (fastapi)."),
    (31, "ARCH-DB-IN-API", 2, "MEDIUM", "MEDIUM", "Database operations should be in repository/service layer."),
    (32, "SEC-ENV-FILE", None, "MEDIUM", "MEDIUM",
     "Le fichier .env.production existe dans l'arborescence auditée; il doit normalement être ignoré par Git."),
    (32, "SEC-SECRET-SCAN", None, "CRITICAL", "MEDIUM", SECRET),
]

PATH_SQL = (
    "CASE doc_id % 33 WHEN 6 THEN 'd' || doc_id || '/Dockerfile' "
    "WHEN 31 THEN 'src/api/model_' || doc_id || '.py' "
    "WHEN 32 THEN 'd' || doc_id || '/.env.production' "
    "ELSE 'src/pkg/m' || doc_id || '.py' END"
)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], alias: str) -> str:
    """Rows as a VALUES table."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) {alias}"


def expected_table(rules: list[str] | None = None) -> str:
    rows = [row for row in EXPECTED if rules is None or row[1] in rules]
    return values(rows, "e(template, rule_id, line, severity, confidence, detail)")


# Lines of each program, after which the document's own text begins.
PROGRAM_LINES = [
    5, 1, 3, 3, 3, 3, 2, 3, 6, 5, 11, 2, 2, 2, 1, 83, 1, 1, 3, 2, 2, 3, 2, 4, 1, 17, 6, 2, 11, 2, 1, 2, 3,
]

# The signatures of a secret, as SQL patterns: label, pattern, whether case matters.
SECRET_SIGNATURES = [
    ("Clé privée", "-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", True),
    ("Clé AWS potentielle", r"aws_access_key_id\s*=\s*[A-Z0-9]{16,}", False),
    ("Secret AWS potentiel", r"aws_secret_access_key\s*=\s*[A-Za-z0-9/+]{40,}", False),
    ("Token GitHub potentiel", "github_pat_[A-Za-z0-9_]{20,}", False),
    ("Token GitHub (nouveau format)", "ghp_[A-Za-z0-9_]{36,}", False),
    ("Mot de passe codé en dur", r"password\s*=\s*[\"'][^\"']{8,}[\"']", False),
    ("Secret codé en dur", r"secret\s*=\s*[\"'][^\"']{8,}[\"']", False),
    ("Clé API codée en dur", r"api[_-]?key\s*=\s*[\"'][^\"']{8,}[\"']", False),
    ("Token codé en dur", r"token\s*=\s*[\"'][^\"']{8,}[\"']", False),
]
HARDCODED = r"(?i)(password|secret|api[_-]?key|token)\s*=\s*[\"'][^\"']{8,}[\"']"


def text_findings_sql(rules: list[str] | None) -> list[str]:
    """Findings of the documents' own text, which follows each program as comment lines."""
    out = []
    if rules is None or "SEC-HARDCODED-SECRET" in rules:
        starts = " ".join(f"WHEN {t} THEN {n}" for t, n in enumerate(PROGRAM_LINES))
        out.append(f"""
            SELECT doc_id, source, 'SEC-HARDCODED-SECRET' AS rule_id, 'HIGH' AS severity, 'MEDIUM' AS confidence,
                   CASE doc_id % 33 {starts} END + nth AS line,
                   'Une valeur sensible semble assignée directement dans le code.' AS detail
            FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS written,
                         generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents)
            WHERE doc_id % 33 NOT IN (6, 32) AND regexp_matches(written, {literal(HARDCODED)})""")
    if rules is None or "SEC-SECRET-SCAN" in rules:
        for label, pattern, exact in SECRET_SIGNATURES:
            # A program that holds the same kind of secret has that finding already.
            known = {"Clé privée": "32", "Token codé en dur": "3"}.get(label)
            out.append(f"""
                SELECT doc_id, source, 'SEC-SECRET-SCAN', 'CRITICAL', 'MEDIUM', NULL, {literal(SECRET)} FROM documents
                WHERE doc_id % 33 NOT IN ({', '.join(filter(None, ['6', known]))})
                  AND regexp_matches(text, {literal(pattern if exact else '(?i)' + pattern)})""")
    return out


def labelled_sql(rules: list[str] | None = None) -> str:
    """(doc_id, source, rule_id, severity, confidence, line, detail) of programs and texts."""
    programs = f"""
        SELECT d.doc_id, d.source, e.rule_id, e.severity, e.confidence, e.line, e.detail
        FROM documents d JOIN {expected_table(rules)} ON d.doc_id % 33 = e.template"""
    return " UNION ALL ".join([programs, *text_findings_sql(rules)])


def findings_sql(*rules: str) -> str:
    """The oracle of a rule query on the seeded corpus."""
    return f"""
        SELECT source AS repo, rule_id, severity, confidence,
               CASE WHEN rule_id = 'FASTAPI-MISSING-DEP' THEN NULL ELSE {PATH_SQL} END AS file,
               CAST(line AS INTEGER) AS line, replace(detail, 'DOCID', CAST(doc_id AS VARCHAR)) AS detail
        FROM ({labelled_sql(list(rules))})
    """


def per_template_sql(rows: list[tuple], columns: list[str]) -> str:
    """Rows labelled by template (first column), one per matching document, with repo and file."""
    shown = ", ".join(f"e.{c}" for c in columns)
    return f"""
        SELECT d.source AS repo, {PATH_SQL} AS file, {shown}
        FROM documents d JOIN {values(rows, 'e(template, ' + ', '.join(columns) + ')')}
        ON d.doc_id % 33 = e.template
    """


def sums_sql(sums: dict[str, dict[int, int]], keep_zero: bool = True) -> str:
    """Per source the sum of per-template amounts, as one column per name."""
    parts = []
    for name, amounts in sums.items():
        cases = " ".join(f"WHEN {t} THEN {n}" for t, n in amounts.items())
        parts.append(f"CAST(SUM(CASE doc_id % 33 {cases} ELSE 0 END) AS BIGINT) AS {name}" if amounts
                     else f"CAST(0 AS BIGINT) AS {name}")
    touched = sorted({t for amounts in sums.values() for t in amounts})
    where = "" if keep_zero else f"WHERE doc_id % 33 IN ({', '.join(map(str, touched))})"
    return f"SELECT source AS repo, {', '.join(parts)} FROM documents {where} GROUP BY source"
