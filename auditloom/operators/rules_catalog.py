"""What each rule reports: fixed texts of the findings.

Detail texts that depend on the finding are built by the rule itself.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    severity: str
    category: str
    title: str
    detail: str
    recommendation: str


# Texts of findings, by rule. A detail of "" is built per finding.
RULES: dict[str, Rule] = {
    "PY-SYNTAX": Rule(
        "CRITICAL", "Correctness", "Python syntax error", "",
        "Corriger l'erreur de syntaxe avant toute mise en production."),
    "PY-LONG-FUNCTION": Rule(
        "MEDIUM", "Maintainability", "Fonction excessivement longue", "",
        "Découper la logique en services/fonctions plus petits et testables."),
    "PY-UNTYPED": Rule(
        "LOW", "Type Safety", "Paramètres non annotés", "",
        "Ajouter des annotations et exécuter mypy ou pyright."),
    "SEC-EVAL": Rule(
        "HIGH", "Security", "Exécution dynamique de code", "",
        "Supprimer si possible et préférer une logique explicite."),
    "SEC-SHELL": Rule(
        "HIGH", "Security", "subprocess avec shell=True",
        "Risque d'injection de commande si des entrées non fiables influencent la commande.",
        "Éviter shell=True et passer les arguments sous forme de liste."),
    "SEC-HARDCODED-SECRET": Rule(
        "HIGH", "Secrets", "Secret potentiellement codé en dur",
        "Une valeur sensible semble assignée directement dans le code.",
        "Utiliser des variables d'environnement ou un gestionnaire de secrets."),
    "SEC-SECRET-SCAN": Rule(
        "CRITICAL", "Secrets", "",
        "Signature d'un secret potentiellement réel détectée.",
        "Révoquer/faire tourner le secret s'il est réel et le retirer de l'historique Git."),
    "SEC-ENV-FILE": Rule(
        "MEDIUM", "Secrets", "Fichier .env présent dans le projet", "",
        "Vérifier .gitignore et s'assurer qu'aucun secret réel n'est versionné."),
    "REPO-LARGE-FILE": Rule(
        "LOW", "Repository", "Fichier volumineux", "",
        "Éviter de versionner des artefacts générés ou binaires lourds."),
    "SCAN-UNREADABLE": Rule(
        "INFO", "Scan", "Folder or file left out", "",
        "Give the audit permission to read it, or scan again when nothing changes."),
    "PROD-DEBUG": Rule(
        "HIGH", "Production", "Mode debug actif", "FastAPI est instancié avec `debug=True`.",
        "Désactiver le debug en production."),
    "API-CORS-WILDCARD": Rule(
        "MEDIUM", "FastAPI Security", "CORS générique détecté",
        "La configuration autorise toutes les origines.",
        "Limiter explicitement les origines en production."),
    "AUTH-JWT-NONE": Rule(
        "CRITICAL", "Authentication", "Algorithme JWT `none` accepté",
        "Un appel JWT accepte explicitement l'algorithme non signé `none`.",
        "Imposer une liste d'algorithmes signés autorisés."),
    "DOCKER-NONROOT": Rule(
        "MEDIUM", "Docker", "Dockerfile sans USER non-root",
        "Le conteneur pourrait s'exécuter avec un utilisateur privilégié.",
        "Créer et utiliser un utilisateur non privilégié."),
    "DOCKER-REMOTE-ADD": Rule(
        "LOW", "Docker", "ADD d'une URL distante",
        "Le téléchargement direct pendant le build peut réduire la reproductibilité.",
        "Préférer des étapes explicites et vérifier les artefacts téléchargés."),
    "DATAFLOW-LOGGING-LEAK": Rule(
        "HIGH", "Data Flow", "Sensitive data potentially logged", "",
        "Avoid logging sensitive data. Use masking or redaction."),
    "DATAFLOW-PRINT-LEAK": Rule(
        "MEDIUM", "Data Flow", "Sensitive data printed to stdout", "",
        "Remove debug prints or mask sensitive data."),
    "SQL-INJECTION-PATTERN": Rule(
        "HIGH", "SQL Injection", "Potential SQL injection vulnerability", "",
        "Use parameterized queries or ORM methods instead of string concatenation."),
    "SQL-INJECTION-FSTRING": Rule(
        "HIGH", "SQL Injection", "F-string in SQL statement",
        "F-strings in SQL statements can lead to injection vulnerabilities.",
        "Use parameterized queries with SQLAlchemy or database drivers."),
    "SQL-INJECTION-FORMAT": Rule(
        "HIGH", "SQL Injection", "String format in SQL statement",
        "String formatting in SQL statements can lead to injection vulnerabilities.",
        "Use parameterized queries instead of string formatting."),
    "SQLALCHEMY-FSTRING-TEXT": Rule(
        "HIGH", "SQL Injection", "F-string in SQLAlchemy text()",
        "F-strings in SQLAlchemy text() can lead to SQL injection.",
        "Use SQLAlchemy's parameter binding with :param syntax."),
    "SQL-CONCAT-EXECUTE": Rule(
        "CRITICAL", "SQL Injection", "String concatenation in database execute()",
        "String concatenation in execute() calls is highly vulnerable to SQL injection.",
        "Use parameterized queries with placeholders (?, %s, :name)."),
    "SQL-INJECTION-FSTRING-KEYWORDS": Rule(
        "HIGH", "SQL Injection", "F-string with SQL keywords",
        "F-string appears to contain SQL keywords, which could indicate injection risk.",
        "Review for SQL injection vulnerability. Use parameterized queries."),
    "ASYNC-NESTED-FUNCTION": Rule(
        "LOW", "Async Performance", "Fonction async imbriquée dans une fonction async", "",
        "La déplacer au niveau du module seulement si elle ne capture aucun état local."),
    "ASYNC-BLOCKING-AWAIT": Rule(
        "MEDIUM", "Async Performance", "Blocking call in await", "",
        "Use async alternatives: asyncio.sleep instead of time.sleep."),
    "ASYNC-BLOCKING-IO": Rule(
        "MEDIUM", "Async Performance", "Blocking I/O in async function", "",
        "Use async alternatives: aiofiles for file I/O, aiohttp for HTTP."),
    "ASYNC-MISSING-AWAIT": Rule(
        "MEDIUM", "Async Correctness", "Possible missing await", "",
        "Check if this function returns a coroutine and needs await."),
    "ASYNC-CONTEXT-MANAGER": Rule(
        "LOW", "Async Correctness", "Possible sync context manager in async function", "",
        "Use 'async with' for async context managers."),
    "PERF-N-PLUS-ONE": Rule(
        "MEDIUM", "Performance", "Requête potentiellement répétée dans une boucle", "",
        "Vérifier le nombre de requêtes et préférer un chargement groupé si nécessaire."),
    "PERF-LIST-IN-LOOP": Rule(
        "LOW", "Performance", "Allocation volumineuse dans une boucle",
        "Une grande structure semble être créée à chaque itération.",
        "Déplacer l'allocation hors de la boucle lorsque c'est possible."),
    "PERF-EXPENSIVE-IN-LOOP": Rule(
        "MEDIUM", "Performance", "Expensive operation in loop", "",
        "Move expensive operations outside loops when possible."),
    "PERF-COMPLEX-COMPREHENSION": Rule(
        "LOW", "Performance", "Complex list comprehension",
        "List comprehension with multiple generators may be inefficient.",
        "Consider using explicit loops for complex comprehensions."),
    "PERF-COMPLEX-DICT-COMP": Rule(
        "LOW", "Performance", "Complex dict comprehension",
        "Dict comprehension with multiple generators may be inefficient.",
        "Consider using explicit loops for complex comprehensions."),
    "PERF-LARGE-DATA-STRUCTURE": Rule(
        "LOW", "Performance", "Large data structure literal", "",
        "Consider loading large data from files or databases."),
    "ARCH-CIRCULAR-IMPORT": Rule(
        "MEDIUM", "Architecture", "Circular import detected", "",
        "Refactor to break circular dependencies."),
    "ARCH-CLEAN-VIOLATION": Rule(
        "MEDIUM", "Architecture", "Clean Architecture violation", "",
        "Keep domain logic independent of frameworks."),
    "ARCH-GOD-CLASS": Rule(
        "LOW", "Architecture", "Potential God class", "",
        "Consider splitting into smaller, focused classes."),
    "ARCH-HIGH-COUPLING": Rule(
        "LOW", "Architecture", "High coupling (many imports)", "",
        "Reduce dependencies and apply dependency inversion."),
    "ARCH-MIXED-CONCERNS": Rule(
        "LOW", "Architecture", "Mixed concerns in file", "",
        "Separate concerns into different files/modules."),
    "ARCH-DB-IN-API": Rule(
        "MEDIUM", "Architecture", "Database logic in API layer",
        "Database operations should be in repository/service layer.",
        "Move database logic to repository layer."),
    "FASTAPI-CIRCULAR-DEP": Rule(
        "MEDIUM", "FastAPI Architecture", "Circular dependency detected", "",
        "Refactor dependencies to remove circular references."),
    "FASTAPI-UNPROTECTED-ROUTE": Rule(
        "MEDIUM", "FastAPI Security", "Route without explicit security", "",
        "Add authentication/authorization with Depends() or Security()."),
    "FASTAPI-MISSING-DEP": Rule(
        "LOW", "FastAPI Architecture", "Potential missing dependency", "",
        "Define the dependency function or check for typos."),
    "FASTAPI-OPENAPI-DISABLED": Rule(
        "MEDIUM", "FastAPI Security", "OpenAPI documentation disabled",
        "OpenAPI documentation appears to be disabled in production.",
        "Ensure OpenAPI docs are only disabled in production, not development."),
    "FASTAPI-DOCS-DISABLED": Rule(
        "LOW", "FastAPI Documentation", "Swagger UI disabled",
        "Swagger UI documentation appears to be disabled.",
        "Consider keeping docs enabled for development environments."),
    "FASTAPI-REDOC-DISABLED": Rule(
        "LOW", "FastAPI Documentation", "ReDoc disabled",
        "ReDoc documentation appears to be disabled.",
        "Consider keeping ReDoc enabled for alternative documentation."),
    "OPENAPI-INVALID-FORMAT": Rule(
        "LOW", "OpenAPI", "Invalid OpenAPI file", "", "Fix the OpenAPI file format."),
    "OPENAPI-ANALYSIS-ERROR": Rule(
        "LOW", "OpenAPI", "Error analyzing OpenAPI file", "", "Check the OpenAPI file for errors."),
    "OPENAPI-OUTDATED-VERSION": Rule(
        "LOW", "OpenAPI", "Outdated OpenAPI version", "", "Consider upgrading to OpenAPI 3.x."),
    "OPENAPI-MISSING-DESCRIPTION": Rule(
        "LOW", "OpenAPI", "Endpoint missing description", "",
        "Add a description to improve documentation."),
    "OPENAPI-MISSING-RESPONSE": Rule(
        "LOW", "OpenAPI", "Endpoint missing response schema", "",
        "Add response schemas for better documentation."),
    "OPENAPI-NO-SECURITY": Rule(
        "MEDIUM", "OpenAPI", "No security schemes defined",
        "OpenAPI specification has no security schemes defined.",
        "Define security schemes for API authentication."),
    "PYDANTIC-UNTYPED-FIELD": Rule(
        "LOW", "Pydantic", "Untyped Pydantic field", "",
        "Add type annotations to all Pydantic fields."),
    "PYDANTIC-CUSTOM-INIT": Rule(
        "MEDIUM", "Pydantic", "Pydantic model with custom __init__", "",
        "Avoid custom __init__ in Pydantic models; use validators instead."),
    "PYDANTIC-MUTABLE-DEFAULT": Rule(
        "MEDIUM", "Pydantic", "Mutable default in Pydantic field", "",
        "Use default_factory for mutable defaults: default_factory=list, dict, or set."),
    "PYDANTIC-SENSITIVE-NO-VALIDATOR": Rule(
        "LOW", "Pydantic Security", "Sensitive field without validator", "",
        "Add a validator for sensitive fields to enforce security rules."),
    "PYDANTIC-NO-BASEMODEL": Rule(
        "LOW", "Pydantic", "Possible non-Pydantic class", "",
        "Ensure Pydantic models inherit from BaseModel."),
    "PYDANTIC-OPTIONAL-NO-DEFAULT": Rule(
        "LOW", "Pydantic", "Optional field without default", "",
        "Add default=None to Optional fields."),
    "TOOL-TIMEOUT": Rule(
        "MEDIUM", "Tooling", "", "L'analyse n'a pas terminé dans le délai configuré.",
        "Relancer l'outil séparément ou ajuster le délai."),
    "RUFF": Rule("MEDIUM", "Code Quality", "", "", "Corriger la violation ou la justifier."),
    "BANDIT": Rule("MEDIUM", "Security", "", "", "Examiner et corriger le problème de sécurité."),
    "DEP-VULN": Rule(
        "HIGH", "Dependencies", "", "", "Mettre à jour vers une version corrigée si disponible."),
    "TEST-FAIL": Rule(
        "HIGH", "Testing", "Tests pytest en échec", "",
        "Corriger les tests en échec avant le déploiement."),
}

# The dotted blocking calls of ASYNC-BLOCKING-IO come with their own advice.
BLOCKING_DOTTED_ADVICE = "Use an async alternative or run the blocking call in a thread pool."
