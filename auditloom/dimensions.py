"""Fixed values the audit depends on: scales, name lists, weights."""

from __future__ import annotations

from decimal import Decimal

# Severities from worst to mildest, gate/sort weight, score weight.
SEVERITIES = [
    ("CRITICAL", 10, Decimal("15.0")),
    ("HIGH", 7, Decimal("8.0")),
    ("MEDIUM", 4, Decimal("3.0")),
    ("LOW", 2, Decimal("0.5")),
    ("INFO", 0, Decimal("0.0")),
]
SEVERITY_NAMES = [name for name, _, _ in SEVERITIES]

# How much of a rule's weight counts at each confidence.
CONFIDENCES = [("HIGH", Decimal("1.00")), ("MEDIUM", Decimal("0.65")), ("LOW", Decimal("0.30"))]
DEFAULT_CONFIDENCE = "MEDIUM"
DEFAULT_SOURCE = "auditloom"

# Directories never audited, matched exactly on directory parts.
SKIP_DIRS = [
    ".git", ".hg", ".svn", ".venv", "venv", "env", ".env", "node_modules", "__pycache__",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "dist", "build", ".idea", ".vscode",
    ".next", "htmlcov", "site-packages", "coverage", ".coverage", ".pytest-tmp-codex",
]

# File name endings.
PYTHON_EXTENSIONS = [".py", ".pyi"]
TEXT_EXTENSIONS = [".py", ".pyi", ".toml", ".ini", ".cfg", ".yaml", ".yml", ".json", ".env"]

# Parts of the lower-cased names of specification files.
SPEC_NAMES = ["openapi", "swagger", "api-docs"]

# Fixed value: bytes above which a file is reported as large.
LARGE_FILE = 50_000_000

# External tools whose reports are ingested.
TOOLS = ["ruff", "mypy", "bandit", "pip-audit", "semgrep", "pytest"]
