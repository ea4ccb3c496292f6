"""Repositories in which every feature flag is set, every metric counts something and every gate is open.

Ten documents in a row are a repository. Its files are small programs, by the last digit of the
document's id, followed by the document's text as comments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import code_rules, features, graph, model_rules, route_rules
from auditloom.plans.audit import audit
from auditloom.plans.bound.base import bind, table
from auditloom.plans.expected import literal
from auditloom.session import spread
from auditloom.sources.facts import extract_facts, imports, store_facts
from auditloom.sources.files import describe, select_python
from auditloom.sources.lines import to_lines

# Name and program by the last digit; ID, NEXT and LAST are the document's id and those beside it.
PROGRAMS = [
    ("src/mID.py", "from pydantic import BaseModel, Field, validator\n\nclass User(BaseModel):\n    name: ... = 'x'\n"
     "    mail: str = Field('', alias='m')\n\n    @validator('mail')\n    def check(cls, value):\n        return value\n\n"
     "    class Config:\n        extra = 'forbid'\n\nclass Loose(BaseModel):\n    tags: list = []\n    note: Optional[str]\n"
     "    api_key: str = 'x'\n\n    def __init__(self) -> None:\n        pass\n"),
    ("src/mID.py", "import src.mNEXT\n"),
    ("src/mID.py", "import src.mLAST\n"),
    ("src/mID.py", "from fastapi import Depends\n\ndef fID(x=Depends(fNEXT)):\n    return x\n"),
    ("src/mID.py", "def fID(x=Depends(fLAST)):\n    return x\n"),
    ("src/mID.py", "for i in rows:\n    total = price_of_everything_in_the_basket * i\n"),
    ("src/stack.py", "# import fastapi pydantic sqlalchemy alembic jwt oauth2 rbac corsmiddleware redis celery pytest\n"
     "# postgresql graphql openapi\n"),
    ("deploy.yaml", "kind: kubernetes\n"),
    ("Dockerfile", "FROM base\nUSER app\n"),
    ("weights.bin", ""),
]
WEIGHTS_SIZE = 60_000_000

# Rule, line in the program and detail of what the first program breaks.
MODEL_FINDINGS = [
    ("PYDANTIC-UNTYPED-FIELD", 4, "Field 'name' in model 'User' has no type annotation."),
    ("PYDANTIC-CUSTOM-INIT", 14, "Model 'Loose' defines a custom __init__ method."),
    ("PYDANTIC-MUTABLE-DEFAULT", 15, "Field 'tags' in model 'Loose' has mutable default value."),
    ("PYDANTIC-OPTIONAL-NO-DEFAULT", 16, "Field 'note' is Optional but has no default value."),
    ("PYDANTIC-SENSITIVE-NO-VALIDATOR", 17, "Sensitive field 'api_key' in model 'Loose' has no validator."),
]

REPOS_SQL = """
    SELECT 'p' || (doc_id // 10) AS repo, count(*) AS n, doc_id // 10 * 10 AS first,
           {has} FROM documents GROUP BY doc_id // 10
""".format(has=", ".join(f"bool_or(doc_id % 10 = {k}) AS has_{k}" for k in range(10)))


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of these repositories."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digit, doc_id = (F.col("doc_id") % 10).cast("int"), F.col("doc_id")

    def of(column: int) -> F.Column:
        out = F.get(F.array(*[F.lit(p[column]) for p in PROGRAMS]), digit)
        for word, number in (("ID", doc_id), ("NEXT", doc_id + 1), ("LAST", doc_id - 1)):
            out = F.replace(out, F.lit(word), number.cast("string"))
        return out

    comments = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?|\n", "\n# "), F.lit("\n"))
    content = F.when(digit < 7, F.concat(of(1), comments)).otherwise(of(1))
    return describe(documents.select(
        F.concat(F.lit("p"), F.floor(doc_id / 10).cast("string")).alias("repo"), of(0).alias("path"), content.alias("content"),
        F.when(digit == 9, F.lit(WEIGHTS_SIZE)).otherwise(F.octet_length(content)).alias("size"),
    ))


def rich_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_facts(extract_facts(rich_files(spark, sf_dir)))


STACK_DIGIT = {"pydantic": "has_0 OR has_6", "fastapi": "has_3 OR has_6", "kubernetes": "has_7", "docker": "has_8"}


@bind("d1_all_flags", "SELECT repo, " + ", ".join(
    f"({STACK_DIGIT.get(f, 'has_6')}) AS {f}" for f in features.FEATURES) + f" FROM ({REPOS_SQL})")
def all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.detect_stack(rich_files(spark, sf_dir))


@bind("a37_all_model_metrics", f"""
    SELECT repo, 2 AS pydantic_models_found, 1 AS models_with_validators, 1 AS models_with_config, 1 AS untyped_fields,
           1 AS models_with_aliases FROM ({REPOS_SQL}) WHERE has_0
""")
def all_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rich_files(spark, sf_dir)
    return model_rules.model_metrics(store_facts(extract_facts(files)), to_lines(select_python(files)))


@bind("a29_redundant_calculations", f"SELECT repo, 1 AS redundant_calculations FROM ({REPOS_SQL}) WHERE has_5")
def redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = code_rules.performance_metrics(rich_facts(spark, sf_dir))
    return metrics.filter("redundant_calculations > 0").select("repo", "redundant_calculations")


@bind("d4_large_files", f"""
    SELECT repo, n AS files_scanned, CAST(has_9 AS BIGINT) AS large_files,
           CAST(has_0 AS BIGINT) * 2 + CAST(has_3 AS BIGINT) + CAST(has_4 AS BIGINT) AS functions,
           CAST(has_0 AS BIGINT) * 3 AS classes
    FROM ({REPOS_SQL})
""")
def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rich_files(spark, sf_dir)
    metrics = features.repo_metrics(files, store_facts(extract_facts(files)))
    return metrics.select("repo", "files_scanned", "large_files", "functions", "classes")


@bind("g11_dependency_cycles", f"""
    SELECT repo, CAST(has_3 AS BIGINT) + CAST(has_4 AS BIGINT) AS dependencies_found,
           CAST(has_3 AND has_4 AS BIGINT) AS dependency_cycles
    FROM ({REPOS_SQL}) WHERE has_3 OR has_4
""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = rich_facts(spark, sf_dir)
    cycles = route_rules.circular_dependencies(route_rules.dep_edges(facts))
    files = rich_files(spark, sf_dir)
    metrics = route_rules.dep_metrics(route_rules.routes(facts, to_lines(select_python(files))), facts, cycles)
    return metrics.select("repo", "dependencies_found", "dependency_cycles")


@bind("g3_pairs_of_imports", f"""
    SELECT repo, 'src/m' || (first + 1) || '.py' AS file,
           'Circular import: src/m' || (first + 1) || '.py -> src/m' || (first + 2) || '.py -> src/m' || (first + 1) || '.py' AS detail
    FROM ({REPOS_SQL}) WHERE has_1 AND has_2
""")
def pairs_of_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rich_files(spark, sf_dir)
    found = imports(store_facts(extract_facts(files, ["Import", "ImportFrom"])))
    return graph.circular_imports(graph.import_edges(found, graph.module_index(files))).select("repo", "file", "detail")


@bind("audit_rich_repos", " UNION ALL ".join([
    f"SELECT repo, {literal(rule)} AS rule_id, 'src/m' || first || '.py' AS file, {line} AS line, {literal(detail)} AS detail FROM ({REPOS_SQL}) WHERE has_0"
    for rule, line, detail in MODEL_FINDINGS
] + [f"""
    SELECT repo, 'ARCH-CIRCULAR-IMPORT', 'src/m' || (first + 1) || '.py', NULL,
           'Circular import: src/m' || (first + 1) || '.py -> src/m' || (first + 2) || '.py -> src/m' || (first + 1) || '.py'
    FROM ({REPOS_SQL}) WHERE has_1 AND has_2
""", f"""
    SELECT repo, 'FASTAPI-CIRCULAR-DEP', NULL, NULL,
           'Circular dependency involving ''f' || (first + 4) || ''' and ''f' || (first + 3) || '''.'
    FROM ({REPOS_SQL}) WHERE has_3 AND has_4
"""]))
def rich_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deep audit with open gates: models, import cycles and dependency cycles in one run."""
    found = audit(rich_files(spark, sf_dir), deep=True).findings
    wanted = [rule for rule, _, _ in MODEL_FINDINGS] + ["ARCH-CIRCULAR-IMPORT", "FASTAPI-CIRCULAR-DEP"]
    return found.filter(F.col("rule_id").isin(wanted)).select("repo", "rule_id", "file", "line", "detail")
