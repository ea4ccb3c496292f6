"""Rules about data-model classes: the class node joined with the fields of its body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text
from auditloom.operators.code_rules import functions, is_model
from auditloom.operators.findings import emit, emit_by_rule
from auditloom.operators.marks import mark_lines

# Parts of field names that need a validator.
SENSITIVE_FIELDS = ["password", "secret", "token", "key", "credential"]


def models(facts: DataFrame) -> DataFrame:
    """Classes whose list of bases mentions the model base."""
    return facts.filter(is_model())


def fields(facts: DataFrame) -> DataFrame:
    """(repo, path, class_pre, model, field, ...): annotated names in a model's own body.

    The join is on file and class position; a class and its fields live in one file.
    """
    owners = models(facts).select("repo", "path", F.col("pre").alias("class_pre"), F.col("name").alias("model"))
    members = facts.filter(
        "kind = 'AnnAssign' AND parent_kind = 'ClassDef' AND field = 'body' AND name IS NOT NULL"
    ).select(
        "repo", "path", F.col("parent").alias("class_pre"), F.col("name").alias("field"), "lineno",
        F.col("text").alias("annotation"), "value_kind", "value_name", "n_elts",
    )
    return members.join(owners, ["repo", "path", "class_pre"])


def validators(facts: DataFrame) -> DataFrame:
    """(repo, path, class_pre, field): the field each validator of a class names first."""
    methods = functions(facts).filter("parent_kind = 'ClassDef' AND field = 'body'").select(
        "repo", "path", F.col("parent").alias("class_pre"), F.explode("items").alias("d")
    )
    return methods.filter(
        (F.col("d.kind") == "Call") & F.col("d.owner").isNull() & (F.col("d.name") == "validator")
    ).select("repo", "path", "class_pre", F.col("d.text").alias("field"))


def field_rules(facts: DataFrame) -> DataFrame:
    """Untyped, mutable-default and optional-without-default fields, in one pass."""
    has_value = F.col("value_kind").isNotNull()
    untyped = has_value & (F.col("annotation") == "...")
    empty_literal = F.col("value_kind").isin("List", "Dict") & (F.col("n_elts") == 0)
    empty_set = (F.col("value_kind") == "Call") & (F.col("value_name") == "set") & (F.col("n_elts") == 0)
    optional = F.contains("annotation", F.lit("Optional[")) & ~has_value
    broken = F.array(
        F.when(untyped, F.lit("PYDANTIC-UNTYPED-FIELD")),
        F.when(empty_literal | empty_set, F.lit("PYDANTIC-MUTABLE-DEFAULT")),
        F.when(optional, F.lit("PYDANTIC-OPTIONAL-NO-DEFAULT")),
    )
    hits = fields(facts).withColumn("rule", F.explode(F.filter(broken, lambda r: r.isNotNull())))
    name, model = F.col("field"), F.col("model")
    details = {
        "PYDANTIC-UNTYPED-FIELD": F.format_string(
            "Field '%s' in model '%s' has no type annotation.", name, model),
        "PYDANTIC-MUTABLE-DEFAULT": F.format_string(
            "Field '%s' in model '%s' has mutable default value.", name, model),
        "PYDANTIC-OPTIONAL-NO-DEFAULT": F.format_string(
            "Field '%s' is Optional but has no default value.", name),
    }
    return emit_by_rule(hits, "rule", details, line="lineno")


def custom_init(facts: DataFrame) -> DataFrame:
    owners = functions(facts).filter("parent_kind = 'ClassDef' AND field = 'body' AND name = '__init__'").select(
        "repo", "path", F.col("parent").alias("pre")
    )
    hits = models(facts).join(owners, ["repo", "path", "pre"], "left_semi")
    detail = F.format_string("Model '%s' defines a custom __init__ method.", F.col("name"))
    return emit(hits, "PYDANTIC-CUSTOM-INIT", detail=detail, line="lineno")


def unvalidated_secrets(facts: DataFrame) -> DataFrame:
    sensitive = fields(facts).filter(text.contains_any(F.lower("field"), SENSITIVE_FIELDS))
    hits = sensitive.join(validators(facts), ["repo", "path", "class_pre", "field"], "left_anti")
    detail = F.format_string("Sensitive field '%s' in model '%s' has no validator.", F.col("field"), F.col("model"))
    return emit(hits, "PYDANTIC-SENSITIVE-NO-VALIDATOR", detail=detail, line="lineno")


def model_metrics(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, models, validators, configs, untyped fields, aliases)."""
    configs = facts.filter("kind = 'ClassDef' AND name = 'Config' AND parent_kind = 'ClassDef'").select(
        "repo", "path", F.col("parent").alias("pre")
    ).join(models(facts).select("repo", "path", "pre"), ["repo", "path", "pre"], "left_semi")
    untyped = fields(facts).filter("value_kind IS NOT NULL AND annotation = '...'")
    marked = mark_lines(lines).select("repo", F.explode(F.filter(F.array(
        F.when(F.col("validator"), F.lit("models_with_validators")),
        F.when(F.col("alias"), F.lit("models_with_aliases")),
    ), lambda m: m.isNotNull())).alias("metric"))
    counted = (
        marked.unionByName(models(facts).select("repo", F.lit("pydantic_models_found").alias("metric")))
        .unionByName(configs.select("repo", F.lit("models_with_config").alias("metric")))
        .unionByName(untyped.select("repo", F.lit("untyped_fields").alias("metric")))
    )
    names = [
        "pydantic_models_found", "models_with_validators", "models_with_config", "untyped_fields",
        "models_with_aliases",
    ]
    return counted.groupBy("repo").agg(*[F.count_if(F.col("metric") == n).alias(n) for n in names])
