"""Health score per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.dimensions import SEVERITIES
from auditloom.operators.findings import certainty, order_key

# Each repeat of a rule adds this share of its weight, up to this many repeats.
REPEAT_STEP = "0.15"
REPEAT_LIMIT = 4


def score(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, score) for every row of ``repos``; a repository without findings scores 100.

    A rule is weighed by its first finding in report order. All arithmetic is decimal, so
    the result does not depend on the order of summation, and halves round to even.
    """
    rule = F.coalesce(
        F.nullif("rule_id", F.lit("")), F.nullif("title", F.lit("")), F.lit("unknown")
    )
    per_rule = findings.groupBy("repo", rule.alias("rule")).agg(
        F.min(order_key()).alias("first"), F.count("*").alias("n")
    )
    weight = F
    for _, sort_weight, score_weight in SEVERITIES:
        weight = weight.when(F.col("first.w") == -sort_weight, F.lit(score_weight))
    repeats = F.least(F.lit(REPEAT_LIMIT), F.col("n") - 1).cast("decimal(2,0)")
    factor = F.lit(1).cast("decimal(2,0)") + F.lit(REPEAT_STEP).cast("decimal(3,2)") * repeats
    penalty = (
        weight.cast("decimal(4,1)") * certainty(F.col("first.confidence")).cast("decimal(3,2)")
        * factor.cast("decimal(4,2)")
    )
    totals = per_rule.groupBy("repo").agg(F.sum(penalty).alias("penalty"))
    left = F.lit(100) - F.coalesce("penalty", F.lit(0))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(left, 0).cast("int")))
    return repos.select("repo").distinct().join(totals, "repo", "left").select(
        "repo", clamped.alias("score")
    )
