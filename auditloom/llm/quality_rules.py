"""Learned decision lists: sequential covering over labelled statistics, emitted as one Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import add_columns
from auditloom.llm.stats import COUNT_FIELDS, COUNTS, FEATURE_FIELDS, FEATURES, counts_and_features, features


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.feature]
        return x >= self.threshold if self.at_least else x <= self.threshold

    def column(self) -> Column:
        x = F.col(f"`{self.feature}`")
        return x >= F.lit(self.threshold) if self.at_least else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction; whoever meets it is rejected."""

    conditions: tuple[Condition, ...]

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(values) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds decides, no rule means keep."""

    rules: tuple[Rule, ...]

    def number(self) -> Column:
        """The position of the deciding rule from 1, or 0: one CASE expression."""
        out = F.lit(0)
        for k in range(len(self.rules), 0, -1):
            out = F.when(self.rules[k - 1].column(), F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*(f"reject if {r}" for r in self.rules), "keep"])


def best_condition(values, bad, good, among, candidates):
    """The threshold with the highest FOIL gain over the rows ``among``, or None."""
    p0, n0 = int((bad & among).sum()), int((good & among).sum())
    best, found = 1e-9, None
    base = np.log2(p0 / (p0 + n0))
    for name in candidates:
        x = values[name][among]
        order = np.argsort(x, kind="stable")
        ranked, hits = x[order], bad[among][order]
        last = np.flatnonzero(np.concatenate([ranked[1:] != ranked[:-1], [True]]))
        p_low = np.cumsum(hits)[last]
        all_low = last + 1
        # Thresholds lie halfway between neighbours, so that rules aren't tied to single rows.
        middle = np.concatenate([(ranked[last[:-1]] + ranked[last[:-1] + 1]) / 2, [ranked[-1]]])
        for at_least, p, n in ((False, p_low, all_low - p_low), (True, p0 - p_low, n0 - (all_low - p_low))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], Condition(name, at_least, float(middle[k]))
    return found


def grow(values, bad, good, most_conditions):
    """Add conditions until no good row is left or nothing gains."""
    among, conditions = np.ones(len(bad), bool), []
    while len(conditions) < most_conditions and (good & among).any() and (bad & among).any():
        found = best_condition(values, bad, good, among, FEATURES)
        if found is None:
            break
        conditions.append(found)
        among = among & found.holds(values)
    return conditions


def worth(conditions, values, bad, good) -> float:
    hit = Rule(tuple(conditions)).holds(values)
    p, n = int((hit & bad).sum()), int((hit & good).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(conditions, values, bad, good):
    """The shortest beginning of the conjunction that does best on rows it wasn't grown on."""
    scored = [(worth(conditions[:k], values, bad, good), -k) for k in range(1, len(conditions) + 1)]
    return conditions[:-max(scored)[1]]


def learn(
    values: dict[str, np.ndarray], bad: np.ndarray, prune_rows: np.ndarray,
    precision: float = 0.97, most_rules: int = 24, most_conditions: int = 5,
) -> DecisionList:
    """Sequential covering: grow on two thirds, prune on the rest, take the covered rows away, repeat.

    A rule enters the list only if ``precision`` of the rows it covers are bad. Without bad or
    without good rows the list is empty.
    """
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules:
        first, second = left & ~prune_rows, left & prune_rows
        if not (bad & first).any() or not (~bad & first).any():
            break
        part = {k: v[first] for k, v in values.items()}
        conditions = grow(part, bad[first], ~bad[first], most_conditions)
        if not conditions:
            break
        rest = {k: v[second] for k, v in values.items()}
        rule = Rule(tuple(prune(conditions, rest, bad[second], ~bad[second])))
        hit = rule.holds(values) & left
        if not (hit & bad).any() or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def sampled_labels(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labels, those with the smallest hash of their doc_id: a bounded sample."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **how) -> DecisionList:
    """A decision list from ``labels(doc_id, quality)``, where quality 0 is to be rejected.

    Only ``sample_rows`` labelled documents reach the driver, as statistics; the sample is sent
    to the scan, so that no text is shuffled.
    """
    sample = F.broadcast(sampled_labels(labels, sample_rows).select(F.col("doc_id").alias("__id"), "quality"))
    chosen = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("__id")).select("doc_id", "quality", "text")
    measured = add_columns(chosen, FEATURE_FIELDS, features)
    # A repeated doc_id gives repeated rows; the bound holds for them as well.
    got = measured.drop("text").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample_rows).toPandas()
    values = {c: got[c].to_numpy(float) for c in FEATURES}
    turn = (got["doc_id"].to_numpy(np.int64) * 2654435761 >> 7) % 3 == 0 if len(got) else np.zeros(0, bool)
    return learn(values, got["quality"].to_numpy() == 0, turn, **how)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept, rule (0: none).

    Null and empty texts have zero counts and fail the base rule; repeated rows are judged each;
    other columns of ``docs`` are not used; an empty table gives an empty table.
    """
    measured = add_columns(docs.select("doc_id", "text"), [*COUNT_FIELDS, *FEATURE_FIELDS], counts_and_features)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), rules.number().cast("int").alias("rule"),
    ).select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
