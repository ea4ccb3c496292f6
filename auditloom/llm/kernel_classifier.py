"""Quality scores: random Fourier features, ridge regression from partition sums, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import add_columns, slices, small_batches, store
from auditloom.llm.stats import FEATURE_FIELDS, FEATURES, features
from auditloom.llm.textarrays import Texts

#: Fourier features are rounded to 1 / UNIT, so that their products add up exactly in any order.
UNIT = 1 << 12
#: Raw scores are gathered in this many cells between CELL_LOW and CELL_HIGH for the calibration.
CELLS, CELL_LOW, CELL_HIGH = 4096, -1.0, 2.0


@dataclass(frozen=True)
class KernelModel:
    """Everything a score needs; the size depends on the number of features only."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def waves(self, x: np.ndarray) -> np.ndarray:
        return waves((x - self.mean) / self.scale, self.weights, self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.beta / UNIT

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def waves(x: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Integer multiples of 1 / UNIT: a constant, then sqrt(2) cos(w x + b)."""
    z = np.rint(np.sqrt(2.0) * np.cos(np.clip(x, -8, 8) @ weights + phase) * UNIT)
    return np.column_stack([np.full(len(z), float(UNIT)), z])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature, from sums of rounded values so that order doesn't matter."""
    exact = [(F.round(F.least(F.col(c), F.lit(1e4)) * 65536)).cast("decimal(20,0)") for c in FEATURES]
    got = rows.agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(exact)],
        *[F.sum((x * x).cast("decimal(28,0)")).alias(f"q{i}") for i, x in enumerate(exact)],
    ).first()
    n = max(got["n"], 1)
    mean = np.array([float(got[f"s{i}"] or 0) / n for i in range(len(FEATURES))])
    square = np.array([float(got[f"q{i}"] or 0) / n for i in range(len(FEATURES))])
    scale = np.sqrt(np.maximum(square - mean**2, 0)) / 65536
    return mean / 65536, np.where(scale > 1e-9, scale, 1.0)


def normal_equations(rows: DataFrame, mean, scale, weights, phase) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y: each partition adds its rows up, Spark adds the partitions up, cell by cell."""
    size = weights.shape[1] + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1), np.int64)
        for batch in batches:
            z = waves((matrix(batch) - mean) / scale, weights, phase)
            y = batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            # Exact: a batch has at most 10^4 rows of integers below 2^13.
            total += np.rint(z.T @ np.column_stack([z, y])).astype(np.int64)
        i = np.concatenate([upper[0], np.arange(size)])
        j = np.concatenate([upper[1], np.full(size, size)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    sums = rows.mapInArrow(run, "i int, j int, v long").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    gram, right = np.zeros((size, size)), np.zeros(size)
    for i, j, v in sums.collect():  # (size + 1)^2 / 2 rows, whatever the input
        if j == size:
            right[i] = float(v) / UNIT
        else:
            gram[i, j] = gram[j, i] = float(v) / UNIT**2
    return gram, right


def isotonic(x: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns knots (centres of blocks) and their levels."""
    blocks: list[list[float]] = []
    for at, p, n in zip(x, ones, rows, strict=True):
        blocks.append([at * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            tail = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], tail, strict=True)]
    # One row of each kind is added to a block, so that no score is exactly 0 or 1 on little evidence.
    levels = np.array([(p + b) / (n + 2 * b) for _, p, n in blocks for b in [min(1.0, n / 100)]])
    return np.array([a / n for a, _, n in blocks]), np.maximum.accumulate(levels)


def fit(rows: DataFrame, n_waves: int = 128, ridge: float = 1e-4, width: float = 4.0, seed: int = 17) -> KernelModel:
    """A model from rows with FEATURES and quality (0 or 1); all rows count.

    Without any rows, or with one kind only, scores are constant: 0.5, or near that kind.
    """
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1 / width, (len(FEATURES), n_waves))
    phase = rng.uniform(0, 2 * np.pi, n_waves)
    mean, scale = moments(rows)
    gram, right = normal_equations(rows, mean, scale, weights, phase)
    n = gram[0, 0]
    if not n:
        return KernelModel(mean, scale, weights, phase, np.zeros(n_waves + 1), np.array([0.0]), np.array([0.5]))
    penalty = np.full(n_waves + 1, ridge * n)
    penalty[0] = 1e-9 * n
    beta = np.linalg.solve(gram + np.diag(penalty), right)
    model = KernelModel(mean, scale, weights, phase, beta, np.array([0.0]), np.array([0.0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (np.clip(model.raw(matrix(batch)), CELL_LOW, CELL_HIGH) - CELL_LOW) / (CELL_HIGH - CELL_LOW)
            cell = np.rint(at * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("quality").cast(pa.int64())], ["cell", "y"])

    cells = rows.mapInArrow(run, "cell int, y long").groupBy("cell").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    got = sorted(cells.collect())  # at most CELLS + 1 rows
    at = np.array([c for c, _, _ in got]) / CELLS * (CELL_HIGH - CELL_LOW) + CELL_LOW
    knots, levels = isotonic(at, np.array([float(y) for _, y, _ in got]), np.array([float(k) for *_, k in got]))
    return KernelModel(mean, scale, weights, phase, beta, knots, levels)


def training_rows(labels: DataFrame) -> DataFrame:
    """One label a doc_id (the smaller if they differ), held-out documents and nulls left out."""
    return (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("quality"))
    )


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def with_scores(rows: DataFrame, model: KernelModel) -> DataFrame:
    """``rows`` with score in place of the features."""
    kept = [f for f in rows.schema.fields if f.name not in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(matrix(batch)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), score], [*(f.name for f in kept), "score"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of each row, stored: whole texts are read once for fitting and scoring."""
    rows = add_columns(docs.select("doc_id", "text"), FEATURE_FIELDS, features)
    return store(rows.drop("text"))


def fit_on(statistics: DataFrame, labels: DataFrame, **how) -> KernelModel:
    """The join moves statistics, not texts."""
    train = statistics.join(training_rows(labels), F.col("doc_id") == F.col("__id")).select("quality", *FEATURES)
    return fit(store(train), **how)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Learns from labelled rows that aren't held out; null texts count as empty; a null doc_id is
    scored and not held out; repeated rows are scored each; other columns are not used. Long texts
    are measured whole; an empty table of documents gives an empty table.
    """
    statistics = measured(docs)
    model = fit_on(statistics, labels, **how)
    return with_scores(statistics, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns only.

    Texts are read twice, for fitting and for deciding, and never shuffled or stored again. Null
    texts count as empty; repeated rows are decided each; an empty table gives an empty table.
    """
    model = fit_on(measured(docs), labels, **how)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(np.column_stack(features(Texts.of(part.column("text")))))
                yield part.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
